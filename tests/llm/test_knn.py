import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import knn


def brute(rows, step, k=5):
    data = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(data, reverse=True) if i % step == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in data if j != q)[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def result(spark, rows, step, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("RANK", F.lit(0))
    data = knn.quantise(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in knn.search(data, data.filter(F.col("id") % step == 0), **how).collect())


def test_clustered_data_with_many_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.05).tolist()) for i in range(600)]
    want = brute(rows, 7)
    assert result(spark, rows, 7, pivots=12, query_block=10, data_block=40) == want
    assert result(spark, rows, 7) == want


def test_bounds_exclude_far_cells():
    pivots = np.array([[0.0, 0.0], [100.0, 0.0]])
    cells, near = {0: (50, 1.0), 1: (50, 1.0)}, {0: [0.1] * 6, 1: [0.1] * 6}
    groups, need = knn._bounds(pivots, cells, near, {0: (5, 1.0)}, 5, 100)
    assert groups == [[0]] and need == {0: [(0, 0.0)], 1: []}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [9.0, 9.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [-1.0, 5.0])]
    assert result(spark, rows, 50) == brute(rows, 50)
    assert result(spark, [], 50) == [] and result(spark, [(1, [1.0])], 50) == [] and result(spark, [(50, [1.0])], 50) == []
    same = [(i, [0.5, 0.5]) for i in range(400)]
    assert result(spark, same, 50, data_block=30) == brute(same, 50)


def test_large_values_are_exact(spark):
    rows = [(0, [2.0**27, 1.0]), (1, [2.0**26, 1.0]), (2, [2.0**26, 0.0]), (3, [2.0**26, 2.0]), (4, [-(2.0**26), 3.0]), (5, [2.0**30, 3.0])]
    data = spark.createDataFrame(rows, "id long, vec array<double>")
    got = sorted(tuple(r) for r in knn.search(data, data.filter("id = 0"), k=4).collect())
    want = sorted(((i, int(v[0]) * 2**27 + int(v[1])) for i, v in rows[1:]), key=lambda x: (-x[1], x[0]))[:4]
    assert got == [(0, n + 1, i, score) for n, (i, score) in enumerate(want)]
