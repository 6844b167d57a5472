import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import toxicity as tx


def rows(n=240):
    rng = random.Random(1)
    out = []
    for i in range(n):
        w = [rng.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(rng.randint(5, 150))]
        bad = i % 3 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_gradients():
    rng = np.random.default_rng(0)
    words = [b"abc", b"de", b"fgh", b"i"]
    m = tx.Toxicity.fresh(words)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    idx, real, y = rng.integers(0, 4, (5, 3)), np.arange(5)[:, None] < np.array([5, 3, 1]), np.array([1.0, 0, 1])
    _, g = m.gradients(words, idx, real, y)
    for k in ("xf", "hf", "bf", "xb", "hb", "bb", "att", "att_v", "out", "out_b"):
        flat = m.p[k].reshape(-1)
        for i in rng.integers(len(flat), size=3):
            old = flat[i]
            flat[i] = old + 1e-3
            up = m.gradients(words, idx, real, y)[0]
            flat[i] = old - 1e-3
            down = m.gradients(words, idx, real, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 1e-5


def test_windows_cover_the_text():
    for n in (1, 39, 40, 41, 70, 71, 500):
        covered = {i for s in tx.window_starts(n) for i in range(s, min(n, s + tx.WINDOW))}
        assert covered == set(range(n))


def test_held_out_accuracy_and_edges(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(9999, 1), (3, None)], "doc_id long, toxic int")
    model = tx.fit(docs.filter("doc_id % 5 <> 0"), labels)
    scored = {r["doc_id"]: r["toxic_score"] for r in tx.add_scores(docs.withColumn("TOXIC_SCORE", F.lit(0)), model).collect()}
    right = [(scored[i] >= 0.5) == bool(y) for i, _, y in data if i % 5 == 0]
    assert sum(right) >= 0.9 * len(right)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "lorem " * 20000 + "idiot " + "ipsum " * 20000), (5, "sed do"), (5, "sed do")], "doc_id long, text string")
    got = sorted(tuple(r) for r in tx.add_scores(odd, model).select("doc_id", "toxic_score").collect())
    assert all(0 <= s <= 1 for _, s in got) and got[0][1] < 0.5 and got[3][1] >= 0.5 and got[4] == got[5]
    empty = docs.limit(0)
    assert tx.add_scores(empty, tx.fit(empty, labels)).count() == 0
