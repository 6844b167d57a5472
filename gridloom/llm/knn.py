"""Exact top-k inner-product search as a Voronoi kNN join.

Vectors are lifted by one coordinate so that all data vectors share one length; the largest
inner products are then the smallest Euclidean distances, and the triangle inequality holds.
Data and queries are assigned to the Voronoi cells of a bounded set of pivots. Cell summaries
(count, radius, smallest pivot distances) bound how far a query group's k-th neighbour can
be; only data rows that the bounds cannot exclude are replicated to that group, in blocks of
bounded size, and every block is solved with one matrix product. The bounds are exact, so
nothing is lost; where they exclude nothing (directions without structure) every row goes to
every query group and the join becomes a blocked scan.

Only pivots (64, or a quarter of the root of the rows up to 1,024, so that cells sharpen as the
table grows) and per-cell summaries reach the driver. Where products may pass 2^52, they are
made and ranked as whole Python numbers; a score must fit a long.

Cases: rows with a null id, a null vector or a null or non-finite component take no part;
empty vectors score 0; vectors shorter than the longest count as padded with zeros; ties go
to the smaller id; a repeated query id is asked once (its least vector); repeated candidate
rows count each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import common

_EXACT = float(1 << 52)


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, vec) with floor(scale * component) as doubles, for the rows that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        df.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(F.coalesce(fine, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("vec"))
    )


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), dim)


def _place(df: DataFrame, pivots: np.ndarray, dim: int, top: float | None) -> DataFrame:
    """(id, vec as bytes, cell, dist) in the lifted space; top: the squared common length, None for queries."""
    norms = (pivots**2).sum(1)

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            n = batch.num_rows
            if not n:
                continue
            sizes = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((n, dim))
            x[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            own = (x**2).sum(1)
            lift = np.sqrt(np.maximum(0, top - own)) if top is not None else np.zeros(n)
            d2 = own[:, None] + (lift**2)[:, None] + norms - 2 * (x @ pivots[:, :-1].T + np.outer(lift, pivots[:, -1]))
            cell = d2.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(np.maximum(0, d2[np.arange(n), cell])))],
                names=["id", "vec", "cell", "dist"],
            )

    return df.mapInArrow(run, "id long, vec binary, cell int, dist double")


def _bounds(pivots, cells, near, qcells, k: int, block: int):
    """Query groups and, for each data cell, the (group, least pivot distance) pairs that need it."""
    n = len(pivots)
    gap = np.sqrt(np.maximum(0, ((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(2)))
    slack = 1e-7 * (1 + gap.max(initial=0) + max((r for _, r in cells.values()), default=0) + max((r for _, r in qcells.values()), default=0))
    theta = {}
    for i, (_, reach) in qcells.items():
        ub = sorted(reach + gap[i, j] + d for j, ds in near.items() for d in ds)
        theta[i] = ub[k] if len(ub) > k else math.inf  # one of the nearest may be the query itself
    groups, room = [], 0
    for i in sorted(qcells, key=lambda c: (gap[0, c], c)):
        if not groups or room + qcells[i][0] > block:
            groups.append([])
            room = 0
        groups[-1].append(i)
        room += qcells[i][0]
    need = {j: [] for j in cells}
    for g, members in enumerate(groups):
        for j, (_, radius) in cells.items():
            wanted = [gap[i, j] - qcells[i][1] - theta[i] - slack for i in members if gap[i, j] - qcells[i][1] - radius <= theta[i] + slack]
            if wanted:
                need[j].append((g, float(max(0.0, min(wanted)))))
    assert n or not cells
    return groups, need


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids; -inf never counts."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= floor)
    else:
        pick = np.arange(len(scores))
    pick = pick[np.lexsort((ids[pick], -scores[pick]))]
    return pick[scores[pick] > -np.inf][:k]


def search(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None, query_block: int = 2048, data_block: int = 20000) -> DataFrame:
    """Each query's k best rows: (query_id, rank, vec_id, score).

    data and queries are (id, vec array<double> of whole numbers), as quantise() gives.
    """
    spark = data.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sq = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    total, dim, top = data.agg(F.count("*"), F.max(F.size("vec")), F.max(sq)).first()
    if not total:
        return empty
    q_total, q_dim, q_top = (queries := queries.groupBy("id").agg(F.min("vec").alias("vec"))).agg(F.count("*"), F.max(F.size("vec")), F.max(sq)).first()
    if not q_total:
        return empty
    dim = max(1, dim, q_dim)
    exact = max(top, q_top) < _EXACT
    pivots = pivots or min(1024, max(64, math.isqrt(total) // 4))
    seeds = data.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    flat = np.zeros((len(seeds), dim + 1))
    for i, r in enumerate(seeds):
        flat[i, : len(r["vec"])] = r["vec"]
    flat[:, -1] = np.sqrt(np.maximum(0, top - (flat**2).sum(1)))
    flat = np.unique(flat, axis=0)

    placed = common.stage(_place(data.select("id", "vec"), flat, dim, top), "knn-data")
    asked = common.stage(_place(queries.select("id", "vec"), flat, dim, None), "knn-queries")
    cells = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    qcells = {r["cell"]: (r["n"], r["r"]) for r in asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    near: dict[int, list[float]] = {}
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    for r in placed.select("cell", "dist").withColumn("nth", nth).filter(F.col("nth") <= k + 1).collect():
        near.setdefault(r["cell"], []).append(r["dist"])
    groups, need = _bounds(flat, cells, near, qcells, k, query_block)
    load = [sum(cells[j][0] for j in need if any(g == h for h, _ in need[j])) for g in range(len(groups))]
    salts = [max(1, math.ceil(n / data_block)) for n in load]
    parts = [max(1, math.ceil(sum(qcells[i][0] for i in m) / query_block)) for m in groups]

    plan = spark.createDataFrame(
        [(int(j), g, least, salts[g], parts[g]) for j, wanted in need.items() for g, least in wanted], "cell int, grp int, least double, salts int, parts int"
    )
    routed = (
        placed.join(F.broadcast(plan), "cell").filter("dist >= least")
        .select("id", "vec", "grp", (F.pmod(F.xxhash64("id"), F.col("salts"))).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    )
    where = spark.createDataFrame([(int(i), g, salts[g], parts[g]) for g, m in enumerate(groups) for i in m], "cell int, grp int, salts int, parts int")
    spread = (
        asked.join(F.broadcast(where), "cell")
        .select("id", "vec", "grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    )

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(d):
            qm, dm = _matrix(list(q["vec"]), dim), _matrix(list(d["vec"]), dim)
            qid, did = q["id"].to_numpy(), d["id"].to_numpy()
            if not exact:
                whole = lambda m: [np.array([int(v) for v in r], object) for r in m]
                candidates = whole(dm)
                for own, x in zip(qid, whole(qm)):
                    best = heapq.nsmallest(k, ((-np.dot(y, x), p) for y, p in zip(candidates, did.tolist()) if p != own))
                    rows += [(own, p, -score) for score, p in best]
                return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])
            for at in range(0, len(qid), 128):
                scores = qm[at : at + 128] @ dm.T
                for i, own in enumerate(qid[at : at + 128]):
                    row = scores[i]
                    row[did == own] = -np.inf
                    for p in _best(row, did, k):
                        rows.append((own, did[p], int(scores[i][p])))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    keys = ["grp", "part", "salt"]
    local = spread.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(spark, sf_dir: str) -> DataFrame:
    data = quantise(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(data, data.filter(F.col("id") % 50 == 0))


OP2_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
