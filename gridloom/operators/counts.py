"""Points within a distance of each rectangle, counted tile by tile without forming the pairs.

Points and rectangles are dealt to square tiles. In a tile the points are sorted by strips and x: for each
strip a rectangle's certain points are counted by binary search, and only those near its border are measured.
Time goes with the rectangles and their borders, not with the points inside them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.boxjoin import Extent, cell

#: Tiles of the extent along one axis, at most; points of a tile that one task holds, about; pairs measured at once.
TILES, TILE_POINTS, AT_ONCE = 64, 2_000_000, 1 << 20


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and members of the ranges lo to hi."""
    n = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + lo[owner]


def count_tile(px: np.ndarray, py: np.ndarray, boxes: np.ndarray, d: float) -> np.ndarray:
    """For each box (x0, y0, x1, y1) the points at most d away, each measured as geometry.box_distance does."""
    out = np.zeros(len(boxes), np.int64)
    if not len(px) or not len(boxes):
        return out
    left, low = px.min(), py.min()
    height = (py.max() - low) / max(1, math.isqrt(len(px)) // 2) or 1.0
    strip = np.floor((py - low) / height).astype(np.int64)
    last, width = int(strip.max()), px.max() - left
    stride = 2.0 ** math.ceil(math.log2(width + 1.0)) * 4
    key = strip * stride + (px - left)
    order = np.argsort(key, kind="stable")
    key, px, py = key[order], px[order], py[order]
    slack = 1e-9 * max(1.0, stride * (last + 1), abs(left), abs(low), *np.abs(boxes[:, [0, 2]]).max(axis=0))
    first = np.clip(np.floor((boxes[:, 1] - d - slack - low) / height), 0, last + 1).astype(np.int64)
    final = np.clip(np.floor((boxes[:, 3] + d + slack - low) / height), -1, last).astype(np.int64)
    who, at = _ranges(first, final + 1)
    for a in range(0, len(who), AT_ONCE // 4):
        b, s = who[a : a + AT_ONCE // 4], at[a : a + AT_ONCE // 4]
        x0, y0, x1, y1 = boxes[b].T
        bottom, top = low + s * height - slack, low + (s + 1) * height + slack
        far, near = np.maximum(np.maximum(y0 - bottom, top - y1), 0), np.maximum(np.maximum(y0 - top, bottom - y1), 0)
        wide = np.sqrt(np.maximum(d * d - near * near, 0)) + slack
        sure = np.where(far <= d, np.sqrt(np.maximum(d * d - far * far, 0)) - slack, -math.inf)
        find = lambda x, side: np.searchsorted(key, s * stride + np.clip(x - left, -stride / 4, stride / 4 + width), side)
        o0, o1 = find(x0 - wide, "left"), find(x1 + wide, "right")
        i0, i1 = find(np.where(sure > -math.inf, x0 - sure, math.inf), "left"), find(np.where(sure > -math.inf, x1 + sure, -math.inf), "right")
        i0, i1 = np.clip(i0, o0, o1), np.clip(i1, o0, o1)
        i1 = np.maximum(i0, i1)
        out += np.bincount(b, i1 - i0, len(out)).astype(np.int64)
        for lo, hi in ((o0, i0), (i1, o1)):
            # a few border points at a time
            ends = np.cumsum(hi - lo)
            for c in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
                take = slice(np.searchsorted(ends, c, "right"), np.searchsorted(ends, c + AT_ONCE, "left") + 1)
                start = ends[take] - (hi - lo)[take]
                owner, p = _ranges(lo[take] + np.maximum(c - start, 0), np.minimum(hi[take], lo[take] + np.maximum(c + AT_ONCE - start, 0)))
                k = b[take][owner]
                q = boxes[k]
                dx = np.maximum(np.maximum(q[:, 0] - px[p], px[p] - q[:, 2]), 0.0)
                dy = np.maximum(np.maximum(q[:, 1] - py[p], py[p] - q[:, 3]), 0.0)
                out += np.bincount(k[np.sqrt(dx * dx + dy * dy) <= d], minlength=len(out))
    return out


def count_within(points: DataFrame, boxes: DataFrame, extent: Extent, d: float) -> DataFrame:
    """points (_qx, _qy), boxes (_tid, x0, y0, x1, y1) of this extent, reach included: _tid with _n, where it is over 0."""
    total, level = 0, min(extent.levels)
    for v in sorted(extent.levels):
        level, total = v, total + extent.levels[v]
        if total >= 0.99 * extent.rows:
            break
    side = max(extent.x1 - extent.x0, extent.y1 - extent.y0)
    level = F.lit(max(level, math.ceil(math.log2(side / TILES)) if side > 0 else level))
    near = points.filter(F.col("_qx").between(extent.x0, extent.x1) & F.col("_qy").between(extent.y0, extent.y1))
    dealt = near.select("_qx", "_qy", cell(F.col("_qx"), level).alias("_cx"), cell(F.col("_qy"), level).alias("_cy"))
    most = dealt.groupBy("_cx", "_cy").count().agg(F.max("count")).first()[0] or 0
    shares = max(1, math.ceil(most / TILE_POINTS))
    dealt = dealt.withColumn("_share", F.pmod(F.xxhash64("_qx", "_qy"), F.lit(shares)))
    span = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo) - d, level), cell(F.col(hi) + d, level)))
    held = boxes.withColumn("_cx", span("x0", "x1")).withColumn("_cy", span("y0", "y1")).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))

    def count(p: pa.Table, b: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy()
        n = count_tile(column(p, "_qx"), column(p, "_qy"), np.column_stack([column(b, c) for c in ("x0", "y0", "x1", "y1")]).astype(float), d)
        return pa.table({"_tid": column(b, "_tid")[n > 0], "_n": n[n > 0]})

    key = ["_cx", "_cy", "_share"]
    parts = max(64, 4 * points.sparkSession.sparkContext.defaultParallelism)
    tiles = dealt.repartition(parts, *key).groupBy(*key).cogroup(held.repartition(parts, *key).groupBy(*key))
    return tiles.applyInArrow(count, "_tid long, _n long").groupBy("_tid").agg(F.sum("_n").alias("_n"))
