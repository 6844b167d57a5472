"""Numeric kernels that Columns cannot express: polygon overlap, intersection tests and hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hull_area(xs, ys) -> float:
    """Area of the convex hull (monotone chain); 0 for fewer than three distinct points."""
    pts = sorted({(float(x), float(y)) for x, y in zip(xs, ys) if x is not None and y is not None and x == x and y == y})
    if len(pts) < 3:
        return 0.0

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]]))) / 2


def _inside(edges: np.ndarray, x: float, y: float) -> bool:
    up = (edges[:, 1] > y) != (edges[:, 3] > y)
    e = edges[up]
    return bool(((e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0] > x).sum() % 2) if len(e) else False


def _crossings(a: np.ndarray, b: np.ndarray):
    """Parameters along a's edges at which b's edges meet them, and which edges meet at all (closed test)."""
    p, r = a[:, None, :2], (a[:, 2:] - a[:, :2])[:, None]
    q, s = b[None, :, :2], (b[:, 2:] - b[:, :2])[None]
    det = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    d = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / det
        u = (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / det
    proper = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    line = (det == 0) & (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0] == 0)
    overlap = np.ones(det.shape, bool)
    for k in (0, 1):
        lo_a, hi_a = np.minimum(a[:, k], a[:, k + 2])[:, None], np.maximum(a[:, k], a[:, k + 2])[:, None]
        lo_b, hi_b = np.minimum(b[:, k], b[:, k + 2])[None], np.maximum(b[:, k], b[:, k + 2])[None]
        overlap &= (lo_a <= hi_b) & (lo_b <= hi_a)
    return t, proper, proper | (line & overlap)


def intersects(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two polygons (edges as rows ax, ay, bx, by) meet, borders included."""
    if _crossings(a, b)[2].any():
        return True
    return _inside(b, a[0, 0], a[0, 1]) or _inside(a, b[0, 0], b[0, 1])


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection by a slab sweep: between neighbouring event heights no edges
    cross, so the overlap's width is linear and its area is width at mid-height x height."""
    t, proper, _ = _crossings(a, b)
    i, j = np.nonzero(proper)
    cross = a[i, 1] + t[i, j] * (a[i, 3] - a[i, 1])
    levels = np.unique(np.concatenate((a[:, 1], b[:, 1], cross)))
    lo, hi = max(a[:, [1, 3]].min(), b[:, [1, 3]].min()), min(a[:, [1, 3]].max(), b[:, [1, 3]].max())
    levels = levels[(levels >= lo) & (levels <= hi)]
    total = 0.0
    for y0, y1 in zip(levels[:-1], levels[1:]):
        y = (y0 + y1) / 2
        marks = []
        for which, e in enumerate((a, b)):
            cut = e[(e[:, 1] > y) != (e[:, 3] > y)]
            xs = np.sort((cut[:, 2] - cut[:, 0]) * (y - cut[:, 1]) / (cut[:, 3] - cut[:, 1]) + cut[:, 0])
            marks += [(x, which) for x in xs]
        on, last = [False, False], 0.0
        for x, which in sorted(marks):
            if on[0] and on[1]:
                total += (x - last) * (y1 - y0)
            on[which] = not on[which]
            last = x
    return float(total)


def edge_array(edges) -> np.ndarray:
    return np.array([(e["ax"], e["ay"], e["bx"], e["by"]) for e in edges], float).reshape(-1, 4)


def _relate(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    meets, area = [], []
    for x, y in zip(a, b):
        p, q = edge_array(x), edge_array(y)
        hit = intersects(p, q)
        meets.append(hit)
        area.append(overlap_area(p, q) if hit else 0.0)
    return pd.DataFrame({"meets": meets, "overlap": area})


def relate(edges_a: Column, edges_b: Column) -> Column:
    """struct(meets, overlap) of two polygons given by their edges."""
    return F.pandas_udf(_relate, "struct<meets:boolean,overlap:double>")(edges_a, edges_b)


def _hull(points: pd.Series) -> pd.Series:
    return pd.Series([hull_area([p["x"] for p in row], [p["y"] for p in row]) for row in points], dtype=float)


def convex_hull_area(points: Column) -> Column:
    """Hull area of an array of struct<x, y>."""
    return F.pandas_udf(_hull, "double")(points)
