"""Polygons as nested arrays, and exact predicates over their edges as Columns.

A geometry is part -> ring -> vertex; a part's first ring is its shell, the others are
holes. Rings may be open or closed. Edges of all rings together decide containment by
even-odd parity, which equals "in a shell and in none of its holes" for valid geometry.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
EDGES = "array<struct<ax:double,ay:double,bx:double,by:double>>"
INF = float("inf")


def as_parts(geometry) -> list[list[list[tuple[float, float]]]]:
    """Python geometry to parts: a ring of (x, y), a list of rings, a list of parts, or WKB bytes."""
    if isinstance(geometry, (bytes, bytearray, memoryview)):
        from gridloom.functions import wkb

        return wkb.decode_polygon(bytes(geometry))

    def depth(g) -> int:
        d = 0
        while isinstance(g, (list, tuple)) and len(g):
            g, d = g[0], d + 1
        return d

    d = depth(geometry)
    if d == 2:
        geometry = [[geometry]]
    elif d == 3:
        geometry = [geometry]
    elif d != 4:
        raise TypeError("a polygon is a ring of (x, y) pairs, a list of rings or a list of parts")
    return [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in geometry]


def box(x0: float, y0: float, x1: float, y1: float) -> list:
    return [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]]


def edges_of_parts(parts, shells_only: bool = False) -> list[dict]:
    return [
        {"ax": a[0], "ay": a[1], "bx": b[0], "by": b[1]}
        for part in parts for ring in (part[:1] if shells_only else part) for a, b in zip(ring, [*ring[1:], ring[0]])
    ]


def literal_edges(parts, shells_only: bool = False) -> Column:
    """Edges of a constant polygon; folded to one literal by the optimizer."""
    return F.from_json(F.lit(json.dumps(edges_of_parts(parts, shells_only))), EDGES)


def bounds_of(parts) -> tuple[float, float, float, float]:
    xs = [x for part in parts for ring in part[:1] for x, _ in ring]
    ys = [y for part in parts for ring in part[:1] for _, y in ring]
    return min(xs), min(ys), max(xs), max(ys)


def _ring_edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def edges(geometry: Column) -> Column:
    return F.flatten(F.transform(F.flatten(geometry), _ring_edges))


def shell_edges(geometry: Column) -> Column:
    return F.flatten(F.transform(geometry, lambda part: _ring_edges(part[0])))


def bounds(geometry: Column) -> Column:
    """Box of the shells as a struct."""
    points = F.flatten(F.transform(geometry, lambda part: part[0]))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def is_rectangle(geometry: Column) -> Column:
    """One part, one ring of four corners (or five, closed) that goes around an upright box of some size."""
    ring = geometry[0][0]
    n = F.size(ring)
    p = [ring[i] for i in range(4)]
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    meets = lambda c, a, b: (c["x"] == a["x"]) & (c["y"] == b["y"])
    around = (meets(p[1], p[2], p[0]) & meets(p[3], p[0], p[2])) | (meets(p[1], p[0], p[2]) & meets(p[3], p[2], p[0]))
    closed = F.when(n == 5, same(F.try_element_at(ring, F.lit(5)), p[0])).otherwise(n == 4)
    single = (F.size(geometry) == 1) & (F.size(geometry[0]) == 1) & n.isin(4, 5)
    whole = F.when(single, closed & (p[0]["x"] != p[2]["x"]) & (p[0]["y"] != p[2]["y"]) & around)
    return F.coalesce(whole, F.lit(False))


def rectangle_bounds(geometry: Column) -> Column:
    """bounds() of a rectangle."""
    a, b = geometry[0][0][0], geometry[0][0][2]
    return F.struct(F.least(a["x"], b["x"]).alias("x0"), F.least(a["y"], b["y"]).alias("y0"), F.greatest(a["x"], b["x"]).alias("x1"), F.greatest(a["y"], b["y"]).alias("y1"))


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether the edge crosses the ray to the right of the point; null if it is level."""
    rise = F.nullif(e["by"] - e["ay"], F.lit(0.0))
    return ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / rise + e["ax"])


def contains(all_edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test: left and bottom borders are in, right and top ones out."""
    return F.aggregate(all_edges, F.lit(False), lambda odd, e: odd != F.coalesce(crosses(e, x, y), F.lit(False)))


def edge_distance_squared(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    along = F.coalesce(((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    px, py = x - (e["ax"] + t * dx), y - (e["ay"] + t * dy)
    return px * px + py * py


def distance(all_edges: Column, x: Column, y: Column) -> Column:
    """0 inside, else the distance to the nearest edge of any ring."""
    nearest = F.aggregate(all_edges, F.lit(INF), lambda best, e: F.least(best, edge_distance_squared(e, x, y)), F.sqrt)
    return F.when(contains(all_edges, x, y), 0.0).otherwise(nearest)


def box_distance(b: Column, x: Column, y: Column) -> Column:
    dx = F.greatest(b["x0"] - x, x - b["x1"], F.lit(0.0))
    dy = F.greatest(b["y0"] - y, y - b["y1"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def meets_box(shells: Column, b: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Shells touch a box: a vertex in it, a corner of it inside, or an edge that crosses its border; holes are ignored."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    overlap = (b["x0"] <= x1) & (b["x1"] >= x0) & (b["y0"] <= y1) & (b["y1"] >= y0)
    vertex = F.exists(shells, lambda e: e["ax"].between(x0, x1) & e["ay"].between(y0, y1))
    inside = contains(shells, F.lit(float(corners[0][0])), F.lit(float(corners[0][1])))
    for cx, cy in corners[1:]:
        inside = inside | contains(shells, F.lit(float(cx)), F.lit(float(cy)))

    def crosses(e: Column) -> Column:
        hit = F.lit(False)
        for (cx, cy), (dx, dy) in zip(corners, [*corners[1:], corners[0]]):
            rx, ry, sx, sy = e["bx"] - e["ax"], e["by"] - e["ay"], dx - cx, dy - cy
            det = F.nullif(rx * sy - ry * sx, F.lit(0.0))
            t = ((cx - e["ax"]) * sy - (cy - e["ay"]) * sx) / det
            u = ((cx - e["ax"]) * ry - (cy - e["ay"]) * rx) / det
            hit = hit | F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))
        return hit

    return overlap & (vertex | inside | F.exists(shells, crosses))


def area(geometry: Column) -> Column:
    """Unsigned area: shells less holes, summed over the parts."""

    def ring_area(ring: Column) -> Column:
        return F.abs(F.aggregate(_ring_edges(ring), F.lit(0.0), lambda s, e: s + (e["ax"] * e["by"] - e["bx"] * e["ay"]))) / 2

    def part_area(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda s, r: s + ring_area(r)) * -1 + 2 * ring_area(part[0])

    return F.aggregate(geometry, F.lit(0.0), lambda s, p: s + part_area(p))
