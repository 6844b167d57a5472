"""Geometry functions for SQL text: temporary SQL functions, which Spark inlines into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.functions.distance import EARTH_RADIUS
from gridloom.functions.geometry import EDGES, GEOMETRY

#: name, parameters, type and body; later bodies may use earlier functions.
FUNCTIONS = [
    ("gl_distance", "ax double, ay double, bx double, by double", "double", "sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))"),
    ("gl_great_circle", "lon1 double, lat1 double, lon2 double, lat2 double", "double",
     f"2 * {EARTH_RADIUS}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    ("gl_in_box", "x double, y double, x0 double, y0 double, x1 double, y1 double", "boolean", "x between x0 and x1 and y between y0 and y1"),
    ("gl_edges", f"g {GEOMETRY}", EDGES,
     "flatten(transform(flatten(g), r -> zip_with(r, concat(slice(r, 2, size(r)), slice(r, 1, 1)), (a, b) -> named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y))))"),
    ("gl_contains", f"g {GEOMETRY}, px double, py double", "boolean",
     "aggregate(gl_edges(g), false, (odd, e) -> odd <> coalesce((e.ay > py) <> (e.by > py) and px < (e.bx - e.ax) * (py - e.ay) / nullif(e.by - e.ay, 0D) + e.ax, false))"),
    ("gl_area", f"g {GEOMETRY}", "double",
     "aggregate(transform(g, p -> transform(p, r -> abs(aggregate(zip_with(r, concat(slice(r, 2, size(r)), slice(r, 1, 1)), (a, b) -> a.x * b.y - b.x * a.y), 0D, (s, v) -> s + v)) / 2)), 0D, (s, rings) -> s + 2 * rings[0] - aggregate(rings, 0D, (t, v) -> t + v))"),
]


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session, replacing older ones; returns their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    return [f[0] for f in FUNCTIONS]
