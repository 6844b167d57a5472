"""Point frames from arrays and tables held by the caller."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.frame import SpatialFrame


def from_coords(spark: SparkSession, xs, ys, **options) -> SpatialFrame:
    """Points of two sequences of one length; ids number them."""
    xs, ys = np.asarray(xs, float), np.asarray(ys, float)
    if xs.shape != ys.shape or xs.ndim != 1:
        raise ValueError("xs and ys must be sequences of one length")
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(xs)), "x": xs, "y": ys}), "id long, x double, y double")
    return SpatialFrame(df, "x", "y", **options)


def from_geometries(spark: SparkSession, geometries, **options) -> SpatialFrame:
    """Points of an (n, 2) array, pairs, an Arrow struct or fixed-size list, or WKB values."""
    if isinstance(geometries, (pa.ChunkedArray, pa.Array)):
        arr = geometries.combine_chunks() if isinstance(geometries, pa.ChunkedArray) else geometries
        if pa.types.is_struct(arr.type):
            return from_coords(spark, arr.field("x").to_numpy(zero_copy_only=False), arr.field("y").to_numpy(zero_copy_only=False), **options)
        if pa.types.is_fixed_size_list(arr.type):
            flat = arr.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
            return from_coords(spark, flat[:, 0], flat[:, 1], **options)
        geometries = arr.to_pylist()
    values = list(geometries)
    if values and isinstance(values[0], (bytes, bytearray)):
        df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "id long, wkb binary")
        return SpatialFrame.from_wkb_points(df, "wkb", **options)
    points = np.asarray(values, float).reshape(-1, 2)
    return from_coords(spark, points[:, 0], points[:, 1], **options)


def from_xy_column(df: DataFrame, column: str, **options) -> SpatialFrame:
    """Points of a struct<x, y> or array<double> column, taken apart to x and y."""
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    x, y = (c["x"], c["y"]) if isinstance(kind, T.StructType) else (c[0], c[1])
    return SpatialFrame(df.withColumns({"x": x.cast("double"), "y": y.cast("double")}), "x", "y", **options)
