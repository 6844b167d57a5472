"""Well-known binary: points, polygons and multipolygons, ISO and extended variants."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.geometry import GEOMETRY


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, fmt: str):
        size = struct.calcsize(fmt)
        if self.at + size > len(self.raw):
            raise ValueError("truncated WKB")
        out = struct.unpack_from(fmt, self.raw, self.at)
        self.at += size
        return out

    def header(self) -> tuple[str, int, int]:
        """Byte order, geometry type, coordinates per point."""
        (order,) = self.take("<B")
        if order > 1:
            raise ValueError(f"unknown WKB byte order {order}")
        end = "<" if order else ">"
        (code,) = self.take(end + "I")
        extra = 0
        if code & 0xE0000000:  # extended: flags for Z, M and a reference system
            extra = bool(code & 0x80000000) + bool(code & 0x40000000)
            if code & 0x20000000:
                self.take(end + "I")
            code &= 0x1FFFFFFF
        if code >= 1000:  # ISO: 1000 Z, 2000 M, 3000 ZM
            extra = 2 if code >= 3000 else 1
            code %= 1000
        return end, code, 2 + extra

    def ring(self, end: str, width: int) -> list[tuple[float, float]]:
        (n,) = self.take(end + "I")
        if self.at + 8 * n * width > len(self.raw):
            raise ValueError("truncated WKB")
        values = np.frombuffer(self.raw, end + "f8", n * width, self.at).reshape(n, width)
        self.at += 8 * n * width
        points = [(float(x), float(y)) for x, y in values[:, :2]]
        return points[:-1] if len(points) > 1 and points[0] == points[-1] else points

    def polygon(self) -> list:
        end, code, width = self.header()
        if code != 3:
            raise ValueError(f"WKB type {code} is not a polygon")
        return [self.ring(end, width) for _ in range(self.take(end + "I")[0])]


def decode_point(raw: bytes) -> tuple[float, float]:
    r = _Reader(raw)
    end, code, width = r.header()
    if code != 1:
        raise ValueError(f"WKB type {code} is not a point")
    return r.take(end + "d" * width)[:2]


def decode_polygon(raw: bytes) -> list:
    """Parts of a polygon or multipolygon; closing vertices are left out."""
    r = _Reader(raw)
    end, code, width = r.header()
    if code == 3:
        return [[r.ring(end, width) for _ in range(r.take(end + "I")[0])]]
    if code == 6:
        return [r.polygon() for _ in range(r.take(end + "I")[0])]
    raise ValueError(f"WKB type {code} is not a polygon or multipolygon")


def encode_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def encode_polygon(parts) -> bytes:
    def one(part) -> bytes:
        out = struct.pack("<BII", 1, 3, len(part))
        for ring in part:
            closed = [*ring, ring[0]]
            out += struct.pack("<I", len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed)
        return out

    return one(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(one, parts))


def _points(col: pd.Series) -> pd.DataFrame:
    out = np.full((len(col), 2), np.nan)
    plain = [i for i, v in enumerate(col) if v is not None and len(v) == 21 and bytes(v[:5]) == b"\x01\x01\x00\x00\x00"]
    if plain:
        joined = np.frombuffer(b"".join(bytes(col.iloc[i]) for i in plain), np.uint8).reshape(-1, 21)
        out[plain] = np.ascontiguousarray(joined[:, 5:]).view("<f8")
    quick = set(plain)
    for i, v in enumerate(col):
        if v is not None and i not in quick:
            try:
                out[i] = decode_point(bytes(v))
            except ValueError as e:
                raise ValueError(f"row {i} of the batch: {e}") from None
    return pd.DataFrame({"x": out[:, 0], "y": out[:, 1]})


def _polygons(col: pd.Series) -> pd.Series:
    out = []
    for i, v in enumerate(col):
        try:
            out.append(None if v is None else [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in decode_polygon(bytes(v))])
        except ValueError as e:
            raise ValueError(f"row {i} of the batch: {e}") from None
    return pd.Series(out, dtype=object)


def points_to_xy(col: Column) -> tuple[Column, Column]:
    """(x, y) of WKB points; null where the WKB is null or empty."""
    xy = F.pandas_udf(_points, "struct<x:double,y:double>")(col)
    clean = lambda v: F.when(~F.isnan(v), v)
    return clean(xy["x"]), clean(xy["y"])


def polygons(col: Column) -> Column:
    return F.pandas_udf(_polygons, GEOMETRY)(col)


def point_distance(a: Column, b: Column) -> Column:
    """Planar distance of two WKB point columns."""
    from gridloom.functions.distance import planar

    return planar(*points_to_xy(a), *points_to_xy(b))


def _make_points(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([encode_point(a, b) for a, b in zip(x, y)], dtype=object)


def _make_polygons(geometry: pd.Series) -> pd.Series:
    shape = lambda text: [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in json.loads(text)]
    return pd.Series([None if g is None else encode_polygon(shape(g)) for g in geometry], dtype=object)


def make_points(x: Column, y: Column) -> Column:
    return F.pandas_udf(_make_points, "binary")(x, y)


def make_polygons(geometry: Column) -> Column:
    return F.pandas_udf(_make_polygons, "binary")(F.to_json(geometry))  # nested arrays of uneven length travel as text
