"""Point distances and search boxes as Columns."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the great-circle model: mean Earth radius in metres, metres per degree of a
# great circle (less than the radius gives, so that search boxes never fall short), and the
# latitude beyond which a search box spans all longitudes.
EARTH_RADIUS = 6371008.8
METRES_PER_LAT = 110574.0
METRES_PER_LON = METRES_PER_LAT
POLAR_LAT = 89.9

SYSTEMS = ("planar", "geographic")


class CoordinateWarning(UserWarning):
    """Coordinates lie outside the longitude and latitude range."""


def resolve_system(name: str | None) -> str:
    if name is None:
        return "planar"
    if name not in SYSTEMS:
        raise ValueError(f"coordinate_system must be one of {SYSTEMS}, not {name!r}")
    return name


def warn_out_of_range(df: DataFrame, x: Column, y: Column) -> None:
    """Warn if any longitude or latitude is out of range; runs one aggregate job."""
    bad = df.filter((F.abs(x) > 180) | (F.abs(y) > 90)).limit(1)
    if not bad.isEmpty():
        warnings.warn("coordinates outside longitude/latitude ranges in geographic mode", CoordinateWarning, stacklevel=3)


def _num(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def planar(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(_num, (x1, y1, x2, y2))
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = (F.radians(_num(v)) for v in (lon1, lat1, lon2, lat2))
    s_lat, s_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    a = s_lat * s_lat + F.cos(lat1) * F.cos(lat2) * s_lon * s_lon
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def point_distance(x1, y1, x2, y2, coordinate_system: str | None = None) -> Column:
    """Distance of two points, row by row: coordinate units (planar) or metres (geographic)."""
    return (haversine if resolve_system(coordinate_system) == "geographic" else planar)(x1, y1, x2, y2)


def distance_to_point(x, y, cx: float, cy: float, coordinate_system: str | None = None) -> Column:
    """Distance of a point column to one fixed centre."""
    return point_distance(x, y, cx, cy, coordinate_system)


def in_range(lon: Column, lat: Column) -> Column:
    return lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0)


def wrapped(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The same place with its longitude and latitude in range; those beyond it count around the globe."""
    turn = F.pmod(lat + 90, F.lit(360.0))
    over = turn > 180
    east = F.pmod(F.when(over, lon + 360).otherwise(lon + 180), F.lit(360.0)) - 180
    ok = in_range(lon, lat)
    return F.when(ok, lon).otherwise(east), F.when(ok, lat).otherwise(F.when(over, 270 - turn).otherwise(turn - 90))


def unit_vector(lon: Column, lat: Column, name: str) -> dict[str, Column]:
    """Columns name0 to name2: the place on a globe of radius 1."""
    a, b = F.radians(lon), F.radians(lat)
    return {f"{name}0": F.cos(b) * F.cos(a), f"{name}1": F.cos(b) * F.sin(a), f"{name}2": F.sin(b)}


def chord_squared(one: str, other: str) -> Column:
    d = [F.col(f"{one}{i}") - F.col(f"{other}{i}") for i in range(3)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def longest_chord_squared(d: float) -> float:
    """No less than chord_squared of two places at most d metres apart, as rounded."""
    half = d / EARTH_RADIUS / 2
    return 5.0 if half >= math.pi / 2 else 4 * math.sin(max(0.0, half)) ** 2 * (1 + 1e-9) + 1e-12


def search_box(x: Column, y: Column, d, system: str) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y) that holds everything within d of (x, y); geographic: everything in range."""
    d = _num(d)
    if system == "planar":
        return x - d, y - d, x + d, y + d
    lat_reach = d / METRES_PER_LAT
    far_lat = F.least(F.lit(90.0), F.abs(y) + lat_reach)
    lon_reach = d / (F.lit(METRES_PER_LON) * F.cos(F.radians(far_lat)))
    wide = (far_lat >= POLAR_LAT) | (x - lon_reach < -180) | (x + lon_reach > 180)
    return F.when(wide, -180.0).otherwise(x - lon_reach), y - lat_reach, F.when(wide, 180.0).otherwise(x + lon_reach), y + lat_reach


def fixed_search_box(cx: float, cy: float, d: float, system: str) -> tuple[float, float, float, float]:
    """search_box of constants, as numbers, so that comparisons reach the Parquet scan."""
    if system == "planar":
        return cx - d, cy - d, cx + d, cy + d
    lat_reach = d / METRES_PER_LAT
    far_lat = min(90.0, abs(cy) + lat_reach)
    lon_reach = d / (METRES_PER_LON * max(1e-12, math.cos(math.radians(far_lat))))
    if far_lat >= POLAR_LAT or cx - lon_reach < -180 or cx + lon_reach > 180:
        return -180.0, cy - lat_reach, 180.0, cy + lat_reach
    return cx - lon_reach, cy - lat_reach, cx + lon_reach, cy + lat_reach
