"""gridloom: 2-D vector spatial analytics expressed as Spark DataFrame plans."""

from gridloom.functions.distance import CoordinateWarning, distance_to_point, point_distance
from gridloom.functions.kernels import convex_hull_area
from gridloom.functions.wkb import point_distance as wkb_point_distance
from gridloom.functions.wkb import points_to_xy as wkb_points_to_xy
from gridloom.operators import aggregates as agg
from gridloom.plans.frame import SpatialFrame, SpatialGroups, SpatialPlan

__all__ = [
    "CoordinateWarning", "SpatialFrame", "SpatialGroups", "SpatialPlan", "agg", "convex_hull_area",
    "distance_to_point", "point_distance", "wkb_point_distance", "wkb_points_to_xy",
]
