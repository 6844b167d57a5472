"""Stateless joins of a stream of points with a static frame, and incremental append.

The static side's extent is read once, when the query is built; the stream side is never
counted. Containment and distance joins keep no state. Nearest neighbours need all targets
of a micro-batch's probes at once and run per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.staging import staged
from gridloom.plans.frame import GEOM, SpatialFrame


def within_join(stream: DataFrame, x: str, y: str, zones: SpatialFrame) -> DataFrame:
    return zones.lazy().within_join(stream, x, y).to_df()


def within_distance_join(stream: DataFrame, x: str, y: str, points: SpatialFrame, distance: float) -> DataFrame:
    return points.lazy().within_distance_join(stream, x, y, distance).to_df()


def polygon_within_distance_join(stream: DataFrame, x: str, y: str, zones: SpatialFrame, distance: float) -> DataFrame:
    return zones.lazy().polygon_within_distance_join(stream, x, y, distance).to_df()


def each_batch_knn(target: SpatialFrame, x: str, y: str, k: int, sink: Callable[[DataFrame, int], None], tie: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that joins each micro-batch with its k nearest targets."""

    def run(batch: DataFrame, number: int) -> None:
        plan = target.lazy()
        out = plan.knn_join(batch, x, y, k, tie=tie) if target.kind == "point" else plan.polygon_knn_join(batch, x, y, k, tie=tie)
        sink(out.to_df(), number)

    return run


def windowed_zone_counts(stream: DataFrame, ts: str, x: str, y: str, zones: SpatialFrame, zone_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Points per zone and tumbling window, with a watermark for late rows.

    The state holds a row for each window and distinct geometry, which becomes rows of zones only as it
    leaves the aggregate; zones of several geometries are counted by themselves.
    """
    shapes, members = zones.distinct_shapes("_one")
    held = members.groupBy("_one", F.col(f"`{zone_col}`").alias("_zone")).agg(F.count("*").alias("_w"))
    several = F.count("*").over(Window.partitionBy("_zone")) > 1
    held = staged(held.withColumn("_several", several), "zones")
    alone = held.filter("not _several").select("_one", F.col("_zone").alias("_own"), F.col("_w").alias("_times"))
    own = shapes._df.join(alone, "_one", "left_semi").select(GEOM, "_one", F.lit(None).cast(held.schema["_zone"].dataType).alias("_zone"), F.lit(1).cast("long").alias("_w"))
    counted = own.unionByName(shapes._df.join(held.filter("_several"), "_one").select(GEOM, F.lit(None).cast("long").alias("_one"), "_zone", "_w"))
    met = within_join(stream.withWatermark(ts, late), x, y, SpatialFrame._make(counted, "polygon", geom_col=GEOM, hidden=(GEOM,)))
    counts = met.groupBy(F.window(F.col(ts), window).alias("window"), "_one", "_zone").agg(F.sum("_w").alias("n"))
    zone = F.when(F.col("_one").isNull(), F.col("_zone")).otherwise(F.col("_own"))
    return counts.join(alone, "_one", "left").select("window", zone.alias(zone_col), (F.col("n") * F.coalesce("_times", F.lit(1))).alias("n"))
