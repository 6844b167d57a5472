"""Box-overlap join on a hierarchy of power-of-two grids.

Each box belongs to the level whose cells are at least as wide as the box, so it covers at
most two cells per axis. A pair of boxes meets on the coarser of its two levels: for every
level of the other side a box is keyed once, on the coarser level. Pairs are found by an
equi-join on (levels, cell), which Spark broadcasts or sorts by size and splits when skewed;
a pair that shares several cells is kept only in the one holding its least common corner.

The distinct levels of each side are the only statistics: one aggregate per side, whose
result has at most a few dozen rows. Points are boxes of no size, keyed once per level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = -60
#: A broadcast box is cut into cells of a quarter of its own width.
FINER = 2
#: Bytes that a scan's task reads at least, as Spark deals files.
SPLIT_BYTES = 4 << 20


@dataclass
class Extent:
    """Statistics of a side: box of all boxes, row count and the rows of each raw level; of
    polygons also the rows that are no rectangles and the bytes of all rows."""

    rows: int
    x0: float
    y0: float
    x1: float
    y1: float
    levels: dict[int, int]
    others: int = 0
    size: int = 0

    def floor_level(self, per_cell: float = 1.0) -> int:
        """Level whose cells hold about per_cell rows if rows were even over the extent."""
        import math

        if not self.rows or self.x0 is None:
            return 0
        side = max(self.x1 - self.x0, self.y1 - self.y0)
        wanted = side / max(1.0, math.sqrt(self.rows / per_cell))
        return max(LEAST, math.ceil(math.log2(wanted))) if wanted > 0 and math.isfinite(wanted) else 0


def raw_level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    side = F.greatest(x1 - x0, y1 - y0)
    return F.when(side > 0, F.greatest(F.lit(LEAST), F.ceil(F.log2(side)).cast("int"))).otherwise(F.lit(LEAST))


def extent_of(df: DataFrame, box: tuple[Column, Column, Column, Column], flat: Column | None = None, width: Column | None = None) -> Extent:
    """flat: whether a row is a rectangle; width: its bytes."""
    x0, y0, x1, y1 = box
    others = F.lit(0) if flat is None else F.count(F.when(~flat, 1))
    size = F.lit(0) if width is None else F.sum(width)
    rows = (
        df.filter(valid(*box)).groupBy(raw_level(*box).alias("level"))
        .agg(F.count("*").alias("n"), F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1"), others.alias("others"), size.alias("size")).collect()
    )
    if not rows:
        return Extent(0, None, None, None, None, {})
    return Extent(
        sum(r["n"] for r in rows), min(r["x0"] for r in rows), min(r["y0"] for r in rows), max(r["x1"] for r in rows), max(r["y1"] for r in rows),
        {r["level"]: r["n"] for r in rows}, sum(r["others"] for r in rows), sum(r["size"] or 0 for r in rows),
    )


def valid(*coordinates: Column) -> Column:
    """All coordinates are numbers; null and NaN match nothing."""
    ok = F.lit(True)
    for c in coordinates:
        ok = ok & c.isNotNull() & ~F.isnan(c)
    return ok


def cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def _keyed(df: DataFrame, box, floor: int, others: list[int], mine: str, theirs: str, finer: int = 0) -> DataFrame:
    """One row per cell and level of the other side: the pair of levels, _cx, _cy."""
    x0, y0, x1, y1 = box
    own = F.greatest(F.lit(floor), raw_level(x0, y0, x1, y1) - finer)
    levels = df.filter(valid(*box)).withColumns({mine: own})
    levels = levels.withColumn(theirs, F.explode(F.array(*[F.lit(v) for v in others])) if len(others) > 1 else F.lit(others[0]))
    at = F.greatest(F.col(mine), F.col(theirs))
    span = lambda lo, hi: F.sequence(cell(lo, at), cell(hi, at))
    return levels.withColumn("_cx", F.explode(span(x0, x1))).withColumn("_cy", F.explode(span(y0, y1)))


def _keyed_points(df: DataFrame, x: Column, y: Column, floor: int, others: list[int], mine: str, theirs: str) -> DataFrame:
    """As _keyed, for boxes of no size: one row per level of the other side."""
    levels = df.filter(valid(x, y)).withColumn(mine, F.lit(floor))
    levels = levels.withColumn(theirs, F.explode(F.array(*[F.lit(v) for v in others])) if len(others) > 1 else F.lit(others[0]))
    at = F.col(theirs)  # no level lies below the floor
    return levels.withColumns({"_cx": cell(x, at), "_cy": cell(y, at)})


def spread(df: DataFrame) -> DataFrame:
    """A table so small that its files would make fewer tasks than there are cores, dealt over all of them; others as they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def box_join(left: DataFrame, left_box, right: DataFrame, right_box, right_extent: Extent, left_levels: list[int] | None = None, on: Column | None = None, broadcast_bytes: int = 0, sort: bool = False) -> DataFrame:
    """Inner join of rows whose boxes overlap (closed), on and any further condition on both.

    left_levels: raw levels of the left side; None means points (no size). Column names of the
    two sides must differ. broadcast_bytes: broadcast the right side if its counted bytes, times
    the most keys that a row gets, are at most that many; else Spark chooses by size. sort: never
    broadcast, for sides whose files are much smaller than their rows.
    """
    floor = right_extent.floor_level()
    l_levels = sorted({max(floor, v) for v in left_levels}) if left_levels is not None else [floor]
    # a side that is small enough is broadcast, and its boxes are cut finer, so that a key meets fewer of them
    small = 0 < right_extent.size * (2**FINER + 1) ** 2 * len(l_levels) <= broadcast_bytes
    finer = FINER if small else 0
    r_levels = sorted({max(floor, v - finer) for v in right_extent.levels}) or [floor]
    if left_levels is None:
        a = _keyed_points(spread(left) if small else left, left_box[0], left_box[1], floor, r_levels, "_ll", "_lr")
    else:
        a = _keyed(left, left_box, floor, r_levels, "_ll", "_lr")
    b = _keyed(right, right_box, floor, l_levels, "_lr2", "_ll2", finer).withColumnsRenamed({"_cx": "_cx2", "_cy": "_cy2"})
    if small or sort:
        b = F.broadcast(b) if small else b.hint("merge")
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = left_box, right_box
    same = (F.col("_ll") == F.col("_ll2")) & (F.col("_lr") == F.col("_lr2")) & (F.col("_cx") == F.col("_cx2")) & (F.col("_cy") == F.col("_cy2"))
    overlap = (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)
    at = F.greatest(F.col("_ll"), F.col("_lr"))
    first = (F.col("_cx") == cell(F.greatest(ax0, bx0), at)) & (F.col("_cy") == cell(F.greatest(ay0, by0), at))
    condition = same & overlap & first
    return a.join(b, condition if on is None else condition & on).drop("_ll", "_lr", "_ll2", "_lr2", "_cx", "_cy", "_cx2", "_cy2")
