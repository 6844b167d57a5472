"""Spatial joins: probes are rows with a point; targets are point or polygon frames.

Sides use internal column names while joining: probe columns are prefixed q_, target columns
t_; assemble() restores them, probe columns first, target columns whose names collide
renamed right_<name>.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions import distance as dist
from gridloom.functions import geometry as geo
from gridloom.functions import kernels
from gridloom.operators.aggregates import AggSpec
from gridloom.operators.boxjoin import Extent, box_join, cell, extent_of, spread, valid
from gridloom.operators.counts import count_within
from gridloom.operators.staging import staged

#: A target side may be broadcast if its bytes, counted with its extent, times the most keys of a row are at most this many.
BROADCAST_BYTES = 256 << 20
#: Rows that a geometry or a place must have on average for each distinct one to be met once.
REPEATS = 2
#: Tasks for each core over which pairs are dealt before they are expanded to the rows that they stand for.
TASKS = 4
#: Sides of pairs with more rows are sorted, however small their files are: a broadcast would pass through the driver.
SORTED_ROWS = 200_000
#: Rectangles whose points are counted by tiles, at least.
COUNTED_ROWS = 1000


@dataclass
class Probe:
    df: DataFrame
    names: list[str]
    x: Column
    y: Column

    @property
    def box(self):
        return self.x, self.y, self.x, self.y


def probe_side(query: DataFrame, x: str, y: str) -> Probe:
    for c in (x, y):
        if c not in query.columns:
            raise ValueError(f"column {c!r} is not in the query frame")
    df = query.select(*[F.col(f"`{c}`").alias(f"q_{c}") for c in query.columns])
    df = df.withColumns({"_qx": F.col(f"`q_{x}`").cast("double"), "_qy": F.col(f"`q_{y}`").cast("double")})
    return Probe(df.filter(valid(F.col("_qx"), F.col("_qy"))), query.columns, F.col("_qx"), F.col("_qy"))


def point_side(target: DataFrame, names: list[str], x: str, y: str) -> DataFrame:
    df = target.select(*[F.col(f"`{c}`").alias(f"t_{c}") for c in names], F.col(f"`{x}`").cast("double").alias("_tx"), F.col(f"`{y}`").cast("double").alias("_ty"))
    return df.filter(valid(F.col("_tx"), F.col("_ty")))


@dataclass
class Side:
    """The polygons of a join. Where many share a geometry, each distinct one is met once and carries _sid,
    and members holds the rows that it stands for; else the rows themselves are met."""

    rows: DataFrame
    members: DataFrame | None = None
    light: bool = False

    def expand(self, met: DataFrame) -> DataFrame:
        """met with its distinct geometries replaced by the rows that have them."""
        if self.members is None:
            return met
        return met.join(F.broadcast(self.members) if self.light else self.members, "_sid")


def dealt(pairs: DataFrame) -> DataFrame:
    """Pairs over all cores in even parts, as each of them stands for many rows."""
    return pairs if pairs.isStreaming else pairs.repartition(TASKS * pairs.sparkSession.sparkContext.defaultParallelism)


def _described(rows: DataFrame) -> DataFrame:
    g = F.col("_tg")
    df = rows.withColumn("_tflat", geo.is_rectangle(g))
    # exploded, so that the bounds are found once for all their uses
    df = df.withColumn("_tbox", F.explode(F.array(F.when(F.col("_tflat"), geo.rectangle_bounds(g)).otherwise(geo.bounds(g)))))
    return df.withColumn("_tedges", geo.edges(g))


def polygon_side(target: DataFrame, names: list[str], geometry: str, keep: list[Column] | None = None, most: int = 0) -> Side:
    """keep, most: of the rows of one geometry only the first ones in this order are needed."""
    rows = target.select(*[F.col(f"`{c}`").alias(f"t_{c}") for c in names], F.col(f"`{geometry}`").alias("_tg")).filter("_tg is not null and size(_tg) > 0")
    known = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("_tg")).alias("shapes"), F.sum(_bytes(rows)).alias("size")).first()
    if known["n"] < REPEATS * max(1, known["shapes"]):
        return Side(_described(spread(rows)))
    shapes = staged(rows.select("_tg").distinct().withColumn("_sid", F.monotonically_increasing_id()), "shapes")
    members = rows.join(shapes, "_tg").drop("_tg")
    if keep is not None:
        first = F.row_number().over(Window.partitionBy("_sid").orderBy(*keep))
        members = members.withColumn("_first", first).filter(F.col("_first") <= most).drop("_first")
    return Side(_described(spread(shapes)), members, known["size"] <= BROADCAST_BYTES)


def _bytes(df: DataFrame, geometry: Column | None = None) -> Column:
    """Bytes of a row, about; nested columns other than polygons make a row too wide to broadcast."""
    shape = T._parse_datatype_string(geo.GEOMETRY).simpleString()
    total = F.lit(64)
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif f.name.startswith("t_") and kind.simpleString() == shape:
            total = total + (F.lit(8) if geometry is not None else F.coalesce(48 * F.size(F.flatten(F.flatten(F.col(f"`{f.name}`")))), F.lit(0)))
        elif f.name.startswith("t_") and isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.lit(BROADCAST_BYTES)
        else:
            total = total + F.lit(8)
    return (total if geometry is None else total + geometry).cast("long")


def _width(df: DataFrame) -> Column:
    """Bytes of a row to meet; its geometry counts by its edges."""
    return _bytes(df, F.when(F.col("_tflat"), 200).otherwise(48 * F.size(F.flatten(F.flatten("_tg")))))


def polygon_extent(target: DataFrame, box) -> Extent:
    return extent_of(target, box, F.col("_tflat"), _width(target))


def polygon_contains(x: Column, y: Column, extent: Extent) -> Column:
    """Even-odd test; a rectangle is settled on its box, whose left and bottom borders are in."""
    b = F.col("_tbox")
    inside = (x >= b["x0"]) & (x < b["x1"]) & (y >= b["y0"]) & (y < b["y1"])
    return inside if not extent.others else F.when(F.col("_tflat"), inside).otherwise(geo.contains(F.col("_tedges"), x, y))


def polygon_distance(x: Column, y: Column, extent: Extent) -> Column:
    """Exact distance; a rectangle's is that of its box. Where all are rectangles, no edges are read."""
    plain = geo.box_distance(F.col("_tbox"), x, y)
    return plain if not extent.others else F.when(F.col("_tflat"), plain).otherwise(geo.distance(F.col("_tedges"), x, y))


def polygon_box(margin=None):
    b = [F.col(f"_tbox.{k}") for k in ("x0", "y0", "x1", "y1")]
    if margin is None:
        return tuple(b)
    return b[0] - margin, b[1] - margin, b[2] + margin, b[3] + margin


def assembled(left: list[str], right: list[str]) -> dict[str, str]:
    """Visible names of a join's columns and the internal ones behind them."""
    taken = set(left)
    return {**{c: f"q_{c}" for c in left}, **{f"right_{c}" if c in taken else c: f"t_{c}" for c in right}}


def assemble(joined: DataFrame, left: list[str], right: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    taken = set(left)
    cols = [F.col(f"`q_{c}`").alias(c) for c in left] + [F.col(f"`t_{c}`").alias(f"right_{c}" if c in taken else c) for c in right]
    return joined.select(*cols, *[v.alias(k) for k, v in (extra or {}).items()])


def grouped(side: Side, met: DataFrame, names: dict[str, str], keys: list[str], named: dict[str, AggSpec], schema: T.StructType) -> DataFrame:
    """Aggregates over the expanded pairs, formed without expanding them.

    Pairs are aggregated by the probe's keys and the geometry, rows of the target by theirs; one
    row of either stands for _m or _n pairs of each row of the other. schema: of the result.
    """
    own = lambda p: [F.col(f"`{names[k]}`").alias(f"_k{i}") for i, k in enumerate(keys) if names[k].startswith(p)]
    left, right = own("q_"), own("t_")
    floats = lambda df, c: isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))

    def parts(df: DataFrame, prefix: str) -> list[Column]:
        """What one side gives to each aggregate."""
        out = []
        for i, spec in enumerate(named.values()):
            if spec.column is None or not names[spec.column].startswith(prefix):
                continue
            c = F.col(f"`{names[spec.column]}`")
            if spec.kind in ("min", "max"):
                out.append(getattr(F, spec.kind)(F.when(~F.isnan(c), c) if floats(df, names[spec.column]) else c).alias(f"_v{i}"))
            elif spec.kind in ("sum", "mean"):
                c = c.cast("double") if spec.kind == "mean" else c
                out += [F.sum(c).alias(f"_v{i}"), F.count(c).alias(f"_c{i}")]
        return out

    few = side.members.groupBy("_sid", *right).agg(F.count("*").alias("_n"), *parts(side.members, "t_"))
    few = F.broadcast(few) if side.light else few
    pairs = met.groupBy("_sid", *left).agg(F.count("*").alias("_m"), *parts(met, "q_")).join(few, "_sid")
    final = []
    for i, (name, spec) in enumerate(named.items()):
        v = F.col(f"_v{i}")
        times = F.col("_n" if spec.column and names[spec.column].startswith("q_") else "_m")
        if spec.kind == "count":
            out = F.coalesce(F.sum(F.col("_m") * F.col("_n")), F.lit(0))
        elif spec.kind == "sum":
            out = F.coalesce(F.sum(v * times), F.lit(0))
        elif spec.kind == "mean":
            out = F.sum(v * times) / F.nullif(F.sum(F.col(f"_c{i}") * times), F.lit(0))
        else:
            out = getattr(F, spec.kind)(v)
        final.append(out.cast(schema[name].dataType).alias(name))
    return pairs.groupBy(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]).agg(*final)


def _repeated(df: DataFrame, x: str, y: str) -> tuple[bool, DataFrame]:
    """Whether places are shared by rows, and the rows as a side of a join, broadcast if small."""
    if df.isStreaming:
        return False, df
    known = df.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(x, y)).alias("places"), F.sum(_bytes(df)).alias("size")).first()
    return known["n"] >= REPEATS * max(1, known["places"]), F.broadcast(df) if (known["size"] or 0) <= BROADCAST_BYTES else df


def within_distance(probe: Probe, target: DataFrame, d: float, system: str) -> DataFrame:
    """All pairs of points at most d apart. Places that rows share are met once and then expanded to the rows."""
    tx, ty = F.col("_tx"), F.col("_ty")
    (from_few, left), (to_few, right) = _repeated(probe.df, "_qx", "_qy"), _repeated(target, "_tx", "_ty")
    met_left = probe.df.select("_qx", "_qy").distinct() if from_few else probe.df
    met_right = target.select("_tx", "_ty").distinct() if to_few else target
    place, reach = (probe.x, probe.y), dist.search_box(tx, ty, float(d), system)
    exact = dist.point_distance(probe.x, probe.y, tx, ty, system) <= float(d)
    if system == "geographic":  # boxes and unit vectors once a row, as a pair needs no more than a chord to be told apart
        wx, wy = dist.wrapped(tx, ty)
        met_right = met_right.withColumns(dict(zip(("_rx0", "_ry0", "_rx1", "_ry1"), dist.search_box(wx, wy, float(d), system))) | dist.unit_vector(tx, ty, "_tu"))
        reach = tuple(F.col(c) for c in ("_rx0", "_ry0", "_rx1", "_ry1"))
        met_left = met_left.withColumns(dict(zip(("_wx", "_wy"), dist.wrapped(probe.x, probe.y))) | dist.unit_vector(probe.x, probe.y, "_qu"))
        place = F.col("_wx"), F.col("_wy")
        exact = (dist.chord_squared("_qu", "_tu") <= dist.longest_chord_squared(float(d))) & exact
    extent = extent_of(met_right, reach, width=_bytes(met_right))
    met = box_join(met_left, place + place, met_right, reach, extent, on=exact, broadcast_bytes=BROADCAST_BYTES)
    if from_few:
        met = (met if to_few else dealt(met)).join(left, ["_qx", "_qy"])
    return dealt(met).join(right, ["_tx", "_ty"]) if to_few else met


def contains(probe: Probe, side: Side) -> DataFrame:
    """A pair for every polygon of the side that contains the probe, not expanded."""
    box = polygon_box()
    extent = polygon_extent(side.rows, box)
    return box_join(probe.df, probe.box, side.rows, box, extent, on=polygon_contains(probe.x, probe.y, extent), broadcast_bytes=BROADCAST_BYTES)


def polygon_within_distance(probe: Probe, side: Side, d: float) -> DataFrame:
    """A pair for every polygon of the side at most d away from the probe (0 inside), not expanded."""
    box = polygon_box(F.lit(float(d)))
    extent = polygon_extent(side.rows, box)
    near = geo.box_distance(F.col("_tbox"), probe.x, probe.y) <= float(d)
    exact = near & (polygon_distance(probe.x, probe.y, extent) <= float(d)) if extent.others else near
    return box_join(probe.df, probe.box, side.rows, box, extent, on=exact, broadcast_bytes=BROADCAST_BYTES)


def counted_within_distance(probe: Probe, side: Side, d: float) -> DataFrame | None:
    """Rows of the side with _n, the probes at most d away, where there is one; None if its shapes or their number ask for the join."""
    extent = polygon_extent(side.rows, polygon_box(F.lit(float(d))))
    if side.members is not None or extent.others or extent.rows < COUNTED_ROWS or probe.df.isStreaming:
        return None
    rows = staged(side.rows.drop("_tg", "_tedges", "_tflat").withColumn("_tid", F.monotonically_increasing_id()), "boxes")
    boxes = rows.select("_tid", *[F.col(f"_tbox.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]).filter(valid(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    return rows.join(count_within(probe.df.select("_qx", "_qy"), boxes, extent, float(d)), "_tid")


def _search_radius(cells: DataFrame, points: DataFrame, extent: Extent, k: int, level: int) -> DataFrame:
    """cells (_cx, _cy at level) with _r: no probe of the cell has its k-th neighbour farther away.

    points (_px, _py) stand for the targets: each target lies within any distance that its
    point does. Counts of points on ever coarser grids give, for each cell, the finest level on
    which the block of 3 x 3 cells around its ancestor holds k of them; all of those are
    within two cell diagonals. A cell without such a block takes the distance to the farthest
    corner of the extent.
    """
    size = lambda lv: F.pow(F.lit(2.0), lv)
    side = max(extent.x1 - extent.x0, extent.y1 - extent.y0)
    top = level
    while 2.0**top < side and top < level + 64:
        top += 1
    grid = points.groupBy(cell(F.col("_px"), F.lit(level)).alias("gx"), cell(F.col("_py"), F.lit(level)).alias("gy")).agg(F.count("*").alias("n"))
    up = grid.select(F.explode(F.sequence(F.lit(level), F.lit(top))).alias("gl"), "gx", "gy", "n")
    shift = lambda c: F.floor(F.col(c) / size(F.col("gl") - level)).cast("long")
    counts = up.select("gl", shift("gx").alias("gx"), shift("gy").alias("gy"), "n").groupBy("gl", "gx", "gy").agg(F.sum("n").alias("n"))
    step = F.explode(F.array(*[F.lit(v) for v in (-1, 0, 1)]))
    around = counts.withColumn("ox", step).withColumn("oy", step).select("gl", (F.col("gx") + F.col("ox")).alias("gx"), (F.col("gy") + F.col("oy")).alias("gy"), "n")
    pyramid = around.groupBy("gl", "gx", "gy").agg(F.sum("n").alias("n")).filter(F.col("n") >= k)
    asked = cells.select("_cx", "_cy", F.explode(F.sequence(F.lit(level), F.lit(top))).alias("gl")).select(
        "_cx", "_cy", "gl", F.floor(F.col("_cx") / size(F.col("gl") - level)).cast("long").alias("gx"), F.floor(F.col("_cy") / size(F.col("gl") - level)).cast("long").alias("gy"))
    best = asked.join(pyramid, ["gl", "gx", "gy"]).groupBy("_cx", "_cy").agg(F.min("gl").alias("gl"))
    s = F.lit(2.0**level)
    x0, y0 = F.col("_cx") * s, F.col("_cy") * s
    far_x = F.greatest(F.abs(x0 - extent.x1), F.abs(x0 + s - extent.x0), F.abs(x0 - extent.x0), F.abs(x0 + s - extent.x1))
    far_y = F.greatest(F.abs(y0 - extent.y1), F.abs(y0 + s - extent.y0), F.abs(y0 - extent.y0), F.abs(y0 + s - extent.y1))
    far = F.sqrt(far_x * far_x + far_y * far_y)
    diagonal = size(F.col("gl")) * (2 * 2**0.5)
    return cells.join(best, ["_cx", "_cy"], "left").select("_cx", "_cy", (F.least(F.coalesce(diagonal, far), far) * (1 + 1e-9)).alias("_r"))


def _exact(met: DataFrame, place: list[str], full: DataFrame) -> DataFrame:
    """Pairs of places and _tid with _d: polygon_distance from one row an edge, as aggregates over rows are compiled and those over arrays are not."""
    x, y, e = F.col("_qx"), F.col("_qy"), F.col("_e")
    edge = F.when(F.col("_tflat"), F.slice("_tedges", 1, 1)).otherwise(F.col("_tedges"))
    sides = full.select("_tid", "_tflat", "_tbox", F.explode(edge).alias("_e"))
    crossed = F.coalesce(geo.crosses(e, x, y), F.lit(False)).cast("int")
    found = met.join(sides, "_tid").groupBy(*place, "_tid").agg(
        F.min(F.when(F.col("_tflat"), geo.box_distance(F.col("_tbox"), x, y))).alias("_plain"), F.min(geo.edge_distance_squared(e, x, y)).alias("_least"), F.sum(crossed).alias("_crossed"))
    inside = F.col("_crossed") % 2 == 1
    return found.select(*place, "_tid", F.coalesce("_plain", F.when(inside, 0.0).otherwise(F.sqrt("_least"))).alias("_d"))


def _nearest(probe: Probe, target: DataFrame, box, extent: Extent, upper, bound: Column, measure: Column | None, k: int, tie: list[Column], full: DataFrame | None = None, side: Side | None = None) -> DataFrame:
    """Exact k nearest targets of each probe.

    Probes of one place are answered once. Cells of places get a search radius from counts and
    meet targets in a box join; the k-th least of upper(x, y) over a cell's corners (a convex
    measure, so its most is at a corner) then limits the cell's targets to those that may be
    among the k of any place in it. Places meet these in their cell's partition and keep the k best.

    upper(x, y): no less than the distance to the target; bound: no more than it from the probe.
    measure: the distance; None if it is found from full, the targets with their edges by _tid, of which target holds only boxes and points.
    side: if its geometries stand for several rows each, those among the k nearest are expanded at the end.
    """
    wanted, k = int(k), min(int(k), extent.rows)
    if not k:
        none = target if full is None else full
        return probe.df.join(none if side is None else side.expand(none), F.lit(False)).withColumn("_d", F.lit(0.0))
    level = extent.floor_level(max(0.5, k / 9))
    places = probe.df.select("_qx", "_qy").distinct().withColumns({"_cx": cell(probe.x, F.lit(level)), "_cy": cell(probe.y, F.lit(level))})
    cells = places.select("_cx", "_cy").distinct()
    # one row per occupied cell, read by the level statistics and by the join
    radius = staged(_search_radius(cells, target.select(F.col("_px"), F.col("_py")), extent, k, level), "radius")
    s = F.lit(2.0**level)
    left, low, right, top = F.col("_cx") * s, F.col("_cy") * s, (F.col("_cx") + 1) * s, (F.col("_cy") + 1) * s
    r = F.col("_r")
    reach = radius.select(F.col("_cx").alias("_kx"), F.col("_cy").alias("_ky"), (left - r).alias("_x0"), (low - r).alias("_y0"), (right + r).alias("_x1"), (top + r).alias("_y1"), left.alias("_l"), low.alias("_b"), right.alias("_rt"), top.alias("_t"))
    reach_box = tuple(F.col(c) for c in ("_x0", "_y0", "_x1", "_y1"))
    # dealt by cells into a fixed number of parts: by their few bytes they would be merged into a few tasks
    parts = max(TASKS * probe.df.sparkSession.sparkContext.defaultParallelism, int(probe.df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = places.repartition(parts, "_cx", "_cy")
    found = box_join(reach, reach_box, target, box, extent, left_levels=list(extent_of(reach, reach_box).levels)).repartition(parts, "_kx", "_ky")
    most = F.greatest(*[upper(F.col(x), F.col(y)) for x in ("_l", "_rt") for y in ("_b", "_t")])
    gap = lambda lo, hi, a, b: F.greatest(lo - F.col(b), F.col(a) - hi, F.lit(0.0))
    gx, gy = gap(box[0], box[2], "_l", "_rt"), gap(box[1], box[3], "_b", "_t")
    whole = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kth = F.nth_value("_most", k).over(whole("_kx", "_ky").orderBy("_most"))
    slack = 1 + 1e-9
    held = found.withColumn("_most", most).withColumn("_kth", F.coalesce(kth, F.lit(geo.INF)) * slack).filter(F.sqrt(gx * gx + gy * gy) <= F.col("_kth"))
    held = held.drop("_x0", "_y0", "_x1", "_y1", "_l", "_b", "_rt", "_t", "_most")
    met = places.join(held, (F.col("_cx") == F.col("_kx")) & (F.col("_cy") == F.col("_ky")) & (bound <= F.col("_kth")))
    place = ["_cx", "_cy", "_qx", "_qy"]
    if full is not None:
        # the k-th nearest known point of a target limits the targets whose geometry is worth fetching
        near = met.withColumns({"_lb": bound, "_ub": upper(probe.x, probe.y)})
        close = near.withColumn("_kth", F.nth_value("_ub", k).over(whole(*place).orderBy("_ub"))).filter(F.col("_lb") <= F.coalesce("_kth", F.lit(geo.INF)) * slack)
        met = _exact(close.select(*place, "_tid"), place, full).join(full.drop("_tedges"), "_tid")
    else:
        met = met.withColumn("_d", measure)
    if side is not None and side.members is not None:
        near = F.rank().over(Window.partitionBy(*place).orderBy("_d"))
        met = side.expand(met.withColumn("_near", near).filter(F.col("_near") <= k).drop("_near"))
    else:
        wanted = k
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("_d", *tie))
    best = met.withColumn("_rank", rank).filter(F.col("_rank") <= wanted).drop("_cx", "_cy", "_kx", "_ky", "_kth", "_rank")
    return probe.df.join(best, ["_qx", "_qy"])


def knn(probe: Probe, target: DataFrame, k: int, tie: list[Column]) -> DataFrame:
    """Each probe with its min(k, n) nearest points."""
    tx, ty = F.col("_tx"), F.col("_ty")
    to = lambda x, y: dist.planar(x, y, tx, ty)
    box, d = (tx, ty, tx, ty), to(probe.x, probe.y)
    return _nearest(probe, target.withColumns({"_px": tx, "_py": ty}), box, extent_of(target, box), to, d, d, k, tie)


def polygon_knn(probe: Probe, side: Side, k: int, tie: list[Column]) -> DataFrame:
    """Each probe with its k nearest polygons by exact distance."""
    box, target = polygon_box(), side.rows
    extent = polygon_extent(target, box)
    bound = geo.box_distance(F.col("_tbox"), probe.x, probe.y)
    corner = F.col("_tedges")[0]
    if not extent.others:
        light = target.withColumns({"_px": F.col("_tbox.x0"), "_py": F.col("_tbox.y0")}).drop("_tg", "_tedges", "_tflat")
        return _nearest(probe, light, box, extent, lambda x, y: geo.box_distance(F.col("_tbox"), x, y), bound, bound, k, tie, side=side)
    # numbered once, so that the light and the full rows carry the same numbers
    full = staged(target.drop("_tg").withColumn("_tid", F.monotonically_increasing_id()), "polygons")
    light = full.select("_tid", "_tbox", "_tflat", corner["ax"].alias("_px"), corner["ay"].alias("_py"))
    to = lambda x, y: F.when(F.col("_tflat"), geo.box_distance(F.col("_tbox"), x, y)).otherwise(dist.planar(x, y, F.col("_px"), F.col("_py")))
    return _nearest(probe, light, box, extent, to, bound, None, k, tie, full, side)


def intersecting_pairs(side: Side, order: Column) -> DataFrame:
    """Unordered pairs of polygons that meet, borders included: l__o, r__o, areas, overlap and IoU.

    order numbers the rows; the smaller is left. Distinct geometries meet once, each also itself,
    and the pairs are then expanded to the rows.
    """
    if side.members is None:
        return _meeting_pairs(side.rows, order, False)
    pairs = _meeting_pairs(side.rows, F.col("_sid"), True)
    rows = side.members.select("_sid", order.alias("_o"))
    rows = F.broadcast(rows) if side.light else rows
    first = pairs.join(rows.select(F.col("_sid").alias("l__o"), F.col("_o").alias("_a")), "l__o")
    both = dealt(first).join(rows.select(F.col("_sid").alias("r__o"), F.col("_o").alias("_b")), "r__o")
    ahead = F.col("_a") < F.col("_b")
    pick = lambda yes, no, name: F.when(ahead, F.col(yes)).otherwise(F.col(no)).alias(name)
    both = both.filter(ahead | ((F.col("l__o") != F.col("r__o")) & (F.col("_a") > F.col("_b"))))
    return both.select(pick("_a", "_b", "l__o"), pick("_b", "_a", "r__o"), pick("l__area", "r__area", "l__area"), pick("r__area", "l__area", "r__area"), "overlap_area", "iou")


def closest_pairs(side: Side, order: Column, k: int, slack: float) -> DataFrame:
    """Those of intersecting_pairs that may be among the k of highest IoU, if IoUs are told apart only beyond slack.

    Two rectangles of an IoU of t or more differ by at most 1 - t of the larger width in their left
    sides, and of the larger height in their low ones, so corners meet in a box join with that reach.
    t falls until k pairs are found; at a half, and for other shapes, all pairs are formed.
    """
    extent = polygon_extent(side.rows, polygon_box())
    if side.members is None and not extent.others and extent.rows:
        b = F.col("_tbox")
        boxes = staged(side.rows.select(order.alias("_o"), *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")]), "boxes")
        one, two = [boxes.select(*[F.col(c).alias(f"{p}_{c}") for c in boxes.columns]) for p in "lr"]
        l, r = [{c: F.col(f"{p}_{c}") for c in boxes.columns} for p in "lr"]
        area = lambda a: (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
        width = lambda lo, hi: F.greatest(F.least(l[hi], r[hi]) - F.greatest(l[lo], r[lo]), F.lit(0.0))
        overlap = width("x0", "x1") * width("y0", "y1")
        union = area(l) + area(r) - overlap
        iou = F.when(union > 0, overlap / union).otherwise(0.0)
        apart = max(2.0**-12, (64 * k / extent.rows**2) ** 0.25)
        while apart < 0.5:
            far = apart / (1 - apart) * (1 + 1e-9)
            reach_x, reach_y = (r["x1"] - r["x0"]) * far, (r["y1"] - r["y0"]) * far
            reach = r["x0"] - reach_x, r["y0"] - reach_y, r["x0"] + reach_x, r["y0"] + reach_y
            near = (iou >= 1 - apart) & (l["_o"] < r["_o"])
            size = extent_of(two, reach)
            met = box_join(one, (l["x0"], l["y0"]) * 2, two, reach, size, on=near, sort=size.rows > SORTED_ROWS)
            found = staged(met.select("l__o", "r__o", area(l).alias("l__area"), area(r).alias("r__area"), overlap.alias("overlap_area"), iou.alias("iou")), "pairs")
            if found.filter(F.col("iou") >= 1 - apart + slack).limit(k).count() == k:
                return found
            apart *= 2
    return intersecting_pairs(side, order)


def _meeting_pairs(target: DataFrame, order: Column, same: bool) -> DataFrame:
    """intersecting_pairs of rows that are met each; same: each row meets itself too. Boxes meet without their geometry. Rectangles
    meet rectangles and are settled by Columns; the other shapes, if there are any, meet all, and only
    these pairs fetch edges, for the Python kernel.
    """
    extent = polygon_extent(target, polygon_box())
    b = F.col("_tbox")
    area = F.when(F.col("_tflat"), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).otherwise(geo.area(F.col("_tg")))
    shape = target.withColumns({"_o": order, "_area": area})
    light = shape.select("_o", "_area", "_tflat", "_tbox")
    side = lambda p, df: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    box = lambda p: tuple(F.col(f"{p}__tbox.{k}") for k in ("x0", "y0", "x1", "y1"))
    met = lambda a, b, on: box_join(side("l", a), box("l"), side("r", b), box("r"), extent, left_levels=list(extent.levels), on=on, sort=extent.rows > SORTED_ROWS)
    ahead = F.col("l__o") <= F.col("r__o") if same else F.col("l__o") < F.col("r__o")
    width = lambda a, b: F.greatest(F.least(F.col(f"l__tbox.{b}"), F.col(f"r__tbox.{b}")) - F.greatest(F.col(f"l__tbox.{a}"), F.col(f"r__tbox.{a}")), F.lit(0.0))
    keep = ["l__o", "r__o", "l__area", "r__area"]
    rect, other = (light, None) if not extent.others else (light.filter("_tflat"), light.filter("not _tflat"))
    both = met(rect, rect, ahead).select(*keep, (width("x0", "x1") * width("y0", "y1")).alias("overlap_area"))
    if other is not None:
        pairs = met(other, light, ahead | (F.col("r__tflat") & (F.col("l__o") != F.col("r__o"))))
        swap = lambda c: [F.when(ahead == (p == "l"), F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"{p}_{c}") for p in "lr"]
        pairs = pairs.select(*swap("_o"), *swap("_area"))
        edges = shape.select("_o", "_tedges")
        known = pairs.join(side("l", edges), "l__o").join(side("r", edges), "r__o")
        related = known.withColumn("_rel", kernels.relate(F.col("l__tedges"), F.col("r__tedges"))).filter("_rel.meets")
        both = both.unionByName(related.select(*keep, F.col("_rel.overlap").alias("overlap_area")))
    union = F.col("l__area") + F.col("r__area") - F.col("overlap_area")
    return both.withColumn("iou", F.when(union > 0, F.col("overlap_area") / union).otherwise(0.0))
