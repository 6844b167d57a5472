"""Named queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import distance as dist
from gridloom.functions import geometry as geo
from gridloom.functions import kernels, wkb
from gridloom.functions import sql as sql_functions
from gridloom.operators import aggregates as agg
from gridloom.operators.staging import fresh_path
from gridloom.plans import fixtures as fx
from gridloom.plans.fixtures import BUILDINGS, CUSTOMERS, TRIPS, ZONES, boxes, edges_sql, load, lonlat, shapes, sql
from gridloom.plans.frame import SpatialFrame
from gridloom.sources import arrays
from gridloom.streaming import joins as stream

QUERIES: dict = {}
ORACLES: dict = {}


def register(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return add


def customers(spark, d) -> SpatialFrame:
    return SpatialFrame(load(spark, d, CUSTOMERS), "x", "y")


def trips(spark, d) -> DataFrame:
    return load(spark, d, TRIPS)


def zones(spark, d) -> SpatialFrame:
    return boxes(load(spark, d, ZONES))


def buildings(spark, d) -> SpatialFrame:
    return boxes(load(spark, d, BUILDINGS))


C, Z, T, B = sql(CUSTOMERS), sql(ZONES), sql(TRIPS), sql(BUILDINGS)
INSIDE = "x >= x0 and x < x1 and y >= y0 and y < y1"
BOX_D = "sqrt(greatest(x0 - {x}, {x} - x1, 0) * greatest(x0 - {x}, {x} - x1, 0) + greatest(y0 - {y}, {y} - y1, 0) * greatest(y0 - {y}, {y} - y1, 0))"


def hits_sql(points: str, edges: str = None) -> str:
    """Pairs (id, pid) with the point inside the mixed shape, by edge parity."""
    return f"""select id, pid from ({points}) p, {edges or edges_sql()} e where (ay > y) <> (b_y > y) and x < (bx - ax) * (y - ay) / (b_y - ay) + ax group by id, pid having count(*) % 2 = 1"""


def distances_sql(points: str) -> str:
    """(id, pid, d): exact distances of all points and mixed shapes."""
    t = "least(greatest(coalesce(((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / nullif((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay), 0), 0), 0), 1)"
    return f"""(with pts as ({points}), hit as ({hits_sql('select * from pts')}),
    seg as (select id, pid, x, y, ax, ay, bx, b_y, {t} t from pts, {edges_sql()} e),
    far as (select id, pid, sqrt(min((x - (ax + t * (bx - ax))) * (x - (ax + t * (bx - ax))) + (y - (ay + t * (b_y - ay))) * (y - (ay + t * (b_y - ay))))) m from seg group by 1, 2)
    select far.id, far.pid, case when hit.id is null then m else cast(0 as double) end d from far left join hit on far.id = hit.id and far.pid = hit.pid)"""


# -- filters -------------------------------------------------------------------------------


@register(f"select id, x, y, val from ({C}) where x between 20 and 60.5 and y between 10 and 45.25")
def range_points(spark, d):
    return customers(spark, d).lazy().range_query(20, 10, 60.5, 45.25).select("id", "x", "y", "val").to_df()


@register(f"select id, seg, val from ({C}) where x between 10 and 90 and y between 10 and 90 and val > 1000 and seg in ('BUILDING', 'MACHINERY')")
def range_scalar_combo(spark, d):
    return customers(spark, d).lazy().filter(F.col("val") > 1000).range_query(10, 10, 90, 90).filter("seg in ('BUILDING', 'MACHINERY')").select("id", "seg", "val").to_df()


@register(f"select id, x, y from ({C}) where x between 30 and 70 and y between 0 and 80 and x between 50 and 99 and y between 25 and 60")
def range_two_boxes(spark, d):
    return customers(spark, d).lazy().range_query(30, 0, 70, 80).range_query(50, 25, 99, 60).select(["id", "x", "y"]).to_df()


@register(f"select pid, pname from ({Z}) where x0 <= 55 and x1 >= 30 and y0 <= 60 and y1 >= 35")
def range_polygons(spark, d):
    return zones(spark, d).lazy().range_query(30, 35, 55, 60).select("pid", "pname").to_df()


@register(f"select pid from ({fx.CUT_SQL}) where x0 <= 55.5 and x1 >= 30.25 and y0 <= 60.5 and y1 >= 35.25 and greatest(x0, 30.25) + greatest(y0, 35.25) <= c")
def range_mixed_shapes(spark, d):
    """Triangles and rectangles that meet a box."""
    return fx.cut_zones(spark, d).lazy().range_query(30.25, 35.25, 55.5, 60.5).select("pid").to_df()


@register(f"select id, seg from ({C}) where x between 5 and 45 and y between 5 and 45 and x between 20 and 80 and y between 0 and 100")
def range_filter_frame(spark, d):
    return customers(spark, d).range_filter(5, 5, 45, 45).lazy().range_query(20, 0, 80, 100).select("id", "seg").to_df()


@register(f"select distinct pid, pname from ({Z}) join (select pid hit from ({hits_sql('select 1 id, cast(43.5 as double) x, cast(51.25 as double) y')})) on pid = hit")
def contains_polygon(spark, d):
    return shapes(spark, d).lazy().contains(43.5, 51.25).select("pid", "pname").to_df()


@register(f"select id, x, y from ({C}) where abs(x - cast(79.19 as double)) <= 2.3e-13 and abs(y - cast(60.07 as double)) <= 2.3e-13")
def contains_point_eps(spark, d):
    return customers(spark, d).lazy().contains(79.19, 60.07).select("id", "x", "y").to_df()


@register(f"select id, x, y from ({C}) where sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50)) <= 12.5")
def radius_planar(spark, d):
    return customers(spark, d).lazy().within_distance_of_point(50, 50, 12.5).select("id", "x", "y").to_df()


HAVERSINE = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


@register(f"select id, round({HAVERSINE.format(a='lat', b='48.85', c='lon', d='2.35')} / 1000, 3) km from ({fx.LONLAT_SQL}) where {HAVERSINE.format(a='lat', b='48.85', c='lon', d='2.35')} <= 5000000")
def radius_geographic(spark, d):
    near = SpatialFrame(lonlat(spark, d), "lon", "lat", coordinate_system="geographic").lazy().within_distance_of_point(2.35, 48.85, 5_000_000).to_df()
    return near.select("id", F.round(dist.distance_to_point(F.col("lon"), F.col("lat"), 2.35, 48.85, "geographic") / 1000, 3).alias("km"))


RING = [[(20, 20), (60, 20), (60, 60), (20, 60)], [(35, 35), (45, 35), (45, 45), (35, 45)]]


@register(f"""select id from ({C}) where (x >= 20 and x < 60 and y >= 20 and y < 60 and not (x >= 35 and x < 45 and y >= 35 and y < 45))
or sqrt(pow(greatest(20 - x, x - 60, 0), 2) + pow(greatest(20 - y, y - 60, 0), 2)) between 1e-300 and 2.5
or (x between 35 and 45 and y between 35 and 45 and least(x - 35, 45 - x, y - 35, 45 - y) <= 2.5) or ((x = 60 and y between 20 and 60) or (y = 60 and x between 20 and 60))""")
def points_near_polygon(spark, d):
    return customers(spark, d).lazy().points_within_distance_of_polygon(RING, 2.5).select("id").to_df()


@register(f"select id, x, y from ({C}) order by (x - 33) * (x - 33) + (y - 66) * (y - 66), id limit 12")
def knn_point(spark, d):
    return customers(spark, d).lazy().knn(33, 66, 12, tie="id").select("id", "x", "y").to_df()


@register(f"select id, seg from ({C}) where seg = 'AUTOMOBILE' and x between 0 and 50 and y between 0 and 100 order by sqrt((x - 33) * (x - 33) + (y - 66) * (y - 66)), id limit 7")
def knn_after_filter(spark, d):
    return customers(spark, d).lazy().filter("seg = 'AUTOMOBILE'").range_query(0, 0, 50, 100).knn(33, 66, 7, tie="id").select("id", "seg").to_df()


@register(f"select pid from (select id pid from (select *, row_number() over (order by d, pid) r from {distances_sql('select 1 id, cast(50 as double) x, cast(50 as double) y')}) where r <= 0) union all select pid from (select pid, row_number() over (order by d, pid) r from {distances_sql('select 1 id, cast(50 as double) x, cast(50 as double) y')}) where r <= 6")
def knn_polygons(spark, d):
    return shapes(spark, d).lazy().knn(50, 50, 6, tie="pid").select("pid").to_df()


@register(f"select tripkey, px between 25 and 50 and py between 25 and 50 inside from ({T})")
def range_mask(spark, d):
    """A boolean mask of every trip, instead of a filter."""
    return SpatialFrame(trips(spark, d), "px", "py").range_mask(25, 25, 50, 50).select("tripkey", "inside")


@register(f"select pid, x0 <= 41 and x1 > 41 and y0 <= 52 and y1 > 52 inside from ({Z})")
def contains_mask(spark, d):
    """Whether each zone holds one point."""
    return zones(spark, d).contains_mask(41, 52).select("pid", "inside")


@register(f"select id from ({C}) where x between 20 and 60 and y between 0 and 70 and y between 30 and 90 and x between 10 and 45")
def intersect_boxes(spark, d):
    return customers(spark, d).intersect_ranges([(20, 0, 60, 70), (10, 30, 45, 90)]).df.select("id")


@register(f"select id from ({C}) where x between 20 and 60 and y between 0 and 70 and val > 1000 and sqrt((x - 40) * (x - 40) + (y - 40) * (y - 40)) <= 25")
def intersect_hit_lists(spark, d):
    """Keys that three results share."""
    c = customers(spark, d)
    hits = [c.lazy().range_query(20, 0, 60, 70).to_df(), c.lazy().filter("val > 1000").to_df(), c.radius_query(40, 40, 25)]
    return SpatialFrame.intersect_hits(hits, "id")


@register(f"select tripkey from ({T}) where px between 40 and 45 and py between 40 and 55")
def batch_within(spark, d):
    """Query points inside one box."""
    return SpatialFrame(trips(spark, d), "px", "py").lazy().range_query(40, 40, 45, 55).select("tripkey").to_df()


# -- joins -----------------------------------------------------------------------------------


def probes(spark, d) -> DataFrame:
    return load(spark, d, ZONES).selectExpr("pid as qid", "x0 + 0.37 as qx", "y0 + 0.21 as qy")


P = f"select pid as qid, x0 + 0.37 as qx, y0 + 0.21 as qy from ({Z})"
PTS = f"select id, x, y from ({C})"


@register(f"select qid, id, dist from (select qid, id, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) dist, row_number() over (partition by qid order by sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)), id) r from ({P}), ({C})) where r <= 5")
def join_knn(spark, d):
    out = customers(spark, d).lazy().knn_join(probes(spark, d), "qx", "qy", 5, tie="id").to_df()
    return out.select("qid", "id", dist.planar(F.col("qx"), F.col("qy"), F.col("x"), F.col("y")).alias("dist"))


@register(f"select qid, id from ({P}), ({C}) where sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) <= 4.5")
def join_within_distance(spark, d):
    return customers(spark, d).lazy().within_distance_join(probes(spark, d), "qx", "qy", 4.5).select("qid", "id").to_df()


@register(f"with g as ({fx.LONLAT_SQL}) select a.id a, b.id b from g a, g b where a.id <> b.id and {HAVERSINE.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} <= 900000")
def join_within_distance_geo(spark, d):
    g = lonlat(spark, d)
    probe = g.selectExpr("id as a", "lon as qlon", "lat as qlat")
    target = SpatialFrame(g.withColumnRenamed("id", "b"), "lon", "lat", coordinate_system="geographic")
    return target.lazy().within_distance_join(probe, "qlon", "qlat", 900_000).filter("a <> b").select("a", "b").to_df()


@register(f"select id, pid from ({hits_sql(PTS)})")
def join_within(spark, d):
    return shapes(spark, d).lazy().within_join(customers(spark, d).df, "x", "y").select("id", "pid").to_df()


@register(f"select id, pid from {distances_sql(PTS)} where d <= 0.75")
def join_polygon_within_distance(spark, d):
    return shapes(spark, d).lazy().polygon_within_distance_join(customers(spark, d).df, "x", "y", 0.75).select("id", "pid").to_df()


KNN_SQL = f"select id, pid, distance_to_polygon from (select id, pid, d distance_to_polygon, row_number() over (partition by id order by d, pid) r from {distances_sql(PTS)}) where r <= 3"


@register(KNN_SQL)
def join_polygon_knn(spark, d):
    return shapes(spark, d).lazy().polygon_knn_join(customers(spark, d).df, "x", "y", 3, tie="pid").select("id", "pid", "distance_to_polygon").to_df()


@register(KNN_SQL)
def join_polygon_knn_sorted(spark, d):
    return shapes(spark, d).lazy().polygon_knn_join(customers(spark, d).df, "x", "y", 3, sorted_output=True, tie="pid").select("id", "pid", "distance_to_polygon").to_df()


def overlaps_sql(source: str, key: str) -> str:
    return f"""select {key}_1, {key}_2, area_left, area_right, overlap_area, case when area_left + area_right - overlap_area > 0 then overlap_area / (area_left + area_right - overlap_area) else 0 end iou from (
    select a.{key} {key}_1, b.{key} {key}_2, (a.x1 - a.x0) * (a.y1 - a.y0) area_left, (b.x1 - b.x0) * (b.y1 - b.y0) area_right,
    greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) overlap_area
    from ({source}) a join ({source}) b on a.{key} < b.{key} and a.x0 <= b.x1 and a.x1 >= b.x0 and a.y0 <= b.y1 and a.y1 >= b.y0)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_sql(inner: str, plain: list[str], columns: list[str], digits: int = 6) -> str:
    return f"select {', '.join([*plain, *[f'round({c}, {digits}) {c}' for c in columns]])} from ({inner})"


MEASURES = ["area_left", "area_right", "overlap_area", "iou"]


@register(rounded_sql(overlaps_sql(Z, "pid"), ["pid_1", "pid_2"], MEASURES))
def intersects_key_col(spark, d):
    return rounded(zones(spark, d).intersects_pairs("pid"), *MEASURES)


G = "greatest({0}, 0) * greatest({0}, 0) / 2"
CUT_OVERLAP = f"{G.format('(c - x0 - y0)')} - {G.format('(c - x1 - y0)')} - {G.format('(c - x0 - y1)')} + {G.format('(c - x1 - y1)')}"
CUT_AREA = "(case when {0}.pid % 2 = 1 then ({0}.x1 - {0}.x0) * ({0}.x1 - {0}.x0) / 2 else ({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0) end)"


@register(rounded_sql(f"""select pid_1, pid_2, area_left, area_right, {CUT_OVERLAP} overlap_area, ({CUT_OVERLAP}) / (area_left + area_right - ({CUT_OVERLAP})) iou from (
select a.pid pid_1, b.pid pid_2, {CUT_AREA.format('a')} area_left, {CUT_AREA.format('b')} area_right, greatest(a.x0, b.x0) x0, greatest(a.y0, b.y0) y0, least(a.x1, b.x1) x1, least(a.y1, b.y1) y1, least(a.c, b.c) c
from ({fx.CUT_SQL}) a join ({fx.CUT_SQL}) b on a.pid < b.pid) where x0 <= x1 and y0 <= y1 and x0 + y0 <= c""", ["pid_1", "pid_2"], MEASURES))
def intersects_mixed_shapes(spark, d):
    """Pairs of triangles and rectangles that meet, with their overlap."""
    return rounded(fx.cut_zones(spark, d).intersects_pairs("pid"), *MEASURES)


@register(f"select count(*) pairs, round(sum(overlap_area), 4) total from ({overlaps_sql(Z, 'pid')})")
def join_intersects_pairs(spark, d):
    out = zones(spark, d).lazy().intersects_pairs().to_df()
    return out.agg(F.count("*").alias("pairs"), F.round(F.sum("overlap_area"), 4).alias("total"))


@register(f"""with q as ({P}), t as (select pid as id, pname as name, x0 as x, y0 as y from ({Z}))
select q.qid id, 'q' || q.qid name, t.id right_id, t.name right_name from q, t where sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) <= 6""")
def join_select_conflict(spark, d):
    target = SpatialFrame(load(spark, d, ZONES).selectExpr("pid as id", "pname as name", "x0 as x", "y0 as y"), "x", "y")
    query = probes(spark, d).selectExpr("qid as id", "concat('q', qid) as name", "qx", "qy")
    return target.lazy().within_distance_join(query, "qx", "qy", 6).select("id", "name", "right_id", "right_name").to_df()


@register(f"select id, pid from ({hits_sql(PTS)}) where pid % 2 = 0 and id % 3 = 1")
def join_filtered_sides(spark, d):
    """A filter before the join works on the target, one after it on the pairs."""
    return shapes(spark, d).lazy().filter("pid % 2 = 0").within_join(customers(spark, d).df, "x", "y").filter("id % 3 = 1").select("id", "pid").to_df()


# -- aggregates --------------------------------------------------------------------------------


@register(f"select pid, count(*) n, round(sum(val), 2) total, round(avg(val), 4) mean_val, min(val) low, max(val) high from ({Z}), ({C}) where {INSIDE} group by pid")
def agg_count_sum_mean_min_max(spark, d):
    out = zones(spark, d).lazy().within_join(customers(spark, d).df, "x", "y").group_by("pid").agg(
        n=agg.count(), total=agg.sum("val"), mean_val=agg.mean("val"), low=agg.min("val"), high=agg.max("val"))
    return out.withColumns({"total": F.round("total", 2), "mean_val": F.round("mean_val", 4)})


@register(f"select pid, pname, count(*) trips, round(sum(fare), 2) fares from ({Z}), (select px x, py y, fare from ({T})) where {INSIDE} group by all")
def agg_group_by_target(spark, d):
    out = zones(spark, d).lazy().within_join(trips(spark, d), "px", "py").group_by("pid", "pname").agg(trips=agg.count(), fares=agg.sum("fare"))
    return out.withColumn("fares", F.round("fares", 2))


@register(f"select seg, count(*) pairs, min(pid) first_zone from ({Z}), ({C}) where {INSIDE} group by seg")
def agg_group_by_probe(spark, d):
    return zones(spark, d).lazy().within_join(customers(spark, d).df, "x", "y").group_by(["seg"]).agg(pairs=agg.count(), first_zone=agg.min("pid"))


@register(f"select seg, count(*) n, round(avg(val), 4) mean_val from ({C}) where x between 20 and 80 and y between 20 and 80 group by seg")
def agg_non_join(spark, d):
    out = customers(spark, d).lazy().range_query(20, 20, 80, 80).group_by("seg").agg(n=agg.count(), mean_val=agg.mean("val"))
    return out.withColumn("mean_val", F.round("mean_val", 4))


@register(f"select count(*) n, max(val) high from ({C}) where x between 20 and 80 and y between 20 and 80")
def agg_global(spark, d):
    return customers(spark, d).lazy().range_query(20, 20, 80, 80).group_by().agg(n=agg.count(), high=agg.max("val"))


@register(f"select pid, count(*) n, coalesce(round(sum(v), 2), 0) total, count(v) > 0 has_value from (select pid, id, case when pid % 2 = 0 then val end v from ({Z}), ({C}) where {INSIDE}) group by pid")
def agg_nulls(spark, d):
    """Nulls are skipped by sum, and a group of nulls sums to 0."""
    met = zones(spark, d).lazy().within_join(customers(spark, d).df, "x", "y").to_df()
    held = met.withColumn("v", F.when(F.col("pid") % 2 == 0, F.col("val")))
    out = SpatialFrame(held, "x", "y").lazy().group_by("pid").agg(n=agg.count(), total=agg.sum("v"), has_value=agg.max("v"))
    return out.withColumns({"total": F.round("total", 2), "has_value": F.col("has_value").isNotNull()})


@register(f"select pid, count(*) n, round(avg(fare), 4) mean_fare from (select pid, fare from ({Z}), (select px, py, fare from ({T})) where {BOX_D.format(x='px', y='py')} <= 0.5) group by pid")
def agg_distance_join(spark, d):
    out = zones(spark, d).lazy().polygon_within_distance_join(trips(spark, d), "px", "py", 0.5).group_by("pid").agg(n=agg.count(), mean_fare=agg.mean("fare"))
    return out.withColumn("mean_fare", F.round("mean_fare", 4))


# -- geometry functions ------------------------------------------------------------------------


@register(f"select pid, round(sum(s), 6) area from (select pid, kind, (case when kind = 'hole' then -1 else 1 end) * abs(sum(ax * b_y - bx * ay)) / 2 s from {edges_sql()} group by 1, 2) group by 1")
def polygon_areas(spark, d):
    return shapes(spark, d).polygon_areas().select("pid", F.round("area", 6).alias("area"))


def hull_sql(points: str, keys: str) -> str:
    """Hull areas of points (keys..., x, y in hundredths): a directed pair is an edge if no point lies right of it and collinear ones lie between."""
    ks = [k.strip() for k in keys.split(",")]
    same = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    cross = "(b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)"
    dot = "(b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y)"
    size = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)"
    return f"""(with pt as (select distinct {keys}, cast(round(x * 100) as bigint) x, cast(round(y * 100) as bigint) y from ({points})),
    e as (select {', '.join('a.' + k for k in ks)}, a.x ax, a.y ay, b.x bx, b.y b_y from pt a join pt b on {same('a', 'b')} and (a.x <> b.x or a.y <> b.y) join pt c on {same('a', 'c')}
          group by all having bool_and({cross} > 0 or ({cross} = 0 and {dot} between 0 and {size})))
    select {keys}, cast(sum(ax * b_y - bx * ay) as double) / 20000 area from e group by {keys})"""


@register(rounded_sql(f"select custkey, area from {hull_sql(f'select custkey, dx x, dy y from ({T})', 'custkey')}", ["custkey"], ["area"], 6))
def hull_area_by_group(spark, d):
    """The hull of every customer with two distinct ends."""
    groups = trips(spark, d).groupBy("custkey").agg(F.collect_list(F.struct(F.col("dx").alias("x"), F.col("dy").alias("y"))).alias("points"), F.count_distinct("dx", "dy").alias("n"))
    return groups.filter("n > 1").select("custkey", F.round(kernels.convex_hull_area(F.col("points")), 6).alias("area"))


@register(f"select tripkey, sqrt((px - dx) * (px - dx) + (py - dy) * (py - dy)) length from ({T})")
def point_distance(spark, d):
    """The length of every trip."""
    return trips(spark, d).select("tripkey", dist.point_distance(F.col("px"), F.col("py"), F.col("dx"), F.col("dy")).alias("length"))


@register(f"select id, round({HAVERSINE.format(a='lat', b='10', c='lon', d='20')} / 1000, 3) km from ({fx.LONLAT_SQL})")
def distance_to_point(spark, d):
    return lonlat(spark, d).select("id", F.round(dist.distance_to_point(F.col("lon"), F.col("lat"), 20, 10, "geographic") / 1000, 3).alias("km"))


@register(f"select tripkey, sqrt((px - dx) * (px - dx) + (py - dy) * (py - dy)) length from ({T})")
def wkb_point_distance(spark, d):
    """The length of every trip, from WKB."""
    t = trips(spark, d).select("tripkey", wkb.make_points(F.col("px"), F.col("py")).alias("a"), wkb.make_points(F.col("dx"), F.col("dy")).alias("b"))
    return t.select("tripkey", wkb.point_distance(F.col("a"), F.col("b")).alias("length"))


@register(f"select id, x as _x, y as _y from ({C}) where x between 10 and 30 and y between 10 and 30")
def wkb_points_frame(spark, d):
    df = customers(spark, d).df.select("id", wkb.make_points(F.col("x"), F.col("y")).alias("wkb"))
    return SpatialFrame.from_wkb_points(df, "wkb").lazy().range_query(10, 10, 30, 30).select("id", "_x", "_y").to_df()


@register(f"select id, pid from ({hits_sql(PTS)})")
def wkb_polygons_join(spark, d):
    df = shapes(spark, d).df.select("pid", wkb.make_polygons(F.col("geom")).alias("wkb"))
    frame = SpatialFrame.from_lazy(df, "wkb", "polygon")
    return frame.lazy().within_join(customers(spark, d).df, "x", "y").select("id", "pid").to_df()


# -- sources, sinks and plans --------------------------------------------------------------------


@register(f"select id, x from ({C}) where id % 2 = 0 and x between 0 and 50 and y between 0 and 50 union all select id + 1000000, x from ({C}) where id % 2 = 1 and x between 0 and 50 and y between 0 and 50")
def append_points(spark, d):
    base = load(spark, d, CUSTOMERS)
    frame = SpatialFrame(base.filter("id % 2 = 0"), "x", "y").append(base.filter("id % 2 = 1").withColumn("id", F.col("id") + 1000000))
    return frame.lazy().range_query(0, 0, 50, 50).select("id", "x").to_df()


@register(f"select pid, pname from ({Z}) where pid in (7, 3, 9) union all select pid, pname from ({Z}) where pid = 3")
def subset_polygons(spark, d):
    return zones(spark, d).subset([7, 3, 9, 3], "pid").lazy().select("pid", "pname").to_df()


@register(f"select 'low' part, count(*) n from ({C}) where x between 10 and 60 and y between 10 and 60 and val < 2000 union all select 'high', count(*) from ({C}) where x between 10 and 60 and y between 10 and 60 and val >= 2000")
def collect_all_branches(spark, d):
    shared = customers(spark, d).lazy().range_query(10, 10, 60, 60)
    from gridloom.plans.frame import SpatialPlan

    low, high = SpatialPlan.collect_all([shared.filter("val < 2000"), shared.filter("val >= 2000")])
    return low.agg(F.lit("low").alias("part"), F.count("*").alias("n")).unionByName(high.agg(F.lit("high").alias("part"), F.count("*").alias("n")))


@register(f"select id, pid from ({hits_sql(PTS)})")
def scan_and_sink(spark, d):
    """WKB polygons written to Parquet, scanned as a deferred frame, joined and written again."""
    zones_at, out = fresh_path(spark, "zones"), fresh_path(spark, "pairs")
    shapes(spark, d).df.select("pid", wkb.make_polygons(F.col("geom")).alias("wkb")).write.parquet(zones_at)
    plan = SpatialFrame.scan_parquet(spark, zones_at, "wkb", "polygon").lazy().within_join(customers(spark, d).df, "x", "y").select("id", "pid")
    plan.sink_parquet(out)
    return spark.read.parquet(out)


EVENT_POINTS = ["event_id", "ts", "event_type", "cast((event_id * 7919) % 10007 as double) / cast(100 as double) as ex", "cast((event_id * 6007) % 10009 as double) / cast(100 as double) as ey"]


@register(f"select pid, event_type, count(*) n from ({Z}), (select event_type, ex x, ey y from (select {', '.join(EVENT_POINTS)} from events)) where {INSIDE} group by all")
def stream_zone_counts(spark, d):
    """Events as a stream joined with static zones; the stream is read to its end, then counted."""
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    shapes, members = zones(spark, d).distinct_shapes()
    met = stream.within_join(source.selectExpr(*EVENT_POINTS), "ex", "ey", shapes).select("shape", "event_type")
    out = fresh_path(spark, "stream")
    met.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.schema(met.schema).parquet(f"{out}/rows").groupBy("shape", "event_type").agg(F.count("*").alias("n"))
    return counts.join(members.select("shape", "pid"), "shape").groupBy("pid", "event_type").agg(F.sum("n").alias("n"))


@register(f"select date_trunc('day', ts) as day, pid, count(*) n from ({Z}), (select ts, ex x, ey y from (select {', '.join(EVENT_POINTS)} from events)) where {INSIDE} group by all")
def stream_window_counts(spark, d):
    """Events of a stream per zone and day of event time; the last state of every window."""
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    events = source.selectExpr(*EVENT_POINTS).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.windowed_zone_counts(events, "ts", "ex", "ey", zones(spark, d), "pid", "1 day", "2 days")
    out = fresh_path(spark, "windows")
    last = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/rows")
    counts.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "pid", "n")


@register(f"select id, x from ({C}) where (x between 0 and 50 and y between 0 and 50) and not (x between 20 and 30 and y between 0 and 100) union all select id, x from ({C}) where x between 90 and 95")
def set_operations(spark, d):
    """Rows in one box but not in another, with the rows of a third."""
    c = customers(spark, d)
    both = c.range_filter(0, 0, 50, 50).subtract(c.range_filter(0, 0, 50, 50).intersect(c.range_filter(20, 0, 30, 100)))
    return both.union(c.range_filter(90, -1000, 95, 1000)).df.select("id", "x")


@register(f"""select a.pid, round(a.area, 6) area, h.pid is not null inside, gl.d from (select pid, sum(s) area from (select pid, kind, (case when kind = 'hole' then -1 else 1 end) * abs(sum(ax * b_y - bx * ay)) / 2 s from {edges_sql()} group by 1, 2) group by 1) a
left join ({hits_sql('select 1 id, cast(41.5 as double) x, cast(52.5 as double) y')}) h on h.pid = a.pid join (select pid, sqrt(x0 * x0 + y0 * y0) d from ({Z})) gl on gl.pid = a.pid""")
def sql_text(spark, d):
    """Areas, containment and distances asked in SQL text with the registered functions."""
    sql_functions.register(spark)
    return spark.sql("""select pid, round(gl_area(geom), 6) as area, gl_contains(geom, 41.5D, 52.5D) as inside, gl_distance(0, 0, geom[0][0][0].x, geom[0][0][0].y) as d
        from {zones} where gl_in_box(geom[0][0][0].x, geom[0][0][0].y, -1, -1, 200, 200)""", zones=shapes(spark, d).df)


@register(f"select id, x from ({C}) where x between 0 and 60 and y between 0 and 60")
def collect_in_batches(spark, d):
    """A plan's rows fetched in lists of 40 and put together again."""
    plan = customers(spark, d).lazy().range_query(0, 0, 60, 60).select("id", "x")
    return spark.createDataFrame([r for rows in plan.collect_batched(40) for r in rows], "id long, x double")


@register("select n_nationkey id, cast((n_nationkey * 7) % 25 as double) x, cast((n_nationkey * 11) % 25 as double) y from nation where (n_nationkey * 7) % 25 between 5 and 20 and (n_nationkey * 11) % 25 between 0 and 15")
def coordinate_lists(spark, d):
    """A frame over two lists that the caller holds; their positions are the ids."""
    keys = [r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect()]
    frame = arrays.from_coords(spark, [k * 7 % 25 for k in keys], [k * 11 % 25 for k in keys])
    return frame.lazy().range_query(5, 0, 20, 15).select("id", "x", "y").to_df()


# -- end-to-end queries ----------------------------------------------------------------------------


@register(f"select tripkey, px, py, ts, sqrt((px - 50) * (px - 50) + (py - 50) * (py - 50)) distance from ({T}) where sqrt((px - 50) * (px - 50) + (py - 50) * (py - 50)) <= 5 order by distance, tripkey limit 100")
def q1(spark, d):
    near = SpatialFrame(trips(spark, d), "px", "py").radius_query(50, 50, 5)
    return near.select("tripkey", "px", "py", "ts", dist.distance_to_point(F.col("px"), F.col("py"), 50, 50).alias("distance")).orderBy("distance", "tripkey").limit(100)


@register(f"select count(*) trips from ({T}), (select * from ({Z}) where pid = 7) where px between x0 and x1 and py between y0 and y1")
def q2(spark, d):
    z = load(spark, d, ZONES).filter("pid = 7").first()
    near = SpatialFrame(trips(spark, d), "px", "py").points_within_distance_of_polygon(geo.box(z["x0"], z["y0"], z["x1"], z["y1"]), 0.0)
    return near.agg(F.count("*").alias("trips"))


@register(f"""select cast(date_trunc('month', ts) as timestamp) as month, count(*) trips, round(avg(sqrt((px - dx) * (px - dx) + (py - dy) * (py - dy))), 6) mean_length, round(avg(dur), 6) mean_dur, round(avg(fare), 4) mean_fare
from (select *, 30 x0, 40 y0, 44 x1, 52 y1 from ({T})) where {BOX_D.format(x='px', y='py')} <= 2 group by 1""")
def q3(spark, d):
    near = SpatialFrame(trips(spark, d), "px", "py").points_within_distance_of_polygon(geo.box(30, 40, 44, 52), 2)
    length = dist.planar(F.col("px"), F.col("py"), F.col("dx"), F.col("dy"))
    out = near.groupBy(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(
        F.count("*").alias("trips"), F.round(F.avg(length), 6).alias("mean_length"), F.round(F.avg("dur"), 6).alias("mean_dur"), F.round(F.avg("fare"), 4).alias("mean_fare"))
    return out.orderBy("month")


@register(f"select pid, pname, count(*) trips from (select px x, py y from ({T}) order by fare desc, tripkey limit 1000), ({Z}) where {INSIDE} group by all")
def q4(spark, d):
    top = trips(spark, d).orderBy(F.desc("fare"), "tripkey").limit(1000).select("tripkey", "px", "py")
    out = zones(spark, d).lazy().within_join(top, "px", "py").group_by(["pid", "pname"]).agg(trips=agg.count())
    return out.orderBy(F.desc("trips"), "pid")


@register(f"""with g as (select custkey, count(*) n from ({T}) group by 1 having count(*) > 5)
select g.custkey, c_name as name, n, round(area, 6) area from g join (select custkey, area from {hull_sql(f'select custkey, dx x, dy y from ({T}) where custkey in (select o_custkey from orders group by 1 having count(*) > 5)', 'custkey')}) h on g.custkey = h.custkey
join customer on c_custkey = g.custkey order by area desc, g.custkey limit 100""")
def q5(spark, d):
    groups = trips(spark, d).groupBy("custkey").agg(F.count("*").alias("n"), F.collect_list(F.struct(F.col("dx").alias("x"), F.col("dy").alias("y"))).alias("points")).filter("n > 5")
    area = groups.select("custkey", "n", F.round(kernels.convex_hull_area(F.col("points")), 6).alias("area"))
    names = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"))
    return area.join(names, "custkey").orderBy(F.desc("area"), "custkey").limit(100).select("custkey", "name", "n", "area")


ZONE_STATS = "count(*) trips, round(avg(fare), 4) mean_fare, round(avg(dur), 4) mean_dur"


@register(f"select pid, pname, {ZONE_STATS} from (select * from ({Z}) where x0 <= 70 and x1 >= 30 and y0 <= 70 and y1 >= 30), (select px x, py y, fare, dur from ({T})) where {INSIDE} group by all")
def q6(spark, d):
    some = zones(spark, d).range_filter(30, 30, 70, 70)
    out = some.lazy().within_join(trips(spark, d), "px", "py").group_by("pid", "pname").agg(trips=agg.count(), mean_fare=agg.mean("fare"), mean_dur=agg.mean("dur"))
    return rounded(out, "mean_fare", "mean_dur", digits=4).orderBy(F.desc("trips"), "pid")


@register(f"select * from (select tripkey, fare, length, case when length <> 0 then fare / length end ratio from (select tripkey, fare, sqrt((px - dx) * (px - dx) + (py - dy) * (py - dy)) length from ({T}))) order by ratio desc nulls last, fare desc, tripkey limit 100")
def q7(spark, d):
    t = trips(spark, d).select("tripkey", "fare", dist.planar(F.col("px"), F.col("py"), F.col("dx"), F.col("dy")).alias("length"))
    ratio = F.when(F.col("length") != 0, F.col("fare") / F.col("length"))
    return t.withColumn("ratio", ratio).orderBy(F.col("ratio").desc_nulls_last(), F.desc("fare"), "tripkey").limit(100)


@register(f"select bkey, bname, count(*) trips from ({B}), (select px, py from ({T})) where px between x0 - 1 and x1 + 1 and py between y0 - 1 and y1 + 1 and {BOX_D.format(x='px', y='py')} <= 0.5 group by all order by trips desc, bkey limit 100")
def q8(spark, d):
    out = buildings(spark, d).lazy().polygon_within_distance_join(trips(spark, d).select("px", "py"), "px", "py", 0.5).group_by("bkey", "bname").agg(trips=agg.count())
    return out.orderBy(F.desc("trips"), "bkey").limit(100)


@register(f"{rounded_sql(overlaps_sql(B, 'bkey'), ['bkey_1', 'bkey_2'], MEASURES)} order by iou desc, bkey_1, bkey_2 limit 100")
def q9(spark, d):
    return rounded(buildings(spark, d).closest_pairs("bkey", 100), *MEASURES).orderBy(F.desc("iou"), "bkey_1", "bkey_2").limit(100)


@register(f"""select z.pid, z.pname, coalesce(trips, 0) trips, mean_fare, mean_dur from ({Z}) z left join (select pid, {ZONE_STATS} from ({Z}), (select px x, py y, fare, dur from ({T})) where {INSIDE} group by 1) s on z.pid = s.pid
order by mean_dur desc nulls last, z.pid limit 100""")
def q10(spark, d):
    z = zones(spark, d)
    stats = z.lazy().within_join(trips(spark, d), "px", "py").group_by("pid").agg(trips=agg.count(), mean_fare=agg.mean("fare"), mean_dur=agg.mean("dur"))
    out = z.df.select("pid", "pname").join(rounded(stats, "mean_fare", "mean_dur", digits=4), "pid", "left").withColumn("trips", F.coalesce("trips", F.lit(0)))
    return out.orderBy(F.col("mean_dur").desc_nulls_last(), "pid").limit(100)


@register(f"""with a as (select tripkey, pid from (select tripkey, px x, py y from ({T})), ({Z}) where {INSIDE}), b as (select tripkey, pid from (select tripkey, dx x, dy y from ({T})), ({Z}) where {INSIDE})
select count(*) trips from a join b on a.tripkey = b.tripkey and a.pid <> b.pid""")
def q11(spark, d):
    """Pairs of a start zone and another end zone, counted as all pairs of a trip less those of one pid; the pairs are never formed."""
    shapes, members = zones(spark, d).distinct_shapes()
    t, held = trips(spark, d), members.filter("pid is not null").groupBy("shape", "pid").agg(F.count("*").alias("m"))
    held_too = held.select(F.col("shape").alias("end_shape"), "pid", F.col("m").alias("end_m"))
    number = F.broadcast(held.groupBy("shape").agg(F.sum("m").alias("n")))
    same = F.broadcast(held.join(held_too, "pid").groupBy("shape", "end_shape").agg(F.sum(F.col("m") * F.col("end_m")).alias("c")))
    at = lambda x, y: shapes.lazy().within_join(t.select("tripkey", x, y), x, y).select("tripkey", "shape").to_df()
    start, end = at("px", "py"), at("dx", "dy")
    count = lambda met, name: met.join(number, "shape").groupBy("tripkey").agg(F.sum("n").alias(name))
    every = count(start, "a").join(count(end, "b"), "tripkey").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n"))
    one = start.join(same, "shape").join(end.withColumnRenamed("shape", "end_shape"), ["tripkey", "end_shape"]).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("less"))
    return every.crossJoin(one).select((F.col("n") - F.col("less")).alias("trips"))


@register(f"""select tripkey, round(avg(dd), 6) mean_distance from (select tripkey, dd, row_number() over (partition by tripkey order by dd, bkey) r from (select tripkey, bkey, {BOX_D.format(x='px', y='py')} dd from (select tripkey, px, py from ({T})), ({B})))
where r <= 5 group by 1 order by round(avg(dd), 6) desc, tripkey limit 100""")
def q12(spark, d):
    near = buildings(spark, d).lazy().polygon_knn_join(trips(spark, d).select("tripkey", "px", "py"), "px", "py", 5, tie="bkey").to_df()
    out = near.groupBy("tripkey").agg(F.round(F.avg("distance_to_polygon"), 6).alias("mean_distance"))
    return out.orderBy(F.desc("mean_distance"), "tripkey").limit(100)
