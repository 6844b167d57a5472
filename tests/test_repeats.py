"""Tables whose rows share geometries or places: each distinct one is met once, and all rows come back."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom import SpatialFrame
from gridloom.functions import geometry as geo
from gridloom.functions import kernels
from gridloom.operators import joins
from gridloom.plans.frame import GEOM
from tests.test_joins import cloud, distance, points, polygon_frame, rows, shapes

COPIES = 5


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    kinds = shapes(rng, 12)
    polys = [kinds[i % 12] for i in range(12 * COPIES)]
    pts = cloud(rng, 30)
    return polys, pts, polygon_frame(spark, polys), points(spark, pts)


def side_of(frame, **few):
    return joins.polygon_side(frame._df, ["pid"], GEOM, **few)


def test_distinct_geometries_are_met_once(case):
    side = side_of(case[2])
    assert side.rows.count() == 12 and side.members.count() == 12 * COPIES
    assert joins.contains(joins.probe_side(case[3], "idx", "idy"), side).count() * COPIES == case[2].lazy().within_join(case[3], "idx", "idy").to_df().count()


def test_knn_needs_few_rows_of_a_geometry(case):
    polys, pts, frame, probes = case
    assert side_of(frame, keep=[F.col("t_pid")], most=3).members.count() == 12 * 3
    for k in (3, 7, 100):
        got = frame.lazy().polygon_knn_join(probes, "idx", "idy", k, tie="pid").to_df()
        want = [(i, p) for i, (x, y) in enumerate(pts) for _, p in sorted((round(distance(polys[p], x, y), 9), p) for p in range(len(polys)))[:k]]
        assert rows(got, "id", "pid") == sorted(want)
        worst = max(abs(r["distance_to_polygon"] - distance(polys[r["pid"]], *pts[r["id"]])) for r in got.collect())
        assert worst < 1e-9


def test_pairs_of_repeated_polygons(case):
    polys, _, frame, _ = case
    pairs = joins.intersecting_pairs(side_of(frame), F.col("t_pid"))
    edges = [kernels.edge_array(geo.edges_of_parts(p)) for p in polys]
    want = [(a, b) for a in range(len(polys)) for b in range(a + 1, len(polys)) if kernels.intersects(edges[a], edges[b])]
    assert rows(pairs, "l__o", "r__o") == want
    numbered = frame.intersects_pairs()
    assert numbered.count() == len(want) and numbered.filter("left >= right").isEmpty()
    for r in pairs.collect():
        a, b = edges[r["l__o"]], edges[r["r__o"]]
        assert abs(r["overlap_area"] - kernels.overlap_area(a, b)) < 1e-6


@pytest.mark.parametrize("reach", [0.0, 1.5])
def test_joins_of_repeated_polygons(case, reach):
    polys, pts, frame, probes = case
    plan = frame.lazy().polygon_within_distance_join(probes, "idx", "idy", reach)
    want = sorted((i, p) for i, (x, y) in enumerate(pts) for p in range(len(polys)) if distance(polys[p], x, y) <= reach)
    assert rows(plan.to_df(), "id", "pid") == want
    if not reach:
        assert rows(frame.lazy().within_join(probes, "idx", "idy").to_df(), "id", "pid") == want


def test_repeated_wkb_is_scanned_joined_and_written(spark, case, tmp_path):
    from gridloom.functions import wkb

    polys, pts, _, probes = case
    spark.createDataFrame([(i, bytearray(wkb.encode_polygon(p))) for i, p in enumerate(polys)], "pid long, wkb binary").write.parquet(str(tmp_path / "zones"))
    frame = SpatialFrame.scan_parquet(spark, str(tmp_path / "zones"), "wkb", "polygon")
    assert joins.polygon_side(frame._df, ["pid", "wkb"], GEOM).rows.count() == 12
    frame.lazy().within_join(probes, "idx", "idy").select("id", "pid").sink_parquet(str(tmp_path / "out"))
    want = sorted((i, p) for i, (x, y) in enumerate(pts) for p in range(len(polys)) if distance(polys[p], x, y) == 0)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "pid") == want


def test_aggregates_are_formed_before_the_pairs(case, monkeypatch):
    from gridloom import agg

    _, _, frame, probes = case
    probes = probes.withColumns({"kind": F.col("id") % 3, "val": F.when(F.col("id") % 4 != 0, F.col("id") * 1.5)})
    frame = SpatialFrame.from_polygons(frame._df.select((F.col("pid") % 7).alias("pid"), (F.col("pid") * 2.0).alias("w"), F.col(GEOM).alias("g")), "g")
    specs = dict(n=agg.count(), total=agg.sum("val"), mean=agg.mean("val"), low=agg.min("val"), high=agg.max("id"), w=agg.sum("w"), mean_w=agg.mean("w"), top_w=agg.max("w"))
    plan = frame.lazy().polygon_within_distance_join(probes, "idx", "idy", 1.0)
    met = plan.to_df()
    plain = [F.count("*"), F.coalesce(F.sum("val"), F.lit(0)), F.avg("val"), F.min("val"), F.max("id"), F.sum("w"), F.avg("w"), F.max("w")]
    for keys in (["pid"], ["kind"], ["pid", "kind"], []):
        want = met.groupBy(*keys).agg(*[c.alias(k) for k, c in zip(specs, plain)])
        expected = sorted(map(repr, want.collect()))
        with monkeypatch.context() as m:
            m.setattr(joins.Side, "expand", lambda self, met: met.join(self.members.limit(0), "_sid"))
            got = plan.group_by(*keys).agg(**specs)
        assert sorted(map(repr, got.collect())) == expected and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]


def odd_tables(spark, folder):
    """Suppliers and orders with repeated, null and shared keys."""
    spark.range(300).selectExpr("case when id % 50 = 3 then null when id % 40 = 7 then 7 else id end as s_suppkey", "'s' || id as s_name").write.parquet(f"{folder}/supplier.parquet")
    spark.range(4000).selectExpr("id - id % 2 * (id % 7) as o_orderkey", "id % 90 as o_custkey", "timestamp_seconds(id) as o_orderdate", "id * 1.5D as o_totalprice").write.parquet(f"{folder}/orders.parquet")


def test_trips_across_zones_of_odd_keys(spark, tmp_path, monkeypatch):
    import duckdb

    from gridloom.plans.catalogue import ORACLES, QUERIES

    odd_tables(spark, tmp_path)
    con = duckdb.connect()
    for t in ("supplier", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    monkeypatch.setattr(joins.Side, "expand", lambda self, met: met.filter(F.lit(False)) if self.members is not None else met)
    assert QUERIES["q11"](spark, str(tmp_path)).collect()[0][0] == con.sql(ORACLES["q11"]).fetchall()[0][0] > 0


def test_windows_keep_a_row_for_each_geometry(spark, tmp_path):
    from gridloom.streaming import joins as sj

    west, east = geo.box(-50, -50, 0, 50), geo.box(0, -50, 50, 50)
    zone = polygon_frame(spark, [west, west, east, west, east, east])
    zone = zone._like(zone._df.withColumn("pid", F.when(F.col("pid") == 3, 2).when(F.col("pid") != 5, F.col("pid"))))
    spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(cloud(random.Random(3), 40))], "q long, qx double, qy double").selectExpr("*", "timestamp_seconds(0) as ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("q long, qx double, qy double, ts timestamp").parquet(str(tmp_path / "in"))
    seen, state = {}, []
    counts = sj.windowed_zone_counts(stream, "ts", "qx", "qy", zone, "pid")
    query = counts.writeStream.outputMode("complete").foreachBatch(lambda df, i: seen.update({r["pid"]: r["n"] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    x = [r["qx"] for r in spark.read.parquet(str(tmp_path / "in")).collect()]
    w, e = sum(v < 0 for v in x), sum(v >= 0 for v in x)
    assert seen == {0: w, 1: w, 2: w + e, 4: e, None: e} and state == 3
