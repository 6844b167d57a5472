import warnings

import pytest
from pyspark.sql import functions as F

from gridloom import SpatialFrame, agg
from gridloom.functions import geometry as geo
from gridloom.functions import wkb
from gridloom.functions.distance import CoordinateWarning
from gridloom.plans.frame import SpatialPlan


@pytest.fixture(scope="module")
def grid(spark):
    return SpatialFrame(spark.range(96).selectExpr("id", "cast(id % 12 as double) x", "cast(floor(id / 12) as double) y", "id * 10 as v"), "x", "y")


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def polygons(spark, rows):
    made = [(i, bytearray(wkb.encode_polygon(geo.as_parts(p)))) for i, p in rows]
    return SpatialFrame.from_wkb_polygons(spark.createDataFrame(made, "id long, wkb binary"), "wkb")


HOLED = [[(0, 0), (6, 0), (6, 4), (0, 4)], [(1, 1), (5, 1), (5, 3), (1, 3)]]


def test_filters_on_points(grid):
    assert ids(grid.lazy().range_query(0, 0, 1, 1).to_df()) == [0, 1, 12, 13]
    assert ids(grid.lazy().contains(3, 4).to_df()) == [51]
    assert ids(grid.lazy().within_distance_of_point(5, 5, 1).to_df()) == [53, 64, 65, 66, 77]
    assert ids(grid.lazy().points_within_distance_of_polygon(HOLED, 0).range_query(0, 0, 2, 2).to_df()) == [0, 1, 2, 12, 13, 14, 24, 25]
    assert ids(grid.lazy().knn(0, 0, 3, tie="id").to_df()) == [0, 1, 12]
    assert ids(grid.lazy().filter("id > 50").knn(0, 0, 2, tie="id").to_df()) == [51, 60]
    assert grid.lazy().knn(0, 0, 500).to_df().count() == 96 and grid.lazy().knn(0, 0, 0).to_df().count() == 0


def test_order_of_filters_does_not_matter(grid):
    a = grid.lazy().filter(F.col("v") > 200).range_query(2, 2, 8, 8).within_distance_of_point(5, 5, 3)
    b = grid.lazy().within_distance_of_point(5, 5, 3).range_query(2, 2, 8, 8).filter("v > 200")
    assert ids(a.to_df()) == ids(b.to_df()) != []


def test_box_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).selectExpr("id", "cast(id as double) x", "cast(id as double) y").write.parquet(path)
    frame = SpatialFrame(spark.read.parquet(path), "x", "y")
    text = frame.lazy().range_query(1, 1, 3, 3).select("id").explain(physical=True)
    assert "GreaterThanOrEqual(x,1.0)" in text and "LessThanOrEqual(y,3.0)" in text
    assert "range_query" in text.splitlines()[1]


def test_filters_on_polygons(spark):
    f = polygons(spark, [(1, HOLED), (2, [(10, 10), (13, 10), (10, 12)]), (3, [HOLED, [[(20, 20), (21, 20), (21, 21), (20, 21)]]])])
    assert ids(f.lazy().contains(0.5, 0.5).to_df()) == [1, 3] and ids(f.lazy().contains(3, 2).to_df()) == []
    assert ids(f.lazy().contains(20.5, 20.5).to_df()) == [3] and ids(f.lazy().contains(12.9, 11.9).to_df()) == []
    assert ids(f.lazy().range_query(12, 11.5, 14, 13).to_df()) == []
    assert ids(f.lazy().range_query(11, 10.9, 14, 13).to_df()) == [2]
    assert ids(f.lazy().range_query(2, 1.5, 3, 2).to_df()) == [1, 3]  # holes are ignored
    assert ids(f.range_filter(20, 20, 30, 30).lazy().to_df()) == [3]
    area = {r["id"]: r["area"] for r in f.polygon_areas().collect()}
    assert area == {1: 16, 2: 3, 3: 17}
    assert "wkb" not in f.columns and ids(f.lazy().knn(12, 12, 1).to_df()) == [2]


def test_border_rules(spark):
    f = polygons(spark, [(1, geo.box(0, 0, 1, 1))])
    inside = lambda x, y: f.lazy().contains(x, y).to_df().count()
    assert (inside(0, 0.5), inside(0.5, 0), inside(1, 0.5), inside(0.5, 1)) == (1, 1, 0, 0)


def test_geographic(spark):
    rows = [("Oslo", 10.75, 59.91), ("Lisbon", -9.14, 38.72), ("Cairo", 31.24, 30.04), ("Nairobi", 36.82, -1.29), ("Gisborne", 178.02, -38.66)]
    f = SpatialFrame(spark.createDataFrame(rows, "name string, lon double, lat double"), "lon", "lat", coordinate_system="geographic")
    near = lambda d: ids(f.radius_query(10.75, 59.91, d), "name")
    assert near(3_000_000) == ["Lisbon", "Oslo"] and near(7_500_000) == ["Cairo", "Lisbon", "Nairobi", "Oslo"]
    chatham = lambda d: f.radius_query(-176.56, -43.95, d).count()  # across the date line
    assert chatham(600_000) == 0 and chatham(850_000) == 1
    with pytest.warns(CoordinateWarning):
        SpatialFrame(spark.createDataFrame([(500.0, 0.0)], "x double, y double"), "x", "y", coordinate_system="geographic")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        SpatialFrame(spark.createDataFrame([], "x double, y double"), "x", "y", coordinate_system="geographic")


def test_construction_errors(spark, grid):
    with pytest.raises(ValueError):
        SpatialFrame(grid.df, "x", "nope")
    with pytest.raises(ValueError):
        SpatialFrame(grid.df, "x", "y", coordinate_system="mars")
    with pytest.raises(TypeError):
        SpatialFrame.from_lazy(grid.df, "v", "point")
    with pytest.raises(ValueError):
        SpatialFrame.from_lazy(grid.df, "v", "line")
    with pytest.raises(ValueError):
        grid.lazy().select("id").range_query(0, 0, 1, 1)
    with pytest.raises(ValueError):
        grid.lazy().within_join(grid.df, "x", "y")
    with pytest.raises(ValueError):
        grid.lazy().group_by("id").agg()


def test_plan_sinks_and_sharing(spark, grid, tmp_path):
    assert [len(b) for b in grid.lazy().knn_join(grid.df.limit(5), "x", "y", 2).collect_batched(4)] == [4, 4, 2]
    grid.lazy().range_query(50, 50, 60, 60).sink_parquet(str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).columns == ["id", "x", "y", "v"]
    base = grid.lazy().range_query(0, 0, 4, 4)
    a, b = SpatialPlan.collect_all([base.filter("id < 12"), base.select("id")])
    assert a.count() == 5 and b.count() == 25
    with pytest.raises(ValueError):
        SpatialPlan.collect_all([])


def test_append_subset_and_introspection(spark, grid):
    more = grid.append(spark.createDataFrame([(900, 0.5, 0.5, 1)], "id long, x double, y double, v long"))
    assert 900 in ids(more.lazy().range_query(0, 0, 1, 1).to_df()) and more.n == 97
    assert grid.extent == (0, 0, 11, 7) and grid.stats()["kind"] == "point"
    assert SpatialFrame(grid.df.limit(0), "x", "y").extent is None
    assert sorted(r["id"] for r in grid.subset([3, 1, 3], "id").df.collect()) == [1, 3, 3]
    with pytest.raises(IndexError):
        grid.subset([3, 4000], "id")
    assert grid.set_index_mode("none") == "auto" and grid.set_index_mode("auto") == "none"


def test_null_coordinates_match_nothing(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 1.0, 1.0)], "id long, x double, y double")
    f = SpatialFrame(df, "x", "y")
    assert ids(f.lazy().range_query(0, 0, 5, 5).to_df()) == ids(f.lazy().knn(0, 0, 9).to_df()) == ids(f.lazy().within_distance_of_point(1, 1, 9).to_df()) == [3]
    assert ids(f.lazy().within_distance_join(df.withColumnRenamed("id", "q"), "x", "y", 1).to_df().filter("q = 3")) == [3]


def test_masks_and_hit_lists(spark, grid):
    assert sorted(r["id"] for r in grid.range_mask(0, 0, 1, 1).filter("inside").collect()) == [0, 1, 12, 13]
    mask = polygons(spark, [(1, HOLED), (2, [(10, 10), (13, 10), (10, 12)])]).contains_mask(0.5, 0.5, "hit")
    assert {r["id"]: r["hit"] for r in mask.collect()} == {1: True, 2: False}
    assert ids(grid.intersect_ranges([(0, 0, 3, 3), (2, 2, 9, 9)]).df) == [26, 27, 38, 39] and grid.intersect_ranges([]).n == 0
    met = SpatialFrame.intersect_hits([grid.lazy().range_query(0, 0, 3, 0).to_df(), grid.lazy().filter("id > 1").to_df()], "id")
    assert [r["id"] for r in met.collect()] == [2, 3]


def test_batches_without_a_join(grid):
    assert [len(b) for b in grid.lazy().filter("id < 10").collect_batched(4)] == [4, 4, 2]


def test_aggregates(spark, grid):
    met = grid.lazy().group_by("y").agg(n=agg.count(), s=agg.sum("v"), m=agg.mean("v"), low=agg.min("v"), high=agg.max("v")).orderBy("y").first()
    assert tuple(met) == (0.0, 12, 660, 55.0, 0, 110)
    nulls = SpatialFrame(spark.createDataFrame([(1.0, 1.0, None, "a"), (1.0, 1.0, float("nan"), "b")], "x double, y double, v double, s string"), "x", "y")
    row = nulls.lazy().filter("v is null").group_by("x").agg(s=agg.sum("v"), m=agg.mean("v")).first()
    assert row["s"] == 0 and row["m"] is None
    assert nulls.lazy().group_by().agg(low=agg.min("v"), t=agg.max("s")).first()["t"] == "b"
