import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom import SpatialFrame
from gridloom.functions import geometry as geo
from gridloom.functions import kernels, wkb


def cloud(rng, n, clustered=False):
    centres = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(3)]
    out = []
    for _ in range(n):
        cx, cy = rng.choice(centres)
        out.append((rng.gauss(cx, 1), rng.gauss(cy, 1)) if clustered else (rng.uniform(-50, 50), rng.uniform(-50, 50)))
    return out


def points(spark, pts, key="id"):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], f"{key} long, {key}x double, {key}y double")


def shapes(rng, n):
    out = []
    for i in range(n):
        x, y, w = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.3, 2, 5, 40])
        if i % 3 == 0:
            out.append(geo.box(x, y, x + w, y + w))
        elif i % 3 == 1:
            out.append([[[(x, y), (x + w, y), (x, y + w)]]])
        else:
            out.append([[[(x, y), (x + w, y), (x + w, y + w), (x, y + w)], [(x + w / 4, y + w / 4), (x + w / 2, y + w / 4), (x + w / 2, y + w / 2)]], geo.box(x + 2 * w, y, x + 3 * w, y + w)[0]])
    return out


def polygon_frame(spark, polys):
    return SpatialFrame.from_wkb_polygons(spark.createDataFrame([(i, bytearray(wkb.encode_polygon(p))) for i, p in enumerate(polys)], "pid long, wkb binary"), "wkb")


def distance(poly, x, y):
    e = kernels.edge_array(geo.edges_of_parts(poly))
    if kernels._inside(e, x, y):
        return 0.0
    best = math.inf
    for ax, ay, bx, by in e:
        dx, dy = bx - ax, by - ay
        t = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def rows(df, *c):
    return sorted(tuple(r) for r in df.select(*c).collect())


@pytest.mark.parametrize("clustered", [False, True])
def test_point_joins_match_brute_force(spark, clustered):
    rng = random.Random(4 + clustered)
    t, q = cloud(rng, 300, clustered), cloud(rng, 40) + [(400.0, -300.0)]
    frame, probe = SpatialFrame(points(spark, t), "idx", "idy"), points(spark, q, "q")
    want = sorted((i, j) for i, a in enumerate(q) for j, b in enumerate(t) if math.hypot(a[0] - b[0], a[1] - b[1]) <= 3)
    assert rows(frame.lazy().within_distance_join(probe, "qx", "qy", 3).to_df(), "q", "id") == want
    near = sorted((i, j) for i, a in enumerate(q) for j in sorted(range(len(t)), key=lambda j: (math.hypot(a[0] - t[j][0], a[1] - t[j][1]), j))[:4])
    assert rows(frame.lazy().knn_join(probe, "qx", "qy", 4, tie="id").to_df(), "q", "id") == near


def test_knn_with_more_than_there_are(spark):
    frame, probe = SpatialFrame(points(spark, [(0.0, 0.0), (5.0, 5.0)]), "idx", "idy"), points(spark, [(1.0, 1.0)], "q")
    assert frame.lazy().knn_join(probe, "qx", "qy", 9).to_df().count() == 2
    assert SpatialFrame(points(spark, [(0.0, 0.0)]).limit(0), "idx", "idy").lazy().knn_join(probe, "qx", "qy", 2).to_df().count() == 0


def test_polygon_joins_match_brute_force(spark):
    rng = random.Random(6)
    polys, q = shapes(rng, 60), cloud(rng, 60) + [(300.0, 10.0)]
    frame, probe = polygon_frame(spark, polys), points(spark, q, "q")
    d = {(i, j): distance(p, *a) for i, a in enumerate(q) for j, p in enumerate(polys)}
    inside = sorted(k for k in d if kernels._inside(kernels.edge_array(geo.edges_of_parts(polys[k[1]])), *q[k[0]]))
    assert rows(frame.lazy().within_join(probe, "qx", "qy").to_df(), "q", "pid") == inside
    assert rows(frame.lazy().polygon_within_distance_join(probe, "qx", "qy", 2.5).to_df(), "q", "pid") == sorted(k for k in d if d[k] <= 2.5)
    got = rows(frame.lazy().polygon_knn_join(probe, "qx", "qy", 3, tie="pid").to_df(), "q", "pid", "distance_to_polygon")
    want = sorted((i, j, d[i, j]) for i in range(len(q)) for j in sorted(range(len(polys)), key=lambda j: (round(d[i, j], 9), j))[:3])
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(math.isclose(g[2], w[2], abs_tol=1e-9) for g, w in zip(got, want))
    ordered = frame.lazy().polygon_knn_join(probe, "qx", "qy", 3, sorted_output=True).to_df().collect()
    assert [r["distance_to_polygon"] for r in ordered] == sorted(r["distance_to_polygon"] for r in ordered)


def test_nearest_by_exact_distance_under_covering_boxes(spark):
    bent = lambda n: [(-n, -n), (8, -n), (8, 1), (1, 1), (1, 8), (-n, 8)]  # an L whose box holds the probe
    polys = [geo.as_parts(bent(n)) for n in range(3)] + [geo.box(5.5, 6, 7, 7)]
    out = polygon_frame(spark, polys).lazy().polygon_knn_join(points(spark, [(5.0, 5.0)], "q"), "qx", "qy", 1).to_df().first()
    assert (out["pid"], out["distance_to_polygon"]) == (3, math.hypot(0.5, 1))


def test_clustered_and_repeated_probes(spark):
    rng = random.Random(12)
    t = cloud(rng, 200, True) + [(1.0, 1.0)] * 40
    q = [(1.0, 1.0)] * 30 + cloud(rng, 30, True)
    frame, probe = SpatialFrame(points(spark, t), "idx", "idy"), points(spark, q, "q")
    near = sorted((i, j) for i, a in enumerate(q) for j in sorted(range(len(t)), key=lambda j: (math.hypot(a[0] - t[j][0], a[1] - t[j][1]), j))[:5])
    assert rows(frame.lazy().knn_join(probe, "qx", "qy", 5, tie="id").to_df(), "q", "id") == near


def test_pairs_without_a_key(spark):
    polys = shapes(random.Random(13), 20)
    frame = polygon_frame(spark, polys)
    assert frame.intersects_pairs().count() == frame.intersects_pairs("pid").count() > 0


def test_intersecting_pairs_match_kernels(spark):
    polys = shapes(random.Random(8), 45)
    e = [kernels.edge_array(geo.edges_of_parts(p)) for p in polys]
    want = {(i, j): kernels.overlap_area(e[i], e[j]) for i in range(45) for j in range(i + 1, 45) if kernels.intersects(e[i], e[j])}
    got = {(r["pid_1"], r["pid_2"]): r["overlap_area"] for r in polygon_frame(spark, polys).intersects_pairs("pid").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    touch = polygon_frame(spark, [geo.box(0, 0, 1, 1), geo.box(1, 0, 2, 1), geo.box(0, 0, 2, 2)]).intersects_pairs("pid").orderBy("pid_1", "pid_2").collect()
    assert [(r["overlap_area"], r["iou"]) for r in touch] == [(0, 0), (1, 0.25), (1, 0.25)]


def test_collisions_and_filters(spark):
    t = SpatialFrame(spark.createDataFrame([(1, "t", 0.0, 0.0), (2, "u", 0.0, 0.0)], "id long, name string, x double, y double"), "x", "y")
    q = spark.createDataFrame([(7, 0.0, 0.0)], "id long, x double, y double")
    out = t.lazy().filter("name = 't'").within_distance_join(q, "x", "y", 0).to_df()
    assert out.columns == ["id", "x", "y", "right_id", "name", "right_x", "right_y"] and [tuple(r)[:5] for r in out.collect()] == [(7, 0, 0, 1, "t")]


def test_no_cartesian_product(spark):
    rng = random.Random(1)
    frame, probe = polygon_frame(spark, shapes(rng, 30)), points(spark, cloud(rng, 30), "q")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (frame.lazy().polygon_within_distance_join(probe, "qx", "qy", 1), frame.lazy().polygon_knn_join(probe, "qx", "qy", 2)):
            text = plan.explain(physical=True)
            assert "CartesianProduct" not in text and "NestedLoop" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stream_of_points_against_zones(spark, tmp_path):
    from gridloom.streaming import joins as sj

    rng = random.Random(2)
    polys, q = shapes(rng, 20), cloud(rng, 50)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    points(spark, q, "q").write.parquet(src)
    frame = polygon_frame(spark, polys)
    stream = spark.readStream.schema("q long, qx double, qy double").parquet(src)
    met = sj.within_join(stream, "qx", "qy", frame).select("q", "pid")
    met.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.schema("q long, pid long").parquet(out), "q", "pid") == rows(frame.lazy().within_join(spark.read.parquet(src), "qx", "qy").to_df(), "q", "pid")
    seen = []
    knn = sj.each_batch_knn(frame, "qx", "qy", 1, lambda df, i: seen.append(df.count()))
    stream.writeStream.foreachBatch(knn).option("checkpointLocation", str(tmp_path / "state2")).trigger(availableNow=True).start().awaitTermination()
    assert sum(seen) == 50


def test_stream_near_points_and_windows(spark, tmp_path):
    from gridloom.streaming import joins as sj

    rng = random.Random(3)
    t, q, src = cloud(rng, 40), cloud(rng, 60), str(tmp_path / "in")
    late = spark.createDataFrame([(i, x, y, 3600 * (i % 5)) for i, (x, y) in enumerate(q)], "q long, qx double, qy double, s long")
    late.selectExpr("q", "qx", "qy", "timestamp_seconds(s) as ts").write.parquet(src)
    stream = spark.readStream.schema("q long, qx double, qy double, ts timestamp").parquet(src)
    target = SpatialFrame(points(spark, t), "idx", "idy")
    out = str(tmp_path / "near")
    met = sj.within_distance_join(stream, "qx", "qy", target, 9.0).select("q", "id")
    met.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out), "q", "id") == sorted((i, j) for i, a in enumerate(q) for j, b in enumerate(t) if math.hypot(a[0] - b[0], a[1] - b[1]) <= 9)
    zone = polygon_frame(spark, [geo.box(-50, -50, 0, 50), geo.box(0, -50, 50, 50)])
    seen = {}
    counts = sj.windowed_zone_counts(stream, "ts", "qx", "qy", zone, "pid", "1 hour", "2 hours")
    keep = lambda df, i: seen.update({(r["window"]["start"].hour, r["pid"]): r["n"] for r in df.collect()})
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for i, (x, _) in enumerate(q):
        want[i % 5, int(x >= 0)] = want.get((i % 5, int(x >= 0)), 0) + 1
    assert sum(seen.values()) == 60 and sorted(seen.values()) == sorted(want.values())


def test_set_operations_keep_the_geometry(spark):
    a, b = polygon_frame(spark, [geo.box(0, 0, 1, 1), geo.box(1, 1, 2, 2)]), polygon_frame(spark, [geo.box(0, 0, 1, 1), geo.box(5, 5, 7, 7)])
    assert rows(a.intersect(b).polygon_areas(), "pid", "area") == [(0, 1.0)]
    assert rows(a.subtract(b).polygon_areas(), "pid", "area") == [(1, 1.0)]
    assert rows(a.union(b).polygon_areas(), "pid", "area") == [(0, 1.0), (0, 1.0), (1, 1.0), (1, 4.0)]


def test_sources(spark, tmp_path):
    import numpy as np
    import pyarrow as pa

    from gridloom.sources import arrays

    xy = np.array([[1.0, 2.0], [3.0, 4.0]])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(xy.reshape(-1)), 2)
    struct = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    for made in (xy, flat, struct, [tuple(p) for p in xy], [wkb.encode_point(*p) for p in xy]):
        assert arrays.from_geometries(spark, made).extent == (1, 2, 3, 4)
    with pytest.raises(ValueError):
        arrays.from_coords(spark, [1], [1, 2])
    path = str(tmp_path / "z")
    spark.createDataFrame([(1, bytearray(wkb.encode_polygon(geo.box(0, 0, 1, 1))))], "id long, g binary").write.parquet(path)
    frame = SpatialFrame.scan_parquet(spark, [path], "g", "polygon")
    assert frame.lazy().contains(0.5, 0.5).to_df().columns == ["id", "g"] and frame.lazy().contains(0.5, 0.5).select("id").to_df().count() == 1
    assert arrays.from_xy_column(spark.createDataFrame([([1.0, 2.0],)], "p array<double>"), "p").extent == (1, 2, 1, 2)
