"""Places that rows share are met once; coordinates out of range count around the globe."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom import SpatialFrame
from gridloom.operators import boxjoin, joins
from tests.test_joins import points, rows


def metres(a, b):
    (lon1, lat1), (lon2, lat2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))


def globe(n):
    rng = random.Random(5)
    return [(rng.uniform(-420, 420), rng.uniform(-210, 210)) for _ in range(n)] + [(0.0, 0.0), (2.6950, 0.0), (180.0, 0.0), (-180.0, 0.0), (10.0, 90.0), (190.0, 89.5)]


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("centre, reach", [((2.35, 48.85), 5e6), ((0.0, 0.0), 299_800), ((179.0, -60.0), 2e6), ((0.0, 0.0), 3e7)])
def test_radius_counts_around_the_globe(spark, centre, reach):
    pts = globe(300)
    frame = SpatialFrame(points(spark, pts), "idx", "idy", coordinate_system="geographic")
    assert rows(frame.radius_query(*centre, reach), "id") == [(i,) for i, p in enumerate(pts) if metres(p, centre) <= reach]


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("reach", [299_800, 2_500_000])
def test_distance_joins_count_around_the_globe(spark, reach):
    pts = globe(120)
    frame = SpatialFrame(points(spark, pts), "idx", "idy", coordinate_system="geographic")
    got = frame.lazy().within_distance_join(points(spark, pts, "q"), "qx", "qy", reach).to_df()
    assert rows(got, "q", "id") == sorted((i, j) for i, a in enumerate(pts) for j, b in enumerate(pts) if metres(a, b) <= reach)


@pytest.mark.parametrize("from_few, to_few", [(True, True), (True, False), (False, True)])
def test_shared_places_are_met_once(spark, monkeypatch, from_few, to_few):
    rng = random.Random(2)
    cloud = lambda few: [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(9 if few else 45)] * (5 if few else 1)
    q, t = cloud(from_few), cloud(to_few)
    seen = []
    whole = boxjoin.box_join
    monkeypatch.setattr(joins, "box_join", lambda left, a, right, b, *rest, **more: seen.append((left.count(), right.count())) or whole(left, a, right, b, *rest, **more))
    got = SpatialFrame(points(spark, t), "idx", "idy").lazy().within_distance_join(points(spark, q, "q"), "qx", "qy", 4.0).to_df()
    assert rows(got, "q", "id") == sorted((i, j) for i, a in enumerate(q) for j, b in enumerate(t) if math.hypot(a[0] - b[0], a[1] - b[1]) <= 4)
    assert seen == [(9 if from_few else 45, 9 if to_few else 45)]
