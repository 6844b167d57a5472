import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import SpatialFrame, agg
from gridloom.functions import geometry as geo
from gridloom.operators import counts, joins
from tests.test_joins import points, polygon_frame, rows


def cases(rng, n, m, lattice):
    at = lambda: rng.randrange(0, 1000) / 100 if lattice else rng.uniform(0, 10)
    return [(at(), at()) for _ in range(n)], [(x, y, x + rng.choice([0.25, 1, 2.5]), y + rng.choice([0.5, 1.75])) for x, y in ((at(), at()) for _ in range(m))]


@pytest.mark.parametrize("lattice", [True, False])
@pytest.mark.parametrize("d", [0.0, 0.5, 3.0])
def test_tiles_count_as_the_formula(lattice, d, monkeypatch):
    pts, boxes = cases(random.Random(4), 700, 150, lattice)
    pts += pts[:50] + [(20.0, 5.0)]
    p, b = np.array(pts), np.array(boxes)
    dx = np.maximum(np.maximum(b[:, None, 0] - p[None, :, 0], p[None, :, 0] - b[:, None, 2]), 0)
    dy = np.maximum(np.maximum(b[:, None, 1] - p[None, :, 1], p[None, :, 1] - b[:, None, 3]), 0)
    want = (np.sqrt(dx * dx + dy * dy) <= d).sum(axis=1)
    for at_once in (1 << 20, 64):
        monkeypatch.setattr(counts, "AT_ONCE", at_once)
        assert (counts.count_tile(p[:, 0], p[:, 1], b, d) == want).all()
    assert (counts.count_tile(p[:1, 0], p[:1, 1], b, d) == (np.sqrt(dx * dx + dy * dy) <= d)[:, :1].sum(axis=1)).all()


def test_counts_come_from_tiles(spark, monkeypatch):
    pts, boxes = cases(random.Random(9), 300, 80, True)
    frame = polygon_frame(spark, [geo.box(*b) for b in boxes])
    plan = frame.lazy().polygon_within_distance_join(points(spark, pts), "idx", "idy", 0.5)
    want = rows(plan.to_df().groupBy("pid").agg(F.count("*").alias("n")), "pid", "n")
    monkeypatch.setattr(joins, "COUNTED_ROWS", 1)
    monkeypatch.setattr(counts, "TILE_POINTS", 7)
    monkeypatch.setattr(joins.Side, "expand", lambda self, met: met.filter(F.lit(False)))
    got = plan.group_by("pid").agg(n=agg.count())
    assert rows(got, "pid", "n") == want
