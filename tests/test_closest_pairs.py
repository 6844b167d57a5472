import random

import pytest

from gridloom.functions import geometry as geo
from gridloom.operators import joins
from tests.test_joins import polygon_frame, rows


@pytest.mark.parametrize("near", [True, False])
def test_closest_pairs_are_found_without_all_pairs(spark, monkeypatch, near):
    rng = random.Random(8)
    at = [(rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(1, 3), rng.uniform(1, 3)) for _ in range(150)]
    if near:
        at += [(x + rng.uniform(-0.05, 0.05), y + rng.uniform(-0.05, 0.05), w * rng.uniform(0.97, 1.03), h) for x, y, w, h in at[:20]]
    frame = polygon_frame(spark, [geo.box(x, y, x + w, y + h) for x, y, w, h in at])
    every = frame.intersects_pairs("pid")
    best = lambda df: rows(df.selectExpr("*", "round(iou, 6) r").orderBy("r", "pid_1", "pid_2", ascending=[False, True, True]).limit(10), "pid_1", "pid_2", "overlap_area", "iou")
    want = best(every)
    if near:
        monkeypatch.setattr(joins, "intersecting_pairs", None)
    got = frame.closest_pairs("pid", 10)
    assert best(got) == want and (not near or got.count() < every.count() / 2)
    monkeypatch.undo()
    assert rows(frame.closest_pairs("pid", 10_000), "pid_1", "pid_2") == rows(every, "pid_1", "pid_2")
