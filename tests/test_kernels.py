import random

import numpy as np
import pytest

from gridloom.functions import geometry as geo
from gridloom.functions import kernels, wkb


def edges(parts):
    return kernels.edge_array(geo.edges_of_parts(parts))


FIELD = geo.box(0, 0, 5, 3)


def test_overlap_of_boxes_holes_and_parts():
    assert kernels.overlap_area(edges(FIELD), edges(geo.box(4, 1, 9, 9))) == pytest.approx(2)
    assert kernels.overlap_area(edges(FIELD), edges(geo.box(7, 7, 8, 9))) == 0
    holed = [[[(0, 0), (6, 0), (6, 4), (0, 4)], [(1, 1), (5, 1), (5, 3), (1, 3)]]]
    assert kernels.overlap_area(edges(holed), edges(geo.box(-1, -1, 7, 5))) == pytest.approx(16)
    assert kernels.overlap_area(edges(holed), edges(geo.box(2, 1, 5, 3))) == pytest.approx(0, abs=1e-12)
    two = geo.box(0, 0, 1, 2) + geo.box(3, 0, 4, 2)
    assert kernels.overlap_area(edges(two), edges(geo.box(0.5, 0, 3.25, 1))) == pytest.approx(0.75)


def test_overlap_of_random_triangles_by_sampling():
    rng = np.random.default_rng(3)
    for _ in range(10):
        a, b = [[[[tuple(p) for p in rng.random((3, 2))]]] for _ in range(2)]
        pts = rng.random((20000, 2))
        inside = lambda poly: np.array([kernels._inside(edges(poly), x, y) for x, y in pts[:4000]])
        assert kernels.overlap_area(edges(a), edges(b)) == pytest.approx((inside(a) & inside(b)).mean(), abs=0.04)


def test_intersects_counts_touch_and_containment():
    for other, met in ((geo.box(5, 0, 6, 1), True), (geo.box(5, 3, 6, 4), True), (geo.box(1, 1, 2, 2), True), (geo.box(5.1, 0, 6, 1), False)):
        assert kernels.intersects(edges(FIELD), edges(other)) == met


def test_hull():
    assert kernels.hull_area([0, 3, 3, 0, 1], [0, 0, 1, 1, 0.5]) == 3
    assert kernels.hull_area([2, 7], [1, 4]) == kernels.hull_area([], []) == kernels.hull_area([0, 2, 4], [0, 1, 2]) == 0
    assert kernels.hull_area([0, 2, 2, None, float("nan")], [0, 0, 3, 5, 5]) == 3


def test_wkb_variants():
    import struct

    assert wkb.decode_point(wkb.encode_point(1.5, -2)) == (1.5, -2)
    assert wkb.decode_point(struct.pack(">BIdd", 0, 1, 3, 4)) == (3, 4)
    assert wkb.decode_point(struct.pack("<BIddd", 1, 1001, 3, 4, 5)) == (3, 4)
    assert wkb.decode_point(struct.pack("<BIIddd", 1, 0x80000001 | 0x20000000, 4326, 3, 4, 5)) == (3, 4)
    holed = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], [(1.0, 0.5), (2.0, 0.5), (2.0, 1.0)]]]
    assert wkb.decode_polygon(wkb.encode_polygon(holed)) == holed
    two = holed + geo.as_parts([(9, 9), (10, 9), (10, 10)])
    assert wkb.decode_polygon(wkb.encode_polygon(two)) == two
    for bad in (b"", b"\x01", wkb.encode_polygon(holed)[:-3], wkb.encode_point(1, 2)):
        with pytest.raises(ValueError):
            wkb.decode_polygon(bad)


def test_as_parts_depths():
    ring = [(0, 0), (1, 0), (0, 1)]
    assert geo.as_parts(ring) == geo.as_parts([ring]) == geo.as_parts([[ring]])
    with pytest.raises(TypeError):
        geo.as_parts([1, 2])
