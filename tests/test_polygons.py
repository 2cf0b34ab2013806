"""Scan-line overlap of polygons against filling every pixel's centre."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.functions.polygons import overlap_of


def filled(points, size=40):
    px, py = np.meshgrid(np.arange(size) + 0.5 - 5, np.arange(size) + 0.5 - 5)
    inside = np.zeros((size, size), bool)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        if ay != by:
            inside ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    return inside


POLYGON = st.lists(st.tuples(st.integers(0, 60).map(lambda v: v / 2 - 4), st.integers(0, 60).map(lambda v: v / 2 - 4)), min_size=3, max_size=7)
dicts = lambda poly: [{"x": x, "y": y} for x, y in poly]


@settings(max_examples=250, deadline=None)
@given(POLYGON, st.lists(POLYGON, min_size=1, max_size=3))
def test_any_polygons(truth, found):
    a, b = filled(truth), np.any([filled(p) for p in found], axis=0)
    both, union = int((a & b).sum()), int((a | b).sum())
    want = (both / union if union else 0.0, both / a.sum() if a.any() else 0.0, both / b.sum() if b.any() else 0.0)
    assert overlap_of(dicts(truth), [dicts(p) for p in found]) == pytest.approx(want)


def test_a_large_polygon_needs_little_memory():
    import tracemalloc

    square = dicts([(0, 0), (20_000, 0), (20_000, 20_000), (0, 20_000)])
    half = dicts([(0, 0), (10_000, 0), (10_000, 20_000), (0, 20_000)])
    tracemalloc.start()
    assert overlap_of(square, [half]) == (0.5, 0.5, 1.0)
    assert tracemalloc.get_traced_memory()[1] < 5e6
    tracemalloc.stop()
    assert overlap_of(square, []) == overlap_of(None, [square]) == overlap_of(dicts([(0, 0), (1, 1)]), [square]) == (0.0, 0.0, 0.0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), POLYGON), st.lists(POLYGON, max_size=3)), min_size=1, max_size=6), st.sampled_from([1, 300, 1_000_000]))
def test_batches_are_their_rows(rows, crossings):
    import pyarrow as pa

    from gondola.functions import polygons

    ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    before, polygons.CROSSINGS = polygons.CROSSINGS, crossings
    try:
        t, p = [a and dicts(a) for a, _ in rows], [[dicts(q) for q in b] for _, b in rows]
        assert [tuple(r) for r in polygons.overlaps_of(pa.array(t, ring), pa.array(p, pa.list_(ring)))] == [pytest.approx(overlap_of(a, b)) for a, b in zip(t, p, strict=True)]
    finally:
        polygons.CROSSINGS = before
