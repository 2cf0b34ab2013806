"""Polygon overlap by raster: even-odd fill of pixel centres, in Arrow batches. Built-in functions can't fill polygons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def chosen(polygons: Column, rectangles: Column) -> Column:
    """The polygons of a segmentation, or the corner points of its rotated rectangles where it has none."""
    return F.when(F.size(polygons) > 0, polygons).otherwise(F.transform(rectangles, lambda r: r["points"]))


#: Rows of pixels that are filled at a time.
STRIP = 64


def _runs(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of each row whose centres are inside, as changes: (row, column) where the filling begins or ends.

    A row of centres crosses an edge at most once; pixels from the first centre beyond a crossing on change sides.
    """
    a, b = points, np.roll(points, -1, axis=0)
    y = rows[:, None] + 0.5
    crosses = (a[None, :, 1] > y) != (b[None, :, 1] > y)
    row, edge = np.nonzero(crosses)
    rise = b[edge, 1] - a[edge, 1]
    x = (b[edge, 0] - a[edge, 0]) * (rows[row] + 0.5 - a[edge, 1]) / rise + a[edge, 0]
    return row, np.ceil(x - 0.5).astype(np.int64)


def _covered(polygons: list[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    """The stretches (row, first column, last column + 1) of the union of polygons in some rows, apart and in order."""
    sides = [_runs(p, rows) for p in polygons]
    found = []
    for i in range(len(rows)):
        spans = []
        for row, x in sides:
            ends = np.sort(x[row == i])
            spans += [(s, e) for s, e in zip(ends[::2], ends[1::2], strict=True) if s < e]
        merged: list[list[int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        found.append(np.array(merged, np.int64).reshape(-1, 2))
    return found


def overlap_of(truth, predicted) -> tuple[float, float, float]:
    """IoU, share of the truth that is covered, share of the prediction that is right; zeros if either is empty.

    Pixels are counted in stretches between crossings of scan lines, a strip of rows at a time: memory follows the number
    of edges, not the area.
    """
    polygons = [np.array([(p["x"], p["y"]) for p in poly], float) for poly in [truth, *predicted] if poly is not None and len(poly) >= 3]
    if len(polygons) < 2 or truth is None or len(truth) < 3:
        return 0.0, 0.0, 0.0
    every = np.concatenate(polygons)
    low, high = int(np.floor(every[:, 1].min())), int(np.ceil(every[:, 1].max()))
    size = lambda s: int((s[:, 1] - s[:, 0]).sum())
    a = b = both = 0
    for start in range(low, high, STRIP):
        rows = np.arange(start, min(high, start + STRIP))
        for t, p in zip(_covered(polygons[:1], rows), _covered(polygons[1:], rows), strict=True):
            a, b = a + size(t), b + size(p)
            if len(t) and len(p):
                inter = np.minimum(t[:, None, 1], p[None, :, 1]) - np.maximum(t[:, None, 0], p[None, :, 0])
                both += int(np.maximum(inter, 0).sum())
    union = a + b - both
    return (both / union if union else 0.0, both / a if a else 0.0, both / b if b else 0.0)


#: Crossings of scan lines that are sorted at a time.
CROSSINGS = 1_000_000


def _counted(points: np.ndarray, length: np.ndarray, row: np.ndarray, side: np.ndarray, rows: int) -> np.ndarray:
    """Pixels of the truth, of the prediction and of both, for each row of a batch.

    Polygon k has length[k] of the ``points``, one after the other, and belongs to ``row`` and ``side`` (0 the truth, 1 the
    prediction). Crossings are paired along each scan line of each polygon; where a pair begins, a side's depth grows by
    one, and where it ends it falls: the columns between two changes count for the sides of positive depth.
    """
    start = np.cumsum(length) - length
    of = np.repeat(np.arange(len(length)), length)
    after = np.arange(len(points)) + 1
    after[start + length - 1] = start
    a, b = points, points[after]
    # the first and last scan line whose centre an edge crosses; the lower end belongs to it
    low, high = np.ceil(np.minimum(a[:, 1], b[:, 1]) - 0.5).astype(np.int64), np.ceil(np.maximum(a[:, 1], b[:, 1]) - 0.5).astype(np.int64)
    n = high - low
    edge = np.repeat(np.arange(len(points)), n)
    y = low[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
    x = (b[edge, 0] - a[edge, 0]) * (y + 0.5 - a[edge, 1]) / (b[edge, 1] - a[edge, 1]) + a[edge, 0]
    x = np.ceil(x - 0.5).astype(np.int64)
    order = np.lexsort((x, y, of[edge]))
    x, y, k = x[order], y[order], of[edge][order]
    change = np.where(np.arange(len(x)) % 2 == 0, 1, -1)  # a scan line crosses a polygon an even number of times
    order = np.lexsort((x, y, row[k]))
    x, y, r, s, change = x[order], y[order], row[k][order], side[k][order], change[order]
    t, p = np.cumsum(np.where(s == 0, change, 0)) > 0, np.cumsum(np.where(s == 1, change, 0)) > 0
    # all depths are back at zero where a scan line ends, so that what lies between two lines never counts
    wide = np.append(np.diff(x), 0)
    return np.stack([np.bincount(r, np.where(c, wide, 0), rows) for c in (t, p, t & p)])


def _flat(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The points of a list of polygons, one after the other, and how many each has."""
    values = polygons.flatten()
    xy = [pc.struct_field(values, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy"]
    return np.stack(xy, axis=1), pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def overlaps_of(truths: pa.Array, predictions: pa.Array) -> np.ndarray:
    """``overlap_of`` for each row of a batch, in strides of about ``CROSSINGS``; a row with more goes by itself."""
    n = len(truths)
    out = np.zeros((n, 3))
    (tp, tn), (pp, pn) = _flat(truths), _flat(predictions.flatten())
    points, length = np.concatenate([tp, pp]), np.concatenate([tn, pn])
    row = np.concatenate([np.arange(n), pc.list_parent_indices(predictions).to_numpy(zero_copy_only=False)]).astype(np.int64)
    side = np.repeat([0, 1], [n, len(pn)])
    fine = length >= 3
    both = (np.bincount(row[fine & (side == 0)], minlength=n) > 0) & (np.bincount(row[fine & (side == 1)], minlength=n) > 0)
    fine &= both[row]
    points, length, row, side = points[np.repeat(fine, length)], length[fine], row[fine], side[fine]
    if not len(row):
        return out
    start = np.cumsum(length) - length
    tall = np.maximum.reduceat(points[:, 1], start) - np.minimum.reduceat(points[:, 1], start) + 1
    lines = np.bincount(row, tall * length, n)
    for i in np.flatnonzero(lines > CROSSINGS):
        of = [[{"x": x, "y": y} for x, y in points[start[k] : start[k] + length[k]]] for k in np.flatnonzero(row == i)]
        out[i] = overlap_of(of[0], of[1:])
    lines[lines > CROSSINGS] = 0
    stride = (np.cumsum(lines) // CROSSINGS).astype(np.int64)
    for c in np.unique(stride):
        some = np.flatnonzero((stride == c) & (lines > 0))
        mine = (stride[row] == c) & (lines[row] > 0)
        if len(some):
            first, last = some[0], some[-1] + 1
            a, b, met = _counted(points[np.repeat(mine, length)], length[mine], row[mine] - first, side[mine], last - first)
            for k, whole in enumerate((a + b - met, a, b)):
                out[first:last, k] = np.where(lines[first:last] > 0, np.divide(met, whole, out=np.zeros_like(met), where=whole > 0), out[first:last, k])
    return out


def polygon_overlap(truth: Column | str, predicted: Column | str) -> Column:
    """struct<iou, coverage, precision> of a polygon and the union of several."""

    @F.arrow_udf("iou double, coverage double, precision double")
    def overlap(t: pa.Array, p: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in overlaps_of(t, p).T], ["iou", "coverage", "precision"])

    return overlap(truth, predicted)
