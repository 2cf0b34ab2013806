"""Box and polygon geometry as column expressions: flat columns, built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four columns."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")))

    def __iter__(self):
        return iter((self.x1, self.y1, self.x2, self.y2))

    @property
    def w(self) -> Column:
        return self.x2 - self.x1

    @property
    def h(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return F.greatest(F.lit(0), self.w) * F.greatest(F.lit(0), self.h)

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip(self, ("x1", "y1", "x2", "y2"), strict=True)]

    def struct(self) -> Column:
        return F.struct(*self.columns())


def valid(b: Box, strict: bool = False) -> Column:
    """All finite and in order; ``strict`` asks for a positive area."""
    finite = F.lit(True)
    for c in b:
        d = c.cast("double")
        finite = finite & c.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    ordered = (b.w > 0) & (b.h > 0) if strict else (b.w >= 0) & (b.h >= 0)
    return F.coalesce(finite & ordered, F.lit(False))


def parse(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct of ints from text columns; null where a part is no number or the area is not positive."""
    b = Box(*(F.expr("CAST(NULL AS INT)") if c is None else c.try_cast("double").cast("int") for c in (x1, y1, x2, y2)))
    return F.when(valid(b, strict=True), b.struct())


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def iou(a: Box, b: Box, empty_value: float = 0.0) -> Column:
    both = intersection(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(F.lit(float(empty_value)))


def coverage(gt: Box, b: Box) -> Column:
    """Share of ``gt`` that ``b`` covers."""
    return F.when(gt.area > 0, intersection(gt, b) / gt.area).otherwise(F.lit(0.0))


def overlaps(a: Box, b: Box) -> Column:
    """A plain predicate, for join conditions."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def contains_point(b: Box, x: Column, y: Column, closed: bool = False) -> Column:
    inside = (x >= b.x1) & (y >= b.y1)
    return inside & (x <= b.x2) & (y <= b.y2) if closed else inside & (x < b.x2) & (y < b.y2)


def buffer(b: Box, width: Column, height: Column, share: float) -> Box:
    """Wider by a share of its own size on each side, cut to the image; whole pixels toward zero."""
    dx, dy = (b.w * share).cast("int"), (b.h * share).cast("int")
    return Box(F.greatest(F.lit(0), b.x1 - dx), F.greatest(F.lit(0), b.y1 - dy), F.least(width, b.x2 + dx), F.least(height, b.y2 + dy))


def pad(b: Box, by: int) -> Box:
    return Box(b.x1 - by, b.y1 - by, b.x2 + by, b.y2 + by)


def unpad(b: Box, by: int) -> Box:
    """The inverse of ``pad`` for boxes on the padded image; left and top stop at 0."""
    return Box(F.greatest(F.lit(0), b.x1 - by), F.greatest(F.lit(0), b.y1 - by), b.x2 - by, b.y2 - by)


def shrink(b: Box, share: float = 0.2) -> Box:
    """Less ``share`` of the size, around the same centre."""
    w, h = b.w * share / 2, b.h * share / 2
    return Box(b.x1 + w, b.y1 + h, b.x2 - w, b.y2 - h)


def inside(a: Box, b: Box, tolerance: int = 0) -> Column:
    return (a.x1 >= b.x1 - tolerance) & (a.y1 >= b.y1 - tolerance) & (a.x2 <= b.x2 + tolerance) & (a.y2 <= b.y2 + tolerance)


def expand(b: Box, scale: float, by: int, width: Column, height: Column) -> Box:
    """Scaled around the centre and padded, cut to the image, rounded half to even; unchanged if nothing would be left."""
    w, h = b.w * scale / 2 + by, b.h * scale / 2 + by
    r = lambda c: F.rint(c).cast("int")
    e = Box(F.greatest(F.lit(0), r(b.cx - w)), F.greatest(F.lit(0), r(b.cy - h)), F.least(width, r(b.cx + w)), F.least(height, r(b.cy + h)))
    some = (e.x2 > e.x1) & (e.y2 > e.y1)
    return Box(*(F.when(some, x).otherwise(y) for x, y in zip(e, b, strict=True)))


def of_points(points: Column, by: int, width: Column, height: Column) -> Box:
    """Enclosing box of an array of (x, y) structs, padded and cut to the image."""
    xs, ys = points["x"], points["y"]
    return Box(
        F.greatest(F.lit(0), F.array_min(xs) - by), F.greatest(F.lit(0), F.array_min(ys) - by),
        F.least(width, F.array_max(xs) + by), F.least(height, F.array_max(ys) + by),
    )


def to_xywh(b: Box) -> tuple[Column, Column, Column, Column]:
    return b.cx, b.cy, b.w, b.h


def from_xywh(xc: Column, yc: Column, w: Column, h: Column) -> Box:
    return Box(xc - w / 2, yc - h / 2, xc + w / 2, yc + h / 2)


def scaled(b: Box, sx, sy, dx=0, dy=0) -> Box:
    """Normalised to pixels (a factor), with an offset."""
    return Box(b.x1 * sx + dx, b.y1 * sy + dy, b.x2 * sx + dx, b.y2 * sy + dy)


def unletterbox(b: Box, gain: Column, pad_x: Column, pad_y: Column) -> Box:
    return Box((b.x1 - pad_x) / gain, (b.y1 - pad_y) / gain, (b.x2 - pad_x) / gain, (b.y2 - pad_y) / gain)


def clip(b: Box, width: Column, height: Column) -> Box:
    cut = lambda c, m: F.least(F.greatest(c, F.lit(0)), m)
    return Box(cut(b.x1, width), cut(b.y1, height), cut(b.x2, width), cut(b.y2, height))


def iou_family(a: Box, b: Box, eps: float = 1e-9) -> dict[str, Column]:
    """giou, diou and ciou of two boxes."""
    both = intersection(a, b)
    union = a.w * a.h + b.w * b.h - both + eps
    i = both / union
    cw, ch = F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1), F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1)
    hull, diagonal = cw * ch + eps, cw * cw + ch * ch + eps
    away = (F.pow(b.x1 + b.x2 - a.x1 - a.x2, F.lit(2)) + F.pow(b.y1 + b.y2 - a.y1 - a.y2, F.lit(2))) / 4
    v = F.pow(F.atan(b.w / (b.h + eps)) - F.atan(a.w / (a.h + eps)), F.lit(2)) * (4 / math.pi**2)
    alpha = v / (v - i + (1 + eps))
    return {"giou": i - (hull - union) / hull, "diou": i - away / diagonal, "ciou": i - (away / diagonal + v * alpha)}


def wh_iou(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    both = F.least(w1, w2) * F.least(h1, h2)
    return both / (w1 * h1 + w2 * h2 - both)


def resample(points: Column, n: int) -> Column:
    """``n`` points along the closed polygon of (x, y) structs, even in the index, linear in between.

    Written out point by point, since a lambda would close the polygon anew wherever it names it.
    """
    last = F.size(points)
    end = F.element_at(points, 1)

    def at(k: int) -> Column:
        t = F.lit(k) * last / F.lit(float(n - 1))
        i = F.least(F.floor(t).cast("int"), last - 1)
        f = t - i
        behind = F.when(i + 1 < last, points[F.least(i + 1, last - 1)]).otherwise(end)
        mix = lambda c: (points[i][c] * (1 - f) + behind[c] * f).alias(c)
        return F.struct(mix("x"), mix("y"))

    return F.array(*[at(k) for k in range(n)])


def turned_180(b: Box, width: Column, height: Column) -> Box:
    return Box(width - b.x2, height - b.y2, width - b.x1, height - b.y1)


def shifted(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def deskew(angle: Column) -> Column:
    """Shortest rotation that makes a baseline of ``angle`` degrees level: (-90, 90]."""
    wrapped = angle - F.floor((angle + 90) / 180) * 180
    return -wrapped


def quadrant(x: Column, y: Column, width: Column, height: Column) -> Column:
    v, h = F.when(y < height / 2, "top").otherwise("bottom"), F.when(x < width / 2, "left").otherwise("right")
    return F.concat_ws("_", v, h)


def binned(v: Column, size: float) -> Column:
    return (F.bround(v / size) * size).cast("bigint")


def beam_line_x(b: Box, y: Column, right: bool | Column = False) -> Column:
    """x of the dividing line at height ``y``: a beam on the left leans right on its way up, one on the right leans left.

    The line is the beam box's diagonal; a flat box is divided at its middle.
    """
    share = (b.y2 - y) / F.when(F.abs(b.h) < 1e-6, F.lit(None)).otherwise(b.h)
    up = F.lit(right) if isinstance(right, bool) else right
    x = F.when(up, b.x2 - share * b.w).otherwise(b.x1 + share * b.w)
    return F.coalesce(x, b.cx)


def left_of_beam(x: Column, y: Column, beam: Box, right: bool | Column = False) -> Column:
    """Within the beam's width the tilted line decides, outside the nearer edge."""
    return F.when(x < beam.x1, True).when(x > beam.x2, False).otherwise(x < beam_line_x(beam, y, right))


def sku_left_of_beam(sku: Box, beam: Box, right: bool | Column = False) -> Column:
    return (sku.x2 < beam.x1) | left_of_beam(sku.cx, sku.cy, beam, right)


def sku_right_of_beam(sku: Box, beam: Box, right: bool | Column = False) -> Column:
    return (sku.x1 > beam.x2) | ~left_of_beam(sku.cx, sku.cy, beam, right)


def leans_right_side(beam: Box, width: Column) -> Column:
    """True for a beam in the right half of an image of known width."""
    return (width > 0) & (beam.cx > width / 2)


def principal_angle(n: Column, var_x: Column, var_y: Column, cov: Column) -> Column:
    """Angle of the main axis of points, folded to [0, 90]; null under five points."""
    a = F.degrees(F.atan2(2 * cov, var_x - var_y) / 2)
    a = F.abs(a)
    return F.when(n >= 5, F.when(a > 90, 180 - a).otherwise(a))


def wilson(correct: Column, total: Column, z: float = 1.96) -> dict[str, Column]:
    p, d = correct / total, 1 + z * z / total
    mid, half = (p + z * z / (2 * total)) / d, z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / d
    return {"low": F.when(total > 0, F.greatest(F.lit(0.0), mid - half)), "high": F.when(total > 0, F.least(F.lit(1.0), mid + half))}


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(tp > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def beam_score(beams: Column) -> Column:
    return F.when(beams == 0, 0.0).when(beams == 1, 0.35).otherwise(0.5)


def label_score(matched: Column, expected: Column) -> Column:
    """0.5 less half of the relative difference of the counts."""
    most = F.greatest(matched, expected)
    return F.when(most > 0, F.round(0.5 - F.abs(matched - expected) / 2 / most, 3)).otherwise(0.0)


def fitness(map50: Column, map_all: Column) -> Column:
    return 0.1 * map50 + 0.9 * map_all


def fused_confidence(tag: Column, digit: Column) -> Column:
    return 0.6 * F.coalesce(tag, F.lit(0.0)) + 0.4 * digit
