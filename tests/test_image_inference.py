"""Image inference among all images against plain sums, with sources that fit well, badly and not at all."""

import random

from pyspark.sql import functions as F

from gondola.operators import match

BOX = "x1 long, y1 long, x2 long, y2 long"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    size = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    return 0.0 if w <= 0 or h <= 0 else w * h / (size(a) + size(b) - w * h)


def fixture():
    rng = random.Random(9)

    def box():
        x, y = rng.randrange(180), rng.randrange(90)
        return (x, y, x + rng.randrange(8, 60), y + rng.randrange(8, 40))

    gts = [(i, rng.choice("ab"), *box()) for i in range(60) for _ in range(9)]
    gts += [(100 + i, *g[1:]) for i in (0, 1) for g in gts if g[0] == 5]  # copies tie
    preds = []
    for source in range(24):
        own = [g for g in gts if g[0] == source]
        for det, g in enumerate(own[: 9 if source % 3 else 3]):
            d = [rng.randrange(-2, 3) for _ in range(4)] if source % 3 else [0] * 4
            preds.append((source, det, g[1], *(v + e for v, e in zip(g[2:], d, strict=True))))
        if source % 4 == 1:  # much that is nowhere
            preds += [(source, 20 + j, "b", *box()) for j in range(20)]
    preds += [(90, 0, "z", 1, 1, 9, 9), (91, 0, "a", 500, 500, 510, 510), (92, 1, "a", 3, 3, 4, 4)]
    return preds, gts


def test_every_image_is_a_candidate(spark):
    preds, gts = fixture()
    want = {}
    for source in {p[0] for p in preds}:
        scores = []
        for image in {g[0] for g in gts}:
            some = [g for g in gts if g[0] == image]
            scores.append((round(sum(max((iou(p[3:], g[2:]) for g in some if g[1] == p[2]), default=0.0) for p in preds if p[0] == source), 9), image))
        if max(scores)[0] >= 1:
            want[source] = max(scores)
    p, g = spark.createDataFrame(preds, f"source long, det long, cls string, {BOX}"), spark.createDataFrame(gts, f"image long, cls string, {BOX}")
    for near in (0.3, 0.5, 0.8):
        got = {r["source"]: (r["score"], r["image"]) for r in match.infer_image(p, g, near=near).collect()}
        assert got == want, near
    assert want[5][1] == 101 and len(want) > 20


def test_near_pairs_are_all_pairs_at_the_threshold(spark):
    preds, gts = fixture()
    p, g = spark.createDataFrame(preds, f"source long, det long, cls string, {BOX}"), spark.createDataFrame(gts, f"image long, cls string, {BOX}")
    for least in (0.25, 0.6):
        want = sorted((a[0], a[1], b[0], *b[2:]) for a in preds for b in gts if a[2] == b[1] and iou(a[3:], b[2:]) >= least)
        got = match.near_pairs(p, g, ["cls"], least).select("source", "det", "g_image", "g_x1", "g_y1", "g_x2", "g_y2")
        assert sorted(map(tuple, got.collect())) == want
        assert match.near_pairs(p, g, ["cls"], least).where(F.col("iou") < least).isEmpty()
