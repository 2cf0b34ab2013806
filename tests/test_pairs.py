"""Matching inside tasks: against plain loops over all pairs, with images that go over batches, null keys and ties."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gondola.operators import evaluate, match, pairs

P = "image bigint, cls string, det int, conf int, x1 int, y1 int, x2 int, y2 int"
G = "image bigint, cls string, gt int, x1 int, y1 int, x2 int, y2 int"


@pytest.fixture
def sides(spark):
    """Few places, so that many IoUs are equal; batches of five rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    r = random.Random(7)
    box = lambda: (lambda x, y: (x, y, x + r.choice([0, 8, 9]), y + 8))(r.randrange(6), r.randrange(4))
    key = lambda: (r.choice([1, 2, 3, 9, None]), r.choice(["A", "A", "B", None]))
    p = [(*key(), i, r.randrange(4), *box()) for i in range(60)]
    g = [(*key(), i, *box()) for i in range(50)]
    yield p, g, spark.createDataFrame(p, P), spark.createDataFrame(g, G)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def iou(a, b):
    w, h = min(a[-2], b[-2]) - max(a[-4], b[-4]), min(a[-1], b[-1]) - max(a[-3], b[-3])
    area = lambda z: (z[-2] - z[-4]) * (z[-1] - z[-3])
    both = max(w, 0) * max(h, 0)
    return both / (area(a) + area(b) - both) if area(a) + area(b) > both else 0.0


def fits(a, b):
    return None not in (a[0], a[1]) and a[:2] == b[:2]


def best(x, g, same=fits):
    return max(((iou(x, y), -y[2], y) for y in g if same(x, y)), default=(0.0, 0, None))


def rows(df):
    """The rows; no pair was a row on the way: there is no join."""
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    return sorted(map(tuple, df.collect()), key=str)


def test_best_partner_makes_no_pair_rows(sides):
    p, g, ps, gs = sides
    for least in (0.0, 0.5):
        want = [(*x[:3], y[2], round(s, 9)) for x in p for s, _, y in [best(x, g)] if y and s >= least]
        got = match.best_match(ps, gs, ["image", "cls"], "det", "gt", minimum=least).select("image", "cls", "det", "g_gt", F.round("iou", 9))
        assert rows(got) == sorted(want, key=str)


def test_best_partner_of_an_empty_class_is_of_any_class(spark):
    ps = spark.createDataFrame([(1, "", 1, 5, 0, 0, 9, 9), (1, "B", 2, 6, 0, 0, 9, 9), (1, None, 3, 7, 0, 0, 9, 9)], P)
    gs = spark.createDataFrame([(1, "A", 1, 0, 0, 9, 9), (1, "", 2, 0, 0, 9, 9)], G)
    got = match.best_match(ps, gs, ["image", "cls"], "det", "gt", wildcard="cls", keep=["conf"]).select("det", "g_gt", "conf")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 5), (2, 2, 6)]


def test_pairs_in_parts_are_the_same(monkeypatch):
    r = random.Random(3)
    side = lambda own, n: [(r.choice([1, 2, None]), own, i, x, x, x + 9.0, x + 9.0) for i, x in ((i, float(r.randrange(9))) for i in range(n))]
    t = pa.table(dict(zip(("image", "_own", "_id", "x1", "y1", "x2", "y2"), zip(*side(True, 30), *side(False, 20), strict=True), strict=True)))
    found, top = pairs.Pairs(t, ["image"]).best()
    monkeypatch.setattr(pairs, "PAIRS", 12)
    in_parts = pairs.Pairs(t, ["image"])
    assert len(list(in_parts.chunks())) > 3
    assert found.tolist() == in_parts.best()[0].tolist() and top.tolist() == in_parts.best()[1].tolist()


def test_mutual_best_looks_for_a_partner_once_for_all_levels(sides):
    p, g, ps, gs = sides
    levels = (0.3, 0.5, 0.8)
    want = set()
    for level in levels:
        first = {}
        for x in p:
            s, _, y = best(x, g)
            if y and s > 0 and s >= level:
                first.setdefault(y[2], x)
        want |= {(level, *x[:3], gt) for gt, x in first.items()}
    assert rows(match.mutual_best(ps, gs, levels).select("level", "image", "cls", "det", "gt")) == sorted(want, key=str)


def test_words_meet_tracks_without_pair_rows(sides):
    p, g, ps, gs = sides
    want = []
    for x in p:
        cx, cy = (x[4] + x[6]) / 2, (x[5] + x[7]) / 2
        of = [y for y in g if x[0] is not None and y[0] == x[0]]
        d = lambda y: int((y[5] - y[3]) * 0.12)
        held = [y[2] for y in of if max(0, y[3] - d(y)) <= cx < min(9, y[5] + d(y)) and max(0, y[4]) <= cy < min(9, y[6])]
        s, _, y = best(x, of, lambda *_: True)
        if held or s > 0:
            want.append((x[0], x[2], min(held) if held else y[2], "centre" if held else "overlap"))
    words, tracks = ps.drop("cls", "conf").withColumnRenamed("det", "word"), gs.drop("cls").withColumnRenamed("gt", "det")
    assert rows(match.assign_words(words, tracks, F.lit(9), F.lit(9))) == sorted(want, key=str)
    assert {w[3] for w in want} == {"centre", "overlap"}


@pytest.mark.parametrize("strict", [True, False])
def test_confusion_counts_in_tasks(sides, strict):
    p, g, ps, gs = sides
    same = lambda x, y: x[0] is not None and x[0] == y[0]
    first = {}
    for x in p:
        s, _, y = best(x, g, same)
        if x[3] > 0 and y and s > 0.45 and (y[2] not in first or s > first[y[2]][0]):
            first[y[2]] = (s, x)
    hit, images = {x[2] for _, x in first.values()}, {x[0] for _, x in first.values()}
    cells = [(y[1], first[y[2]][1][1]) if y[2] in first else (y[1], "background") for y in g]
    cells += [("background", x[1]) for x in p if x[3] > 0 and x[2] not in hit and (not strict or x[0] in images)]
    want = [(*c, cells.count(c)) for c in set(cells)]
    assert rows(evaluate.confusion(ps, gs, F.col("conf") > 0, strict_background=strict)) == sorted(want, key=str)


def test_greedy_outcomes_in_one_pass(sides):
    p, g, ps, gs = sides
    pairs_ = sorted((-x[3], x[2], -iou(x, y), -y[2], x, y) for x in p for y in g if fits(x, y) and iou(x, y) >= 0.5)
    took, free = {}, {y[2] for y in g}
    for *_, x, y in pairs_:
        if x[2] not in took and y[2] in free:
            took[x[2]] = y
            free.discard(y[2])
    want = [(*x[:2], "TP", x[2], took[x[2]][2], round(iou(x, took[x[2]]), 9)) if x[2] in took else (*x[:2], "FP", x[2], None, round(best(x, g)[0], 9)) for x in p]
    want += [(*y[:2], "FN", None, y[2], 0.0) for y in g if y[2] in free]
    got = match.confidence_outcomes(ps, gs).withColumn("iou", F.round("iou", 9))
    assert rows(got) == sorted(want, key=str)
    parts = match.confidence_greedy(ps, gs)
    assert [parts[k].count() for k in ("matches", "false_positives", "false_negatives")] == [sum(r[2] == o for r in want) for o in ("TP", "FP", "FN")]


def test_image_search_in_parts_meets_all_images_without_pair_rows(spark):
    r = random.Random(5)
    box = lambda: (lambda x, y: (x, y, x + 8, y + 8))(r.randrange(30), r.randrange(20))
    p = [(s, d, r.choice(["A", "B", None]), *box()) for s in range(6) for d in (0, 1, 2, 2)]
    g = [(i, r.choice(["A", "B", None]), *box()) for i in range(40) for _ in range(5)]
    score = {}
    for s, d, c, *b in p:
        for i, k, *q in g:
            if c is not None and c == k and iou(b, q) > 0:
                score[s, i, d] = max(score.get((s, i, d), 0), iou(b, q))
    want = {}
    for s, i, _ in score:
        want[s] = max(want.get(s, (0, 0)), (round(sum(v for k, v in score.items() if k[:2] == (s, i)), 9), i))
    ps, gs = spark.createDataFrame(p, "source bigint, det int, cls string, x1 int, y1 int, x2 int, y2 int"), spark.createDataFrame(g, "image bigint, cls string, x1 int, y1 int, x2 int, y2 int")
    for parts in ((16_000, 50_000), (5, 30)):
        got = match.infer_image(ps, gs, boxes=parts).withColumn("score", F.round("score", 8))
        assert rows(got) == sorted((s, i, round(v, 8)) for s, (v, i) in want.items() if v >= 1)


def test_every_detection_is_judged_without_pair_rows(sides):
    p, g, ps, gs = sides
    first = {}
    for x in sorted(p, key=lambda x: (-x[3], x[2])):
        s, _, y = best(x, g)
        if y and s > 0.5:
            first.setdefault(y[2], (x[2], s))
    got_by = {det: (gt, round(s, 9)) for gt, (det, s) in first.items()}
    want = [(*x[:4], *got_by.get(x[2], (None, None))) for x in p]
    assert rows(match.claimed(ps, gs).withColumn("iou", F.round("iou", 9))) == sorted(want, key=str)
