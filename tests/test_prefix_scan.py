"""Prefix scans, curves and neighbours against plain loops, with hot groups, ties and null keys."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gondola.operators import evaluate, prefix_scan, review


def rows(n=4000, seed=3):
    rng = random.Random(seed)
    # two thirds in one group, one value in a third of the rows
    return [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([0, 0, rng.randrange(50)]), i, rng.choice([None, rng.random()])) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, "k string, v long, id long, x double").repartition(5)
    placed = prefix_scan.place(df, [F.col("v").desc(), "id"], parts)
    got = prefix_scan.maxima_ahead(prefix_scan.running_sums(placed, ["k"], {"n": F.lit(1), "s": F.col("v")}), ["k"], {"top": F.col("x")})
    want = {}
    for k, some in itertools.groupby(sorted(data, key=lambda r: str(r[0])), key=lambda r: r[0]):
        some = sorted(some, key=lambda r: (-r[1], r[2]))
        ahead, tops = None, []
        for r in reversed(some):
            ahead = r[3] if ahead is None else ahead if r[3] is None else max(ahead, r[3])
            tops.append(ahead)
        for i, (r, top) in enumerate(zip(some, reversed(tops), strict=True)):
            want[r[2]] = (k, i + 1, sum(x[1] for x in some[: i + 1]), top)
    assert {r["id"]: (r["k"], r["n"], r["s"], r["top"]) for r in got.collect()} == want
    after = prefix_scan.following(placed, ["id"], "next").collect()
    order = sorted(data, key=lambda r: (-r[1], r[2]))
    assert {r["id"]: r["next"] and r["next"]["id"] for r in after} == {a[2]: b and b[2] for a, b in zip(order, [*order[1:], None], strict=True)}


def interp(x, xs, ys):
    """Linear between the last point at or before x and the first beyond; constant outside."""
    i = max(j for j, v in enumerate(xs) if v <= x)
    return ys[i] if i + 1 == len(xs) else ys[i] + (ys[i + 1] - ys[i]) * (x - xs[i]) / (xs[i + 1] - xs[i])


def plain_curve(dets, n, level):
    """(rank, tp, precision, envelope) of all detections in order."""
    tp, out = 0, []
    for k, d in enumerate(sorted(dets, key=lambda d: (-d[1], d[2])), 1):
        tp += d[3] is not None and d[3] > level
        out.append([k, tp, tp / k])
    top = 0.0
    for r in reversed(out):
        top = max(top, r[2])
        r.append(top)
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.6, 1.0])
def test_average_precision(spark, share):
    rng = random.Random(int(share * 10))
    dets = [(c, rng.randrange(30), i, rng.uniform(0.5, 1) if rng.random() < share else None) for i, c in enumerate(rng.choices(["a", "b"], k=400))]
    labels = [(c,) for c in ["a"] * 300 + ["b"] * 230 + ["none"] * 3]
    levels = (0.5, 0.75)
    curve = evaluate.precision_curve(spark.createDataFrame(dets, "cls string, conf long, id long, iou double"), spark.createDataFrame(labels, "cls string"), levels, ["cls"], [-F.col("conf"), F.col("id")])
    area = {(r["cls"], r["threshold"]): r["ap"] for r in evaluate.average_precision(curve, ["cls"]).collect()}
    points = {(r["cls"], r["threshold"]): r["ap"] for r in evaluate.average_precision_101(curve, ["cls"]).collect()}
    f1 = {(r["cls"], r["threshold"]): (r["f1"], r["precision"], r["recall"]) for r in evaluate.best_f1(curve, ["cls"]).collect()}
    assert len(area) == len(points) == len(f1) == 4
    for (cls, level), got in area.items():
        n = sum(c == cls for (c,) in labels)
        c = plain_curve([d for d in dets if d[0] == cls], n, level)
        recall = [r[1] / n for r in c]
        assert abs(got - sum((b - a) * r[3] for a, b, r in zip([0, *recall], recall, c, strict=False))) < 1e-9
        xs, ys = [0.0, *recall, recall[-1] + 0.01], [1.0, *[r[3] for r in c], 0.0]
        grid = [interp(k / 100, xs, ys) for k in range(101)]
        assert abs(points[cls, level] - sum((a + b) / 200 for a, b in itertools.pairwise(grid))) < 1e-9
        best = max((round(2 * r[2] * q / (r[2] + q), 9) if r[1] else 0.0, -r[0], r[2], q) for r, q in zip(c, recall, strict=True))
        assert f1[cls, level] == pytest.approx((best[0], best[2], best[3]))


def test_ordinals_and_neighbours(spark):
    data = rows(900)
    df = spark.createDataFrame(data, "k string, v long, id long, x double")
    got = {tuple(r) for r in evaluate.ordinal_rows(df.select("k", "v", "id"), ["k"], ["v", "id"]).collect()}
    want = set()
    for k in {r[0] for r in data}:
        some = sorted((r[1], r[2]) for r in data if r[0] == k)
        want |= {(k, *some[i]) for i in (0, len(some) // 2, len(some) - 1)}
    assert got == want
    moved = {(r["image"], r["row"]): tuple(r)[2:] for r in review.next_after_save(df.select(F.col("k").alias("image"), F.col("id").alias("row"))).collect()}
    order = sorted((r[0], r[2]) for r in data if r[0] is not None)
    for a, b in zip(order, [*order[1:], None], strict=True):
        own = b[1] if b and b[0] == a[0] else None
        assert moved[a] == (own, min(r for i, r in order if i == a[0]) if own is None else own, b and b[1])
    assert len(moved) == len(order)


def test_rows_meet_no_table_of_ranges(spark):
    """What other ranges come to is a row among theirs: neither scan joins, and the given columns stay."""
    placed = prefix_scan.place(spark.createDataFrame(rows(300), "k string, v long, id long, x double"), ["k", "v", "id"], parts=5)
    for scan, plain in ((prefix_scan.running_sums, sum), (prefix_scan.maxima_ahead, max)):
        out = scan(placed, ["k"], {"s": F.col("id") % 7})
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == [*placed.columns, "s"]
        got = out.collect()
        assert len(got) == 300
        for a in got[::17]:
            upto = [b["id"] % 7 for b in got if b["k"] == a["k"] and (b["_place"] <= a["_place"] if plain is sum else b["_place"] >= a["_place"])]
            assert a["s"] == plain(upto)


def test_101_points_read_the_curve_once(spark):
    """The few points beside the 101 places are a table: its plan doesn't scan the order again."""
    curve = evaluate.precision_curve(spark.createDataFrame([("a", i, 0.6 if i % 3 else None) for i in range(30)], "cls string, id long, iou double"), spark.createDataFrame([("a",)] * 25, "cls string"), (0.5, 0.9), ["cls"], [F.col("id")])
    out = evaluate.average_precision_101(curve, ["cls"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(out.collect()) == 2
    assert {r["threshold"]: r["n_correct"] for r in curve["groups"].collect()} == {0.5: 20, 0.9: 0}
