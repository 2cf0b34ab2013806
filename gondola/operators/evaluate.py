"""Evaluation: counts, metrics, failure taxonomy, confusion matrix, average precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions import boxes as bx
from gondola.operators import pairs as pr
from gondola.operators import prefix_scan
from gondola.sources.scratch import written


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def class_metrics(matches: DataFrame, surplus: DataFrame, missed: DataFrame, cls: str = "cls") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each class. Counts are combined before they meet."""
    count = lambda df, name: df.groupBy(cls).agg(F.count(F.lit(1)).alias(name))
    all_ = count(matches, "tp").join(count(surplus, "fp"), cls, "full").join(count(missed, "fn"), cls, "full").na.fill(0, ["tp", "fp", "fn"])
    return all_.select(cls, "tp", "fp", "fn", *[v.alias(k) for k, v in bx.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def class_counts(preds: DataFrame, gts: DataFrame, matches: DataFrame, cls: str = "cls") -> DataFrame:
    """As ``class_metrics``, for matches that take each prediction and each label once: what isn't matched is what is
    left of the totals, so that the matches are made once and no row meets another.
    """
    count = lambda df, name: df.groupBy(cls).agg(F.count(F.lit(1)).alias(name))
    all_ = count(matches, "tp").join(count(preds, "p"), cls, "full").join(count(gts, "g"), cls, "full").na.fill(0, ["tp", "p", "g"])
    all_ = all_.select(cls, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    return all_.select(cls, "tp", "fp", "fn", *[v.alias(k) for k, v in bx.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def duplicate_ids(rows: DataFrame, image: str, ident: str) -> DataFrame:
    """Rows beyond the first of each id, by image; null and empty ids don't count."""
    n = rows.where(F.col(ident).isNotNull() & (F.col(ident).cast("string") != "")).groupBy(image, ident).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(image).agg(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("duplicate_ids"))


def failure_category(found: Column, crop_coverage: Column, seg_found: Column, scorable: Column, predicted: Column, ocr_found: Column, expected: Column) -> Column:
    """The first of eight categories, in order, that fits a truth region."""
    return (
        F.when(~found, "detection_missed").when(crop_coverage < 0.9, "poor_crop_coverage").when(~seg_found, "segmentation_missing").when(~scorable, "not_ocr_scorable")
        .when((predicted == "") & ocr_found, "invalid_sku_length").when(predicted == "", "ocr_missing").when(predicted != expected, "ocr_incorrect").otherwise("correct")
    )


def long_summary(wide: DataFrame, metrics: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """One wide row -> (metric, value, denominator), a row a metric."""
    rows = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"), (F.lit(None) if d is None else d).cast("bigint").alias("denominator")) for k, (v, d) in metrics.items()]
    return wide.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def confusion(preds: DataFrame, gts: DataFrame, least_conf: Column, least_iou: float = 0.45, strict_background: bool = True) -> DataFrame:
    """(actual, predicted, n): best pair of each detection, then of each label, over all classes; ``background`` for
    what has no counterpart. ``strict_background``: unmatched detections count only in images that have a match.
    """
    shown = preds.where(least_conf)

    def judge(m: pr.Pairs) -> pa.Table:
        found, iou = m.best()
        at = np.flatnonzero((found >= 0) & (iou > 0) & (iou > least_iou))
        at = at[pr.first_of(found[at], -iou[at], m.p_id[at])]
        lost, extra = np.ones(len(m.g), bool), np.ones(len(m.p), bool)
        lost[found[at]], extra[at] = False, False
        if strict_background:
            image = m.table.column("image").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            extra &= np.isin(image[m.p], image[m.p[at]])
        names, none = m.table.column("cls").combine_chunks(), pa.nulls(1, m.table.schema.field("cls").type)
        names = pa.chunked_array([names, none]).combine_chunks()
        lost, extra, end = m.g[lost], m.p[extra], m.table.num_rows
        actual = names.take(pa.array(np.concatenate([m.g[found[at]], lost, np.full(len(extra), end)])))
        predicted = names.take(pa.array(np.concatenate([m.p[at], np.full(len(lost), end), extra])))
        kind = np.repeat([0, 1, 2], [len(at), len(lost), len(extra)])
        return pa.table({"actual": actual, "predicted": predicted, "kind": kind}).group_by(["actual", "predicted", "kind"]).aggregate([([], "count_all")]).rename_columns({"count_all": "n"})

    of, box = preds.schema["cls"].dataType, lambda df, ident: pr.side(df, ["image"], ident, cls=F.col("cls"))
    cells = pr.met(box(shown, "det"), box(gts, "gt"), ["image"], judge, [("actual", of), ("predicted", of), ("kind", "bigint"), ("n", "bigint")])
    named = lambda c, kind: F.when(F.col("kind") == kind, "background").otherwise(F.col(c)).alias(c)
    return cells.groupBy(named("actual", 2), named("predicted", 1)).agg(F.sum("n").alias("n"))


def precision_curve(detections: DataFrame, labels: DataFrame, levels: Sequence[float], keys: Sequence[str], order: Sequence[Column]) -> dict[str, DataFrame]:
    """detections: keys, ``iou`` (of the label that it claims, else null) and what ``order`` names; labels: keys, ...

    Where precision falls between two correct detections follows from their ranks, so that only correct ones are kept:
    ``points``: keys, threshold, tp, rank, precision, envelope (the greatest precision from here on), for iou > threshold.
    ``groups``: keys, threshold, n_labels, n_detections, n_correct (points), for keys that have both, with or without points.

    One sort by rank serves all levels; ranks, counts and envelopes are prefix scans, so that no group is one task.
    """
    keys = list(keys)
    ranked = prefix_scan.place(detections.select(*keys, "iou", *[c.alias(f"_o{i}") for i, c in enumerate(order)]), [*keys, *[f"_o{i}" for i in range(len(order))]])
    ranked = ranked.drop(*[f"_o{i}" for i in range(len(order))])
    right = prefix_scan.running_sums(ranked, keys, {"rank": F.lit(1)}).where(F.col("iou") > min(levels))
    right = written(right)
    claims = prefix_scan.running_sums(right, keys, {f"tp{i}": (F.col("iou") > t).cast("bigint") for i, t in enumerate(levels)})
    best = {f"env{i}": F.when(F.col("iou") > t, F.col(f"tp{i}") / F.col("rank")) for i, t in enumerate(levels)}
    curve = prefix_scan.maxima_ahead(claims, keys, best)
    at = [F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"env{i}").alias("envelope")) for i, t in enumerate(levels)]
    points = curve.select(*keys, "rank", "iou", F.explode(F.array(*at)).alias("a")).where(F.col("iou") > F.col("a.threshold"))
    points = points.select(*keys, "a.threshold", "a.tp", "rank", (F.col("a.tp") / F.col("rank")).alias("precision"), "a.envelope")
    n = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_labels")).join(ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_detections")), keys)
    correct = right.groupBy(*keys).agg(F.array(*[count_if(F.col("iou") > t) for t in levels]).alias("correct"))
    n = n.join(correct, keys, "left").select(*keys, F.posexplode(F.array(*map(F.lit, levels))).alias("i", "threshold"), "n_labels", "n_detections", "correct")
    return {"points": points, "groups": written(n.select(*keys, "threshold", "n_labels", "n_detections", F.coalesce(F.col("correct")[F.col("i")], F.lit(0)).alias("n_correct")))}


def average_precision(curve: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Area under the envelope where recall grows (the continuous form): each correct detection adds 1 / n_labels."""
    keys = [*keys, "threshold"]
    area = curve["points"].groupBy(*keys).agg(F.sum("envelope").alias("area"))
    return curve["groups"].join(area, keys, "left").select(*keys, F.coalesce(F.col("area") / F.col("n_labels"), F.lit(0.0)).alias("ap"))


def average_precision_101(curve: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Area under the envelope, interpolated linearly at 101 recalls and integrated by trapezoids.

    A curve's points: (0, 1), its own, and its last recall + 0.01 with precision 0. A place x lies behind the last point
    of recall tp / n_labels <= x and before the first of the next recall, so that its neighbours are looked up by tp.
    """
    keys = [*keys, "threshold"]
    n, x, tp = F.col("n_labels"), F.col("k") / 100.0, F.col("left_tp")
    grid = curve["groups"].withColumnRenamed("n_correct", "most").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(100))))
    grid = grid.withColumn("left_tp", F.least(F.floor(F.col("k") * n / 100), F.col("most")))
    found = curve["points"].select(*keys, "tp", "rank", "envelope")
    wanted = grid.select(*keys, F.explode(F.array(tp, tp + 1)).alias("tp")).distinct()
    near = written(found.join(wanted, [*keys, "tp"], "left_semi"))  # at most 202 rows a curve, made once
    side = lambda name, shift: near.select(*keys, (F.col("tp") - shift).alias("left_tp"), F.col("rank").alias(f"{name}_rank"), F.col("envelope").alias(f"{name}_env"))
    g = grid.join(side("l", 0), [*keys, "left_tp"], "left").join(side("r", 1), [*keys, "left_tp"], "left")
    # the last point at the left recall: a wrong detection before the next correct one, if there is one
    wrong = F.col("r_rank") > F.coalesce("l_rank", F.lit(0)) + 1
    left = F.when(F.col("r_rank").isNull(), F.col("most") / F.col("n_detections")).when(wrong, F.greatest(tp / (F.col("r_rank") - 1), "r_env")).otherwise(F.coalesce("l_env", F.lit(1.0)))
    r1, r2 = tp / n, F.when(F.col("r_rank").isNull(), tp / n + 0.01).otherwise((tp + 1) / n)
    p2 = F.coalesce("r_env", F.lit(0.0))
    y = F.when(x < r2, left + (p2 - left) * (x - r1) / (r2 - r1)).otherwise(0.0)
    weight = F.when(F.col("k").isin(0, 100), 0.005).otherwise(0.01)
    return g.groupBy(*keys).agg(F.sum(y * weight).alias("ap"))


def best_f1(curve: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 at each key's best F1 (earliest rank on ties), which is at a correct detection; else 0."""
    keys = [*keys, "threshold"]
    at = curve["points"].join(curve["groups"], keys).withColumn("recall", F.col("tp") / F.col("n_labels"))
    f1 = F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 9)
    top = at.groupBy(*keys).agg(F.max(F.struct(f1.alias("f1"), (-F.col("rank")).alias("back"), "precision", "recall")).alias("t"))
    return curve["groups"].join(top, keys, "left").select(*keys, *[F.coalesce(f"t.{c}", F.lit(0.0)).alias(c) for c in ("f1", "precision", "recall")])


def ordinal_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first, the upper median and the last row of each group in ``order``, which must be total. Null keys are a group."""
    placed = prefix_scan.running_sums(prefix_scan.place(rows, [*keys, *order]), keys, {"_rank": F.lit(1)})
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    other = n.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n")
    met = placed.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return met.where(F.col("_rank").isin(1) | (F.col("_rank") == F.floor(F.col("_n") / 2) + 1) | (F.col("_rank") == F.col("_n"))).select(*rows.columns)


def regression_verdict(old: DataFrame, new: DataFrame, masks: DataFrame, strip: str = "strip", box_delta: float = 1.0, conf_delta: float = 0.001) -> DataFrame:
    """old, new: strip, pos (0, 1, ...), cls, conf, box; masks: strip, exact, differing (as ``run_overlap`` puts it out).

    A row for each strip of either side: counts, classes_equal (the two lists, place by place), the greatest differences
    of a side of a box and of a confidence over the places that both have (0 without any), mask_equal (no mask on either
    side is equal), passed. One full join on the place; a strip's rows are combined before they meet.
    """
    b = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    side = lambda df, p: df.select(strip, "pos", F.struct(F.col("cls").alias("cls"), F.col("conf").cast("double").alias("conf"), *[c.cast("double").alias(f"b{i}") for i, c in enumerate(b)]).alias(p))
    met = side(old, "o").join(side(new, "n"), [strip, "pos"], "full")
    boxes = F.greatest(*[F.abs(F.col(f"o.b{i}") - F.col(f"n.b{i}")) for i in range(4)])
    g = met.groupBy(strip).agg(
        F.count("o").alias("n_old"), F.count("n").alias("n_new"), F.bool_and(F.col("o.cls").eqNullSafe(F.col("n.cls")) & F.col("o").isNotNull() & F.col("n").isNotNull()).alias("classes_equal"),
        F.coalesce(F.max(boxes), F.lit(0.0)).alias("max_box_delta"), F.coalesce(F.max(F.abs(F.col("o.conf") - F.col("n.conf"))), F.lit(0.0)).alias("max_conf_delta"),
    )
    m = masks.select(strip, "exact", "differing")
    out = g.join(m, strip, "left").withColumns({"mask_equal": F.coalesce("exact", F.lit(True)), "diff_pixels": F.coalesce("differing", F.lit(0)).cast("bigint")}).drop("exact", "differing")
    fine = (F.col("n_old") == F.col("n_new")) & F.col("classes_equal") & (F.col("max_box_delta") <= box_delta) & (F.col("max_conf_delta") <= conf_delta) & F.col("mask_equal")
    return out.withColumn("passed", fine)


def run_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask statistics from run-length rows (keys, row, x1, x2 - end exclusive): intersection, union, differing, iou, exact."""
    keys = list(keys)
    size = lambda df, c: df.groupBy(*keys).agg(F.sum(F.col("x2") - F.col("x1")).alias(c))
    r = right.select(*keys, "row", F.col("x1").alias("b1"), F.col("x2").alias("b2"))
    both = left.join(r, [*keys, "row"]).groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.least("x2", "b2") - F.greatest("x1", "b1"))).alias("inter"))
    t = size(left, "a").join(size(right, "b"), keys, "full").join(both, keys, "left").na.fill(0)
    union = F.col("a") + F.col("b") - F.col("inter")
    return t.select(*keys, F.col("inter").alias("intersection"), union.alias("union"), (union - F.col("inter")).alias("differing"), F.when(union > 0, F.col("inter") / union).otherwise(1.0).alias("iou"), (union == F.col("inter")).alias("exact"))
