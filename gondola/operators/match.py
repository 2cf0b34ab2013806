"""Joins and matching of boxes. Every tie is broken by ordinals that the tables carry, never by partitioning.

The best partner, greedy matching by confidence, claims and words: rows are shuffled by image, and an image's pairs are made
inside a task (``pairs``). The others join on the image (and class) and fold over the sorted pairs of one image and
class, inside a row; where an image can have very many boxes, ``grid_pairs`` first meets boxes by grid cell.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions import boxes as bx
from gondola.functions.boxes import Box
from gondola.operators import pairs as pr


def sides(preds: DataFrame, gts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """preds joined with gts on ``keys``; the box and other columns of gts get the prefix g_."""
    g = gts.select(*keys, *[F.col(c).alias(f"g_{c}") for c in gts.columns if c not in keys])
    return preds.join(g, list(keys), how)


def best_match(preds: DataFrame, gts: DataFrame, keys: Sequence[str], pred_id: str, gt_id: str, minimum: float = 0.0, wildcard: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """For each prediction the first ground truth with the greatest IoU, if that is at least ``minimum``: keys, the
    prediction's id, g_ and the other's id, iou, and the prediction's columns ``keep``.

    ``wildcard``: a class column of both sides; an empty class on either side fits every class.
    """
    keys = [k for k in keys if k != wildcard]
    keep = list(dict.fromkeys([*keep, *([wildcard] if wildcard else [])]))
    right = {f"_g_{wildcard}": F.col(wildcard)} if wildcard else {}

    def judge(m: pr.Pairs) -> pa.Table:
        fits = None
        if wildcard:
            p, g = m.of_p(wildcard), m.of_g(f"_g_{wildcard}")
            fits = lambda i, j: ((p[i] == g[j]) & np.not_equal(p[i], None) | (p[i] == "") | (g[j] == "")) & np.not_equal(p[i], None) & np.not_equal(g[j], None)
        found, iou = m.best(fits)
        at = np.flatnonzero((found >= 0) & (iou >= minimum))
        return pa.table(m.rows(m.p[at], [*keys, *keep]) | {pred_id: m.p_id[at], f"g_{gt_id}": m.g_id[found[at]], "iou": iou[at]})

    kind = lambda c: (c, preds.schema[c].dataType)
    columns = [*map(kind, keys), kind(pred_id), (f"g_{gt_id}", gts.schema[gt_id].dataType), ("iou", "double"), *map(kind, keep)]
    return pr.met(pr.side(preds, keys, pred_id, **{c: F.col(c) for c in keep}), pr.side(gts, keys, gt_id, **right), keys, judge, columns)


def grid_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int = 64) -> DataFrame:
    """Pairs of boxes of equal keys that overlap: met in the grid cells that both touch, each pair once.

    A pair belongs to the cell that holds the upper left corner of its intersection, so that no distinct is needed.
    """
    touched = lambda b: F.explode(F.flatten(F.transform(F.sequence(F.floor(b.x1 / cell), F.floor((b.x2 - 1) / cell)), lambda x: F.transform(F.sequence(F.floor(b.y1 / cell), F.floor((b.y2 - 1) / cell)), lambda y: F.struct(x.alias("cx"), y.alias("cy"))))))
    l = left.withColumn("cell", touched(Box.of()))  # noqa: E741
    r = right.withColumn("cell", touched(Box.of()))
    met = sides(l, r, [*keys, "cell"])
    a, b = Box.of(), Box.of("g_")
    own = (F.floor(F.greatest(a.x1, b.x1) / cell) == F.col("cell.cx")) & (F.floor(F.greatest(a.y1, b.y1) / cell) == F.col("cell.cy"))
    return met.where(bx.overlaps(a, b) & own).drop("cell")


def greedy_fold(pairs: Column, order: str) -> Column:
    """One-to-one matches from an array of struct(..., p, g, iou) sorted as wanted: each takes what is still free.

    ``order`` is the DDL of the element's struct.
    """
    init = F.struct(F.array().cast("array<bigint>").alias("p"), F.array().cast("array<bigint>").alias("g"), F.array().cast(f"array<{order}>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        free = ~F.array_contains(a["p"], x["p"]) & ~F.array_contains(a["g"], x["g"])
        taken = F.struct(F.array_append(a["p"], x["p"]).alias("p"), F.array_append(a["g"], x["g"]).alias("g"), F.array_append(a["out"], x).alias("out"))
        return F.when(free, taken).otherwise(a)

    return F.aggregate(pairs, init, step, lambda a: a["out"])


_PAIR = "struct<o1:double,o2:double,o3:bigint,o4:bigint,p:bigint,g:bigint,iou:double>"


def _fold_pairs(pairs: DataFrame, keys: Sequence[str], order: Sequence[Column], p: str, g: str) -> DataFrame:
    """keys, p, g, iou after a greedy pass over the pairs in ascending ``order`` (two doubles, two longs)."""
    kinds = ("double", "double", "bigint", "bigint")
    cols = [c.cast(k).alias(f"o{i + 1}") for i, (c, k) in enumerate(zip(order, kinds, strict=True))]
    element = F.struct(*cols, F.col(p).cast("bigint").alias("p"), F.col(g).cast("bigint").alias("g"), F.col("iou").cast("double").alias("iou")).cast(_PAIR)
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(element)).alias("pairs"))
    return grouped.select(*keys, F.inline(greedy_fold(F.col("pairs"), _PAIR))).select(*keys, "p", "g", "iou")


def confidence_outcomes(preds: DataFrame, gts: DataFrame, keys: Sequence[str] = ("image", "cls"), threshold: float = 0.5) -> DataFrame:
    """By confidence (ties: smaller det) each prediction takes the best ground truth that is still free (ties: larger gt).

    keys, outcome, det, gt, iou: TP for a match, FP for a prediction without one (gt null, the best IoU over all ground
    truth of the keys), FN for ground truth without one (det null, iou 0). Only pairs at the threshold or above can match.
    """
    keys = list(keys)

    def judge(m: pr.Pairs) -> pa.Table:
        near, best = [], np.zeros(len(m.p))
        for i, j, iou in m.chunks():
            np.maximum.at(best, i, iou)
            some = (iou >= threshold) & (iou > 0)
            near.append((i[some], j[some], iou[some]))
        i, j, iou = (np.concatenate(c) for c in zip(*near, strict=True)) if near else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        conf = m.of_p("conf")
        conf = np.where(np.isnan(conf), np.inf, conf)
        order = np.lexsort((-m.g_id[j], -iou, m.p_id[i], -conf[i]))
        partner, free = np.full(len(m.p), -1), np.ones(len(m.g), bool)
        score = best.copy()
        for a, b, x in zip(i[order].tolist(), j[order].tolist(), iou[order].tolist(), strict=True):
            if partner[a] < 0 and free[b]:
                partner[a], free[b], score[a] = b, False, x
        hit, lost = partner >= 0, np.flatnonzero(free)
        gt = pa.array(np.append(m.g_id, 0)[np.append(partner, lost)], mask=np.append(~hit, np.zeros(len(lost), bool)))
        det = pa.array(np.append(m.p_id, np.zeros(len(lost), np.int64)), mask=np.append(np.zeros(len(m.p), bool), np.ones(len(lost), bool)))
        outcome = np.append(np.where(hit, "TP", "FP"), np.full(len(lost), "FN"))
        return pa.table(m.rows(np.append(m.p, m.g[lost]), keys) | {"outcome": pa.array(outcome.tolist(), pa.string()), "det": det, "gt": gt, "iou": np.append(score, np.zeros(len(lost)))})

    columns = [*[(k, preds.schema[k].dataType) for k in keys], ("outcome", "string"), ("det", preds.schema["det"].dataType), ("gt", gts.schema["gt"].dataType), ("iou", "double")]
    return pr.met(pr.side(preds, keys, "det", conf=F.col("conf").cast("double")), pr.side(gts, keys, "gt"), keys, judge, columns)


def confidence_greedy(preds: DataFrame, gts: DataFrame, keys: Sequence[str] = ("image", "cls"), threshold: float = 0.5) -> dict[str, DataFrame]:
    """``confidence_outcomes`` as matches (keys, det, gt, iou), false_positives (keys, det, best_iou) and false_negatives
    (keys, gt).
    """
    keys, of = list(keys), confidence_outcomes(preds, gts, keys, threshold)
    part = lambda outcome, *columns: of.where(F.col("outcome") == outcome).select(*keys, *columns)
    return {"matches": part("TP", *[F.col(c).cast("bigint").alias(c) for c in ("det", "gt")], "iou"), "false_positives": part("FP", "det", F.col("iou").alias("best_iou")), "false_negatives": part("FN", "gt")}


def centre_greedy(preds: DataFrame, gts: DataFrame, width: Column, height: Column, share: float = 0.12, keys: Sequence[str] = ("image", "cls")) -> DataFrame:
    """Ground truth whose centre lies in the buffered box (closed); pairs by (confidence, IoU, det, gt), all descending."""
    keys = list(keys)
    pairs = sides(preds, gts, keys)
    g = Box.of("g_")
    pairs = pairs.where(bx.contains_point(bx.buffer(Box.of(), width, height, share), g.cx, g.cy, closed=True)).withColumn("iou", bx.iou(Box.of(), g))
    return _fold_pairs(pairs, keys, (-F.col("conf"), -F.col("iou"), -F.col("det"), -F.col("g_gt")), "det", "g_gt").select(*keys, F.col("p").alias("det"), F.col("g").alias("gt"), "iou")


def iou_greedy(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("image", "cls")) -> DataFrame:
    """Pairs with any overlap, by (IoU, det, gt), all descending; each side once."""
    keys = list(keys)
    pairs = sides(left, right, keys).where(bx.overlaps(Box.of(), Box.of("g_"))).withColumn("iou", bx.iou(Box.of(), Box.of("g_"))).where("iou > 0")
    return _fold_pairs(pairs, keys, (-F.col("iou"), F.lit(0.0), -F.col("det"), -F.col("g_gt")), "det", "g_gt").select(*keys, F.col("p").alias("det"), F.col("g").alias("gt"), "iou")


def claimed(preds: DataFrame, gts: DataFrame, least: float = 0.5, keys: Sequence[str] = ("image", "cls")) -> DataFrame:
    """Validation matching: a prediction considers its best ground truth alone (first on ties); the first prediction by
    confidence (then det) that has IoU > ``least`` claims it. keys, det, conf, and gt and iou or nulls, a row a prediction.
    """
    keys = list(keys)

    def judge(m: pr.Pairs) -> pa.Table:
        found, iou = m.best()
        conf = m.of_p("_conf")
        at = np.flatnonzero((found >= 0) & (iou > 0) & (iou > least))
        at = at[pr.first_of(found[at], -np.where(np.isnan(conf[at]), -np.inf, conf[at]), m.p_id[at])]
        none = np.ones(len(m.p), bool)
        none[at] = False
        gt = np.append(m.g_id, 0)[np.where(none, -1, found)]
        return pa.table(m.rows(m.p, [*keys, "conf"]) | {"det": m.p_id, "gt": pa.array(gt, mask=none), "iou": pa.array(iou, mask=none)})

    kind = lambda c: (c, preds.schema[c].dataType)
    columns = [*map(kind, keys), kind("det"), kind("conf"), ("gt", gts.schema["gt"].dataType), ("iou", "double")]
    return pr.met(pr.side(preds, keys, "det", conf=F.col("conf"), _conf=F.col("conf").cast("double")), pr.side(gts, keys, "gt"), keys, judge, columns)


def first_claims(preds: DataFrame, gts: DataFrame, thresholds: Sequence[float], least: float = 0.5, keys: Sequence[str] = ("image", "cls")) -> DataFrame:
    """The claims of ``claimed``: one row a claim and threshold, ``correct`` if IoU > it."""
    claim = claimed(preds, gts, least, keys).where("gt IS NOT NULL")
    return claim.select(*keys, "det", "gt", "iou", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).withColumn("correct", F.col("iou") > F.col("threshold"))


def mutual_best(preds: DataFrame, gts: DataFrame, levels: Sequence[float], keys: Sequence[str] = ("image", "cls")) -> DataFrame:
    """At each level: pairs at or above it; the best of each detection, then of each label the first by detection.

    A detection's best pair is the same at all levels that it reaches, so that it is looked for once.
    """
    keys = list(keys)

    def judge(m: pr.Pairs) -> pa.Table:
        found, iou = m.best()
        some = np.flatnonzero((found >= 0) & (iou > 0))
        some = some[np.lexsort((m.p_id[some], found[some]))]
        each = [at[pr.fresh(found[at])] for at in (some[iou[some] >= level] for level in levels)]
        at = np.concatenate(each)
        return pa.table(m.rows(m.p[at], keys) | {"level": np.repeat(np.array(levels, float), [len(x) for x in each]), "det": m.p_id[at], "gt": m.g_id[found[at]], "iou": iou[at]})

    columns = [*[(k, preds.schema[k].dataType) for k in keys], ("level", "double"), ("det", preds.schema["det"].dataType), ("gt", gts.schema["gt"].dataType), ("iou", "double")]
    return pr.met(pr.side(preds, keys, "det"), pr.side(gts, keys, "gt"), keys, judge, columns)


def assign_words(words: DataFrame, tracks: DataFrame, width: Column, height: Column, share: float = 0.12) -> DataFrame:
    """Each word's track: the first whose buffered box holds the word's centre, else the best by IoU above 0.

    words: image, word, box; tracks: image, det, box; ``width`` and ``height``: literals, or columns of tracks.
    """
    sides_ = ("_x1", "_y1", "_x2", "_y2")
    wide = {k: c.cast("double") for k, c in zip(sides_, bx.buffer(Box.of(), width, height, share), strict=True)}

    def judge(m: pr.Pairs) -> pa.Table:
        x, y = (m.of_p("x1") + m.of_p("x2")) / 2, (m.of_p("y1") + m.of_p("y2")) / 2
        x1, y1, x2, y2 = (m.of_g(c) for c in sides_)
        best, top, holder = np.full(len(m.p), -1), np.zeros(len(m.p)), np.full(len(m.p), -1)
        for i, j, iou in m.chunks():
            held = (x[i] >= x1[j]) & (y[i] >= y1[j]) & (x[i] < x2[j]) & (y[i] < y2[j])
            a, b = i[held], j[held]
            holder[a[pr.fresh(a)]] = b[pr.fresh(a)]
            found, most = m.best(chunks=[(i, j, iou)])
            best, top = np.where(found >= 0, found, best), np.where(found >= 0, most, top)
        det = np.where(holder >= 0, holder, np.where(top > 0, best, -1))
        at = np.flatnonzero(det >= 0)
        how = pa.array(np.where(holder[at] >= 0, "centre", "overlap").tolist(), pa.string())
        return pa.table(m.rows(m.p[at], ["image"]) | {"word": m.p_id[at], "det": m.g_id[det[at]], "how": how})

    columns = [("image", words.schema["image"].dataType), ("word", words.schema["word"].dataType), ("det", tracks.schema["det"].dataType), ("how", "string")]
    return pr.met(pr.side(words, ["image"], "word"), pr.side(tracks, ["image"], "det", **wide), ["image"], judge, columns)


def child_to_parent(children: DataFrame, parents: DataFrame, share: float = 0.5) -> DataFrame:
    """A child belongs to a parent that holds its centre (closed) or covers ``share`` of it; among several the greatest
    (coverage, nearness, smaller area, confidence), then the smaller parent. Parents get ranks from left to right.
    """
    c, p = Box.of(), Box.of("g_")
    ranked = parents.withColumn("parent_rank", F.row_number().over(Window.partitionBy("image").orderBy("x1", "det")))
    pairs = sides(children, ranked, ["image"]).withColumn("cover", bx.coverage(c, p))
    pairs = pairs.where(bx.contains_point(p, c.cx, c.cy, closed=True) | (F.col("cover") >= share))
    away = F.pow(c.cx - p.cx, F.lit(2)) + F.pow(c.cy - p.cy, F.lit(2))
    by = Window.partitionBy("image", "child").orderBy(F.col("cover").desc(), away, p.area, F.col("g_conf").desc(), "g_det")
    n = F.count(F.lit(1)).over(Window.partitionBy("image", "child"))
    return pairs.withColumns({"rn": F.row_number().over(by), "n_parents": n}).where("rn = 1").select("image", "child", F.col("g_det").alias("parent"), F.col("g_parent_rank").alias("parent_rank"), "n_parents", "cover")


def first_containing(points: DataFrame, areas: DataFrame, point_id: str, strict: bool = True) -> DataFrame:
    """points: image, ``point_id``, x, y; areas: image, det, box -> the first area that holds each point."""
    pairs = sides(points, areas, ["image"])
    b, x, y = Box.of("g_"), F.col("x"), F.col("y")
    held = (x > b.x1) & (x < b.x2) & (y > b.y1) & (y < b.y2) if strict else bx.contains_point(b, x, y, closed=True)
    return pairs.where(held).groupBy("image", point_id).agg(F.min("g_det").alias("det"))


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], least: float, cell: int = 8) -> DataFrame:
    """Pairs of boxes of equal keys whose IoU is ``least`` or more, each once, with ``iou``.

    An inverted index on corners: such boxes overlap in each direction by ``least`` of the wider one, so that their upper
    left corners differ by at most (1 - least) / least of the left box's sides. Each right box has one posting, by the
    cell of its corner; each left box probes the cells that its partners' corners can be in.
    """
    a, b = Box.of(), Box.of("g_")
    reach = (1 - least) / least
    cells = lambda at, size: F.sequence(F.floor((at - reach * size) / cell), F.floor((at + reach * size) / cell))
    probes = F.flatten(F.transform(cells(a.x1, a.x2 - a.x1), lambda x: F.transform(cells(a.y1, a.y2 - a.y1), lambda y: F.struct(x.alias("cx"), y.alias("cy")))))
    posted = right.withColumn("cell", F.struct(F.floor(a.x1 / cell).alias("cx"), F.floor(a.y1 / cell).alias("cy")))
    met = sides(left.withColumn("cell", F.explode(probes)), posted, [*keys, "cell"]).drop("cell")
    return met.where(bx.overlaps(a, b)).withColumn("iou", bx.iou(a, b)).where(F.col("iou") >= least)


def infer_in_block(preds: DataFrame, gts: DataFrame, block: str, least: float = 1.0) -> DataFrame:
    """As ``infer_image``, where only images of a source's ``block`` (a column of both sides) are its candidates.

    A block is a bounded number of images: all its boxes meet as matrices, a class at a time, and no pair is a row.
    """
    return _best_by_matrix(preds, gts, [block], least)


def _best_by_matrix(preds: DataFrame, gts: DataFrame, block: Sequence[str], least: float) -> DataFrame:
    cols = [*block, "cls", "x1", "y1", "x2", "y2"]
    p, g = preds.select("source", "det", *cols), gts.select("image", *cols)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        from gondola.operators.inference import best_images

        return best_images(left, right, least)

    return p.groupBy(*block).cogroup(g.groupBy(*block)).applyInArrow(best, "source bigint, image bigint, score double")


def infer_image(preds: DataFrame, gts: DataFrame, least: float = 1.0, near: float = 0.5, boxes: tuple[int, int] = (16_000, 50_000), most_tasks: int = 2_000) -> DataFrame:
    """For each ``source`` of preds the image whose boxes fit best: over predictions, the sum of the best same-class IoU.

    preds: source, det, cls, box (image unknown); gts: image, cls, box. Ties take the greater image; a score under
    ``least`` gives no row. Every image is a candidate for every source.

    Sources and images are dealt by hash into parts of about ``boxes`` boxes; each part of the sources meets each part of
    the images in one group, as matrices, so that a task's memory doesn't grow with the tables. The work is the number of
    pairs, which grows with both sides. ``near`` has no effect; it bounded the scores of a former index.
    """
    p, g = preds.where("source IS NOT NULL"), gts.where("image IS NOT NULL")
    parts = [-(-max(1, df.count()) // n) for df, n in zip((p, g), boxes, strict=True)]
    dealt = lambda df, c, name, n: df.withColumn(name, F.pmod(F.xxhash64(c), F.lit(n)).cast("int"))
    each = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    tasks, block = min(most_tasks, parts[0] * parts[1]), ["_sources", "_images"]
    p = each(dealt(p, "source", "_sources", parts[0]), "_images", parts[1]).repartition(tasks, *block)
    g = each(dealt(g, "image", "_images", parts[1]), "_sources", parts[0]).repartition(tasks, *block)
    best = _best_by_matrix(p, g, block, least).groupBy("source").agg(F.max(F.struct("score", "image")).alias("t"))
    return best.select("source", "t.image", "t.score")


def exact_lookup(requests: DataFrame, observations: DataFrame) -> DataFrame:
    """Requests (request, store, sku) with all observations (store, sku, conf, ts) of the same store and code, best first.

    status FOUND or NO_MATCH; candidates by confidence descending, then time ascending. Never across stores. Only what
    somebody asks for is gathered.
    """
    asked = observations.join(requests.select("store", "sku").distinct(), ["store", "sku"], "left_semi")
    found = asked.groupBy("store", "sku").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("neg"), "ts"))).alias("c"))
    joined = requests.join(found, ["store", "sku"], "left")
    cands = F.transform("c", lambda x: F.struct((-x["neg"]).alias("conf"), x["ts"].alias("ts")))
    return joined.select("request", "store", "sku", F.when(F.col("c").isNull(), "NO_MATCH").otherwise("FOUND").alias("status"), F.coalesce(cands, F.array().cast("array<struct<conf:bigint,ts:string>>")).alias("candidates"))


def carry_forward(rows: DataFrame, prior: DataFrame, least: float = 0.65) -> DataFrame:
    """rows: key, image, cls, box; prior: the same and value. A row takes the value of its key, else of the prior row of
    the same image and class with the greatest IoU at or above ``least`` (ties: smaller key).
    """
    by_key = rows.join(prior.select("key", F.col("value").alias("v_key")), "key", "left")
    rest = by_key.where("v_key IS NULL").drop("v_key")
    near = sides(rest, prior, ["image", "cls"]).where(bx.overlaps(Box.of(), Box.of("g_"))).withColumn("iou", bx.iou(Box.of(), Box.of("g_"))).where(F.col("iou") >= least)
    pick = near.groupBy("key").agg(F.min(F.struct((-F.col("iou")).alias("neg"), "g_key", "g_value")).alias("m")).select("key", F.col("m.g_value").alias("v_near"))
    out = by_key.join(pick, "key", "left")
    return out.select("key", F.coalesce("v_key", "v_near").alias("value"), F.when(F.col("v_key").isNotNull(), "key").when(F.col("v_near").isNotNull(), "overlap").otherwise("none").alias("how"))
