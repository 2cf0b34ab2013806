"""Joins and matching over the box fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.functions import codes
from gondola.operators import match, review
from gondola.plans import fixtures as fx
from gondola.plans.fixtures import with_tables
from gondola.plans.registry import query

_R = lambda c: F.round(c, 6)

#: All pairs of one image and class that overlap, with their IoU.
_PAIRS = """
  prs AS (SELECT *, inter / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter) AS iou FROM (
    SELECT p.image, p.cls, p.det, p.conf, p.x1, p.y1, p.x2, p.y2, g.gt, g.x1 AS a1, g.y1 AS b1, g.x2 AS a2, g.y2 AS b2,
      greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter
    FROM pred_boxes p JOIN gt_boxes g ON p.image = g.image AND p.cls = g.cls))"""


def greedy_sql(pairs: str, order: str) -> str:
    """Greedy one-to-one matching of ``pairs`` (image, cls, det, gt, iou) in ``order``, as a list reduction."""
    return f"""
  srt AS (SELECT image, cls, list({{'p': [det], 'g': [gt], 'o': [{{'det': det, 'gt': gt, 'iou': iou}}]}} ORDER BY {order}) AS l FROM {pairs} GROUP BY image, cls),
  grd AS (SELECT image, cls, list_reduce(l, lambda a, x: CASE WHEN list_contains(a.p, x.p[1]) OR list_contains(a.g, x.g[1]) THEN a ELSE {{'p': a.p || x.p, 'g': a.g || x.g, 'o': a.o || x.o}} END) AS r FROM srt),
  mat AS (SELECT image, cls, o.det AS det, o.gt AS gt, o.iou AS iou FROM (SELECT image, cls, unnest(r.o) AS o FROM grd))"""


CONFIDENCE = greedy_sql("(SELECT * FROM prs WHERE iou >= 0.5)", "conf DESC, det, iou DESC, gt DESC")


def _sides(spark, sf_dir):
    return fx.pred_boxes(spark, sf_dir).drop("pk", "sk"), fx.gt_boxes(spark, sf_dir).drop("pk", "sk")


@query(with_tables("SELECT image, cls, det, gt, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY image, cls, det ORDER BY iou DESC, gt) AS rn FROM prs) WHERE rn = 1", "pred_boxes", "gt_boxes", more=_PAIRS))
def j2_iou_argmax(spark, sf_dir):
    p, g = _sides(spark, sf_dir)
    return match.best_match(p, g, ["image", "cls"], "det", "gt").select("image", "cls", "det", F.col("g_gt").alias("gt"), _R("iou").alias("iou"))


@query(with_tables("""SELECT image, gt, det, conf FROM (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY conf DESC, det) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY image, cls, det ORDER BY iou DESC, gt) AS rn FROM prs WHERE iou >= 0.25) WHERE rn = 1) WHERE r2 = 1""", "pred_boxes", "gt_boxes", more=_PAIRS))
def j3_suggestions(spark, sf_dir):
    p, g = _sides(spark, sf_dir)
    best = match.best_match(p, g, ["image", "cls"], "det", "gt", minimum=0.25, keep=["conf"])
    top = best.groupBy("image", F.col("g_gt").alias("gt")).agg(F.max(F.struct("conf", (-F.col("det")).alias("d"))).alias("t"))
    return top.select("image", "gt", (-F.col("t.d")).alias("det"), "t.conf")


@query(with_tables("SELECT image, cls, det, gt, round(iou, 6) AS iou FROM mat", "pred_boxes", "gt_boxes", more=_PAIRS + "," + CONFIDENCE))
def j4_confidence_greedy(spark, sf_dir):
    return match.confidence_greedy(*_sides(spark, sf_dir))["matches"].withColumn("iou", _R("iou"))


_SURPLUS = """
  bst AS (SELECT image, cls, det, max(iou) AS iou FROM prs GROUP BY image, cls, det),
  fps AS (SELECT p.image, p.cls, p.det, coalesce(b.iou, 0) AS iou FROM pred_boxes p LEFT JOIN bst b USING (image, cls, det) WHERE NOT EXISTS (FROM mat m WHERE m.image = p.image AND m.cls = p.cls AND m.det = p.det)),
  fns AS (SELECT image, cls, gt FROM gt_boxes g WHERE NOT EXISTS (FROM mat m WHERE m.image = g.image AND m.cls = g.cls AND m.gt = g.gt))"""


@query(with_tables("SELECT image, cls, det AS id, 'FP' AS outcome, round(iou, 6) AS iou, CASE WHEN iou >= 0.5 THEN 'duplicate_prediction' ELSE 'false_positive' END AS category FROM fps UNION ALL SELECT image, cls, gt, 'FN', 0, 'detection_missed' FROM fns", "pred_boxes", "gt_boxes", more=_PAIRS + "," + CONFIDENCE + "," + _SURPLUS))
def j4_surplus_and_missed(spark, sf_dir):
    m = match.confidence_outcomes(*_sides(spark, sf_dir)).where("outcome <> 'TP'")
    category = F.when(F.col("outcome") == "FN", "detection_missed").when(F.col("iou") >= 0.5, "duplicate_prediction").otherwise("false_positive")
    return m.select("image", "cls", F.coalesce("det", "gt").alias("id"), "outcome", _R("iou").alias("iou"), category.alias("category"))


_CENTRE = """(SELECT * FROM prs WHERE (a1 + a2) / 2 BETWEEN greatest(0, x1 - trunc((x2 - x1) * 0.12)) AND least(240, x2 + trunc((x2 - x1) * 0.12)) AND (b1 + b2) / 2 BETWEEN greatest(0, y1 - trunc((y2 - y1) * 0.12)) AND least(100, y2 + trunc((y2 - y1) * 0.12)))"""


@query(with_tables("SELECT image, cls, det, gt, round(iou, 6) AS iou FROM mat", "pred_boxes", "gt_boxes", more=_PAIRS + "," + greedy_sql(_CENTRE, "conf DESC, iou DESC, det DESC, gt DESC")))
def j5_centre_greedy(spark, sf_dir):
    return match.centre_greedy(*_sides(spark, sf_dir), F.lit(240), F.lit(100)).withColumn("iou", _R("iou"))


@query(with_tables("SELECT image, cls, det, gt, round(iou, 6) AS iou FROM mat", "pred_boxes", "gt_boxes", more=_PAIRS + "," + greedy_sql("(SELECT * FROM prs WHERE iou > 0)", "iou DESC, det DESC, gt DESC")))
def j6_iou_greedy(spark, sf_dir):
    return match.iou_greedy(*_sides(spark, sf_dir)).withColumn("iou", _R("iou"))


LEVELS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
_LEVELS = "unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[])"


@query(with_tables(f"""SELECT image, cls, det, gt, threshold, iou > threshold AS correct FROM (SELECT *, {_LEVELS} AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image, cls, gt ORDER BY conf DESC, det) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY image, cls, det ORDER BY iou DESC, gt) AS rn FROM prs) WHERE rn = 1 AND iou > 0.5) WHERE r2 = 1)""", "pred_boxes", "gt_boxes", more=_PAIRS))
def j7_validation_claims(spark, sf_dir):
    return match.first_claims(*_sides(spark, sf_dir), LEVELS).select("image", "cls", "det", "gt", "threshold", "correct")


@query(with_tables(f"""SELECT level, image, cls, det, gt FROM (SELECT *, row_number() OVER (PARTITION BY level, image, cls, gt ORDER BY det) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY level, image, cls, det ORDER BY iou DESC, gt) AS rn
  FROM (SELECT * FROM (SELECT *, {_LEVELS} AS level FROM prs) WHERE iou >= level)) WHERE rn = 1) WHERE r2 = 1""", "pred_boxes", "gt_boxes", more=_PAIRS))
def j23_mutual_best(spark, sf_dir):
    return match.mutual_best(*_sides(spark, sf_dir), LEVELS).select("level", "image", "cls", "det", "gt")


_WORDS = """
  wp AS (SELECT w.image, w.idx AS word, t.gt AS det, (w.x1 + w.x2) / 2 >= greatest(0, t.x1 - trunc((t.x2 - t.x1) * 0.12)) AND (w.x1 + w.x2) / 2 < least(240, t.x2 + trunc((t.x2 - t.x1) * 0.12))
      AND (w.y1 + w.y2) / 2 >= greatest(0, t.y1 - trunc((t.y2 - t.y1) * 0.12)) AND (w.y1 + w.y2) / 2 < least(100, t.y2 + trunc((t.y2 - t.y1) * 0.12)) AS held,
      greatest(0, least(w.x2, t.x2) - greatest(w.x1, t.x1)) * greatest(0, least(w.y2, t.y2) - greatest(w.y1, t.y1)) AS inter, (w.x2 - w.x1) * (w.y2 - w.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS areas
    FROM words w JOIN gt_boxes t ON w.image = t.image AND t.gt % 5 = 0),
  wr AS (SELECT *, row_number() OVER (PARTITION BY image, word ORDER BY held DESC, CASE WHEN held THEN det ELSE -inter / (areas - inter) END, det) AS rn FROM wp WHERE held OR inter > 0)"""


@query(with_tables("SELECT image, word, det, CASE WHEN held THEN 'centre' ELSE 'overlap' END AS how FROM wr WHERE rn = 1", "pred_boxes", "gt_boxes", "words", more=_WORDS))
def j8_words_to_tracks(spark, sf_dir):
    t = fx.gt_boxes(spark, sf_dir).where("gt % 5 = 0").select("image", F.col("gt").alias("det"), "x1", "y1", "x2", "y2")
    return match.assign_words(fx.words(spark, sf_dir).withColumnRenamed("idx", "word").drop("line", "text"), t, F.lit(240), F.lit(100))


@query(with_tables("""SELECT source, image, score FROM (SELECT source, image, round(sum(iou), 9) AS score, row_number() OVER (PARTITION BY source ORDER BY round(sum(iou), 9) DESC, image DESC) AS rn FROM (
  SELECT source, det, image, max(inter / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter)) AS iou FROM (
    SELECT p.image AS source, p.det, p.x1, p.y1, p.x2, p.y2, g.image, g.x1 AS a1, g.y1 AS b1, g.x2 AS a2, g.y2 AS b2, greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter
    FROM pred_boxes p JOIN gt_boxes g ON p.cls || (p.image // 25)::VARCHAR = g.cls || (g.image // 25)::VARCHAR) WHERE inter > 0 GROUP BY source, det, image) GROUP BY source, image) WHERE rn = 1 AND score >= 1""", "pred_boxes", "gt_boxes"))
def j9_image_inference(spark, sf_dir):
    """The boxes of every image; each image is a source, and the images of its block are the candidates."""
    block = F.expr("image div 25")
    p = fx.pred_boxes(spark, sf_dir).withColumn("block", block).withColumnRenamed("image", "source")
    return match.infer_in_block(p, fx.gt_boxes(spark, sf_dir).withColumn("block", block), "block")


@query(with_tables("""SELECT source, image, score FROM (SELECT source, image, round(sum(iou), 9) AS score, row_number() OVER (PARTITION BY source ORDER BY round(sum(iou), 9) DESC, image DESC) AS rn FROM (
  SELECT source, det, image, max(inter / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter)) AS iou FROM (
    SELECT p.image AS source, p.det, p.x1, p.y1, p.x2, p.y2, g.image, g.x1 AS a1, g.y1 AS b1, g.x2 AS a2, g.y2 AS b2, greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS inter
    FROM pred_boxes p JOIN gt_boxes g ON p.cls = g.cls AND p.image % 100 = 0) WHERE inter > 0 GROUP BY source, det, image) GROUP BY source, image) WHERE rn = 1 AND score >= 1""", "pred_boxes", "gt_boxes"))
def j9_image_search(spark, sf_dir):
    """A search: every image whose id is divisible by 100 is a source without an image, all images are candidates."""
    p = fx.pred_boxes(spark, sf_dir).where("image % 100 = 0").select(F.col("image").alias("source"), "det", "cls", "x1", "y1", "x2", "y2")
    return match.infer_image(p, fx.gt_boxes(spark, sf_dir).select("image", "cls", "x1", "y1", "x2", "y2"))


@query(with_tables("""SELECT request, r.store, r.sku, CASE WHEN n IS NULL THEN 'NO_MATCH' ELSE 'FOUND' END AS status, coalesce(n, 0) AS n, coalesce(best, '') AS candidates FROM r LEFT JOIN c ON r.store = c.store AND r.sku = c.sku""", "observations", more="""o AS (SELECT store, CASE length(d) WHEN 10 THEN d WHEN 6 THEN '0000' || d END AS sku, conf, ts FROM (SELECT *, regexp_replace(sku_text, '[^0-9]', '', 'g') AS d FROM observations)),
  r AS (SELECT l_orderkey * 10 + l_linenumber AS request, (store + 1) % 20 AS store, CASE length(d) WHEN 10 THEN d WHEN 6 THEN '0000' || d END AS sku FROM (SELECT *, regexp_replace(sku_text, '[^0-9]', '', 'g') AS d FROM observations) WHERE (l_orderkey + l_linenumber) % 50 = 0),
  c AS (SELECT store, sku, count(*) AS n, string_agg(conf || '@' || ts, ',' ORDER BY conf DESC, ts) AS best FROM o WHERE sku IS NOT NULL GROUP BY store, sku)"""))
def j1_inventory_lookup(spark, sf_dir):
    o = fx.observations(spark, sf_dir).withColumn("sku", codes.published_sku(F.col("sku_text")))
    r = o.where("(l_orderkey + l_linenumber) % 50 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), ((F.col("store") + 1) % 20).alias("store"), "sku")
    found = match.exact_lookup(r, o.where("sku IS NOT NULL").select("store", "sku", "conf", "ts"))
    text = F.array_join(F.transform("candidates", lambda c: F.concat_ws("@", c["conf"], c["ts"])), ",")
    return found.select("request", "store", "sku", "status", F.size("candidates").alias("n"), text.alias("candidates"))


@query(with_tables("""SELECT k.key, coalesce(k.v, n.v) AS value, CASE WHEN k.v IS NOT NULL THEN 'key' WHEN n.v IS NOT NULL THEN 'overlap' ELSE 'none' END AS how FROM k LEFT JOIN n USING (key)""", "pred_boxes", "gt_boxes", more="""pri AS (SELECT image * 1000 + gt AS key, image, cls, x1, y1, x2, y2, gt AS value FROM gt_boxes WHERE gt % 2 = 0),
  rws AS (SELECT image * 1000 + det AS key, image, cls, x1, y1, x2, y2 FROM pred_boxes WHERE det % 3 <> 0),
  k AS (SELECT rws.*, pri.value AS v FROM rws LEFT JOIN pri USING (key)),
  n AS (SELECT key, arg_min(value, struct_pack(a := -iou, b := gk)) AS v FROM (SELECT k.key, p.key AS gk, p.value, inter / ((k.x2 - k.x1) * (k.y2 - k.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - inter) AS iou FROM (
       SELECT k.key AS kk, p.key AS pk, greatest(0, least(k.x2, p.x2) - greatest(k.x1, p.x1)) * greatest(0, least(k.y2, p.y2) - greatest(k.y1, p.y1)) AS inter FROM k JOIN pri p ON k.image = p.image AND k.cls = p.cls WHERE k.v IS NULL) z JOIN k ON z.kk = k.key JOIN pri p ON z.pk = p.key) WHERE iou >= 0.65 GROUP BY key)"""))
def j10_carry_forward(spark, sf_dir):
    key = lambda i: (F.col("image") * 1000 + F.col(i)).alias("key")
    box = ("image", "cls", "x1", "y1", "x2", "y2")
    prior = fx.gt_boxes(spark, sf_dir).where("gt % 2 = 0").select(key("gt"), *box, F.col("gt").alias("value"))
    return match.carry_forward(fx.pred_boxes(spark, sf_dir).where("det % 3 <> 0").select(key("det"), *box), prior)


_CHILD = """
  par AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY x1, det) AS rnk FROM pred_boxes WHERE det % 4 = 0),
  cp AS (SELECT c.image, c.det AS child, p.det, p.rnk, p.conf, greatest(0, least(c.x2, p.x2) - greatest(c.x1, p.x1)) * greatest(0, least(c.y2, p.y2) - greatest(c.y1, p.y1)) / ((c.x2 - c.x1) * (c.y2 - c.y1)) AS cover,
     (c.x1 + c.x2) / 2 BETWEEN p.x1 AND p.x2 AND (c.y1 + c.y2) / 2 BETWEEN p.y1 AND p.y2 AS held, ((c.x1 + c.x2) / 2 - (p.x1 + p.x2) / 2) ** 2 + ((c.y1 + c.y2) / 2 - (p.y1 + p.y2) / 2) ** 2 AS away, (p.x2 - p.x1) * (p.y2 - p.y1) AS area
     FROM pred_boxes c JOIN par p ON c.image = p.image WHERE c.det % 4 <> 0),
  cr AS (SELECT *, row_number() OVER (PARTITION BY image, child ORDER BY cover DESC, away, area, conf DESC, det) AS rn, count(*) OVER (PARTITION BY image, child) AS n FROM cp WHERE held OR cover >= 0.5)"""


@query(with_tables("SELECT image, child, det AS parent, rnk AS parent_rank, n AS n_parents, floor(cover * 1000000)::BIGINT AS cover_ppm FROM cr WHERE rn = 1", "pred_boxes", more=_CHILD))
def j11_children_to_parents(spark, sf_dir):
    p = fx.pred_boxes(spark, sf_dir).drop("pk", "sk", "cls")
    return match.child_to_parent(p.where("det % 4 <> 0").withColumnRenamed("det", "child").drop("conf"), p.where("det % 4 = 0")).select("image", "child", "parent", "parent_rank", "n_parents", F.floor(F.col("cover") * 1_000_000).alias("cover_ppm"))


@query(with_tables("SELECT w.image, w.idx AS point, min(g.gt) AS det FROM words w JOIN gt_boxes g ON w.image = g.image AND (w.x1 + w.x2) / 2 > g.x1 AND (w.x1 + w.x2) / 2 < g.x2 AND (w.y1 + w.y2) / 2 > g.y1 AND (w.y1 + w.y2) / 2 < g.y2 GROUP BY w.image, w.idx", "words", "gt_boxes"))
def j13_empty_lookup(spark, sf_dir):
    w = fx.words(spark, sf_dir).select("image", F.col("idx").alias("point"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return match.first_containing(w, fx.gt_boxes(spark, sf_dir).select("image", F.col("gt").alias("det"), "x1", "y1", "x2", "y2"), "point")


@query(with_tables("""SELECT image, det, max(hint) AS hint FROM (SELECT h.image, g.gt AS det, h.det AS hint FROM pred_boxes h JOIN gt_boxes g ON h.image = g.image
  WHERE h.x1 + (h.x2 - h.x1) * 0.2 / 2 >= g.x1 - 2 AND h.y1 + (h.y2 - h.y1) * 0.2 / 2 >= g.y1 - 2 AND h.x2 - (h.x2 - h.x1) * 0.2 / 2 <= g.x2 + 2 AND h.y2 - (h.y2 - h.y1) * 0.2 / 2 <= g.y2 + 2) GROUP BY image, det""", "pred_boxes", "gt_boxes"))
def j14_hint_overlay(spark, sf_dir):
    from gondola.functions import boxes as bx
    from gondola.functions.boxes import Box

    h, g = _sides(spark, sf_dir)
    pairs = match.sides(h.select("image", "det", "x1", "y1", "x2", "y2"), g.drop("cls"), ["image"])
    held = pairs.where(bx.inside(bx.shrink(Box.of()), Box.of("g_"), 2))
    return held.groupBy("image", F.col("g_gt").alias("det")).agg(F.max("det").alias("hint"))


@query(with_tables("""SELECT g.image, g.gt AS label, string_agg((p.sk % 10)::VARCHAR, '' ORDER BY p.x1, p.det) AS digits, round(avg(p.conf), 6) AS conf, CASE WHEN count(*) > 2 THEN left(string_agg((p.sk % 10)::VARCHAR, '' ORDER BY p.x1, p.det), -2) || '.' || right(string_agg((p.sk % 10)::VARCHAR, '' ORDER BY p.x1, p.det), 2) ELSE '0.' || lpad(string_agg((p.sk % 10)::VARCHAR, '' ORDER BY p.x1, p.det), 2, '0') END AS price
  FROM gt_boxes g JOIN pred_boxes p ON g.image = p.image AND (p.x1 + p.x2) / 2 >= g.x1 AND (p.x1 + p.x2) / 2 < g.x2 AND (p.y1 + p.y2) / 2 >= g.y1 AND (p.y1 + p.y2) / 2 < g.y2 GROUP BY g.image, g.gt""", "pred_boxes", "gt_boxes"))
def j15_digits_to_prices(spark, sf_dir):
    from gondola.operators.planogram import digits_to_prices

    d = fx.pred_boxes(spark, sf_dir).select("image", "det", "x1", "y1", "x2", "y2", "conf", (F.col("sk") % 10).alias("digit"))
    return digits_to_prices(fx.gt_boxes(spark, sf_dir).select("image", F.col("gt").alias("label"), "x1", "y1", "x2", "y2"), d).withColumn("conf", _R("conf"))


@query("""
  SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS value, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j16_truth_sync(spark, sf_dir):
    d, lab = fx.read(spark, sf_dir, "documents").select("doc_id"), fx.read(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    return d.join(lab, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("value"), F.col("hit").isNull().alias("missing"))


@query(with_tables("""SELECT image::VARCHAR || '.json' AS file, coalesce(n, 0) AS updated, coalesce(miss, 0) AS missing, coalesce(done, '') AS codes FROM (
    SELECT image, sum(CASE WHEN there THEN 1 ELSE 0 END) AS n, sum(CASE WHEN there THEN 0 ELSE 1 END) AS miss, string_agg(CASE WHEN there THEN idx || ':' || sku END, ',' ORDER BY idx) AS done
    FROM (SELECT t.*, p.det IS NOT NULL AS there FROM t LEFT JOIN pred_boxes p ON p.image = t.image AND p.det = t.idx + 1 AND p.cls = t.cls AND p.image % 9 <> 4) GROUP BY image)
  FULL JOIN (SELECT DISTINCT image FROM pred_boxes WHERE image % 9 <> 4) f USING (image)""", "pred_boxes", more="""
  t AS (SELECT image, det - 1 + CASE WHEN pk % 11 = 0 THEN 100 ELSE 0 END AS idx, CASE WHEN pk % 7 = 0 THEN 'Z' ELSE cls END AS cls, lpad((pk % 1000000)::VARCHAR, 6, '0') AS sku FROM pred_boxes WHERE sk % 3 = 0)"""))
def j16_truth_to_shapes(spark, sf_dir):
    """Truth rows set fields of the shapes in annotation files; some have no file, no such shape or another label."""
    p = fx.pred_boxes(spark, sf_dir)
    name = F.concat(F.col("image").cast("string"), F.lit(".json"))
    files = p.where("image % 9 <> 4").groupBy(name.alias("file")).agg(F.array_sort(F.collect_list(F.struct("det", F.struct(F.col("cls").alias("label")).alias("s")))).alias("d"))
    files = files.select("file", F.transform("d", lambda x: F.create_map(F.lit("label"), x["s"]["label"], F.lit("det"), x["det"].cast("string"))).alias("shapes"))
    idx = F.col("det") - 1 + F.when(F.col("pk") % 11 == 0, 100).otherwise(0)
    none = F.lit("")
    rows = p.where("sk % 3 = 0").select(
        name.alias("file"), idx.alias("shape_idx"), F.when(F.col("pk") % 7 == 0, "Z").otherwise(F.col("cls")).alias("label"), F.lpad((F.col("pk") % 1_000_000).cast("string"), 6, "0").alias("expected_sku"),
        *[none.alias(c) for c in ("review_status", "scorability", "sku_digit_class", "reviewer", "notes")], F.col("det").alias("ord"),
    )
    done = review.sync_truth(files, review.truth_values(rows))
    told = F.filter(F.transform("shapes", lambda s, i: F.concat(i.cast("string"), F.lit(":"), s["expected_sku"])), lambda x: x.isNotNull())
    return done.select("file", "updated", "missing", F.coalesce(F.array_join(told, ","), F.lit("")).alias("codes"))


@query(with_tables("SELECT coalesce(p.image, g.image) AS image, coalesce(p.n, 0) AS n_pred, coalesce(g.n, 0) AS n_gt FROM (SELECT image, count(*) AS n FROM pred_boxes WHERE image % 3 <> 0 GROUP BY image) p FULL JOIN (SELECT image, count(*) AS n FROM gt_boxes WHERE image % 5 <> 0 GROUP BY image) g ON p.image = g.image", "pred_boxes", "gt_boxes"))
def j18_image_universe(spark, sf_dir):
    p, g = _sides(spark, sf_dir)
    n = lambda df, c: df.groupBy("image").agg(F.count(F.lit(1)).alias(c))
    return n(p.where("image % 3 <> 0"), "n_pred").join(n(g.where("image % 5 <> 0"), "n_gt"), "image", "full").na.fill(0, ["n_pred", "n_gt"])


@query(with_tables("SELECT image, gt, EXISTS (FROM pred_boxes p WHERE p.image = g.image AND p.cls = g.cls AND p.conf >= 50 AND (g.x1 + g.x2) / 2 BETWEEN p.x1 AND p.x2 AND (g.y1 + g.y2) / 2 BETWEEN p.y1 AND p.y2) AS hit FROM gt_boxes g", "pred_boxes", "gt_boxes"))
def j19_any_track_hit(spark, sf_dir):
    p, g = _sides(spark, sf_dir)
    t = p.where("conf >= 50").select("image", "cls", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    hit = g.join(t, ["image", "cls"]).where("(x1 + x2) / 2 BETWEEN t_x1 AND t_x2 AND (y1 + y2) / 2 BETWEEN t_y1 AND t_y2").select("image", "gt").distinct().withColumn("hit", F.lit(True))
    return g.select("image", "gt").join(hit, ["image", "gt"], "left").na.fill(False, ["hit"])


@query(with_tables("""SELECT image, pos, CASE WHEN a IS NULL THEN 'only_b' WHEN b IS NULL THEN 'only_a' WHEN a = b THEN 'same' ELSE 'changed' END AS verdict FROM (
  SELECT coalesce(a.image, b.image) AS image, coalesce(a.pos, b.pos) AS pos, a.v AS a, b.v AS b FROM (SELECT image, det AS pos, x1 AS v FROM pred_boxes) a FULL JOIN (SELECT image, row_number() OVER (PARTITION BY image ORDER BY gt) AS pos, x1 AS v FROM gt_boxes) b ON a.image = b.image AND a.pos = b.pos)""", "pred_boxes", "gt_boxes"))
def j20_positional_compare(spark, sf_dir):
    p, g = _sides(spark, sf_dir)
    listed = g.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("gt", "x1"))), lambda x: x["x1"]).alias("v"))
    b = listed.select("image", F.posexplode("v").alias("i", "b")).select("image", (F.col("i") + 1).alias("pos"), "b")
    both = p.select("image", F.col("det").alias("pos"), F.col("x1").alias("a")).join(b, ["image", "pos"], "full")
    verdict = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select("image", "pos", verdict.alias("verdict"))


@query(with_tables("""SELECT image, idx, span, x1, x2 FROM (SELECT *, CASE WHEN text = s THEN 1 WHEN text || nxt = s THEN 2 WHEN prv || text || nxt = s THEN 3 END AS span, CASE WHEN text = s OR text || nxt = s THEN ox1 ELSE px1 END AS x1, CASE WHEN text = s THEN ox2 ELSE nx2 END AS x2
  FROM (SELECT image, idx, text, x1 AS ox1, x2 AS ox2, lead(text) OVER w AS nxt, lag(text) OVER w AS prv, lead(x2) OVER w AS nx2, lag(x1) OVER w AS px1, '1004334-515' AS s FROM words WINDOW w AS (PARTITION BY image ORDER BY idx))) WHERE span IS NOT NULL""", "words"))
def j21_text_boxes(spark, sf_dir):
    from gondola.operators.text import text_boxes

    return text_boxes(fx.words(spark, sf_dir), F.lit("1004334-515"))
