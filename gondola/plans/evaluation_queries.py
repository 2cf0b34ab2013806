"""Evaluation, suppression and text candidates over the fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gondola.functions import codes
from gondola.operators import evaluate, match, suppress, text
from gondola.operators.evaluate import count_if
from gondola.plans import fixtures as fx
from gondola.plans.fixtures import with_tables
from gondola.plans.match_queries import _LEVELS, _PAIRS, _SURPLUS, CONFIDENCE, LEVELS, _sides
from gondola.plans.registry import query

_R = lambda c: F.round(c, 6)
_MATCHED = _PAIRS + "," + CONFIDENCE + "," + _SURPLUS
_TABLES = ("pred_boxes", "gt_boxes")
_PR = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@query(with_tables(f"""SELECT cls, tp, fp, fn, {_PR} FROM (SELECT cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT cls, 1 AS tp, 0 AS fp, 0 AS fn FROM mat UNION ALL SELECT cls, 0, 1, 0 FROM fps UNION ALL SELECT cls, 0, 0, 1 FROM fns) GROUP BY cls)""", *_TABLES, more=_MATCHED))
def a1_class_metrics(spark, sf_dir):
    p, g = _sides(spark, sf_dir)
    c = evaluate.class_counts(p, g, match.confidence_greedy(p, g)["matches"])
    return c.select("cls", "tp", "fp", "fn", *[_R(x).alias(x) for x in ("precision", "recall", "f1")])


@query(with_tables("""SELECT image, count(*) AS n_pred, sum(CASE WHEN conf >= 50 THEN 1 ELSE 0 END) AS n_found, sum(CASE WHEN sk % 2 = 0 THEN 1 ELSE 0 END) AS n_even, max(dup) AS duplicate_ids FROM pred_boxes JOIN (
  SELECT image, sum(n - 1) AS dup FROM (SELECT image, sk, count(*) AS n FROM pred_boxes GROUP BY image, sk) GROUP BY image) USING (image) GROUP BY image""", "pred_boxes"))
def a2_a3_image_metrics(spark, sf_dir):
    p = fx.pred_boxes(spark, sf_dir)
    rows = p.groupBy("image").agg(F.count(F.lit(1)).alias("n_pred"), count_if(F.col("conf") >= 50).alias("n_found"), count_if(F.col("sk") % 2 == 0).alias("n_even"))
    return rows.join(evaluate.duplicate_ids(p, "image", "sk"), "image")


_REGION = """
  reg AS (SELECT g.image, g.gt, g.pk, g.sk, m.det, CASE WHEN m.det IS NULL THEN NULL ELSE greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) / ((g.x2 - g.x1) * (g.y2 - g.y1)) END AS cover
    FROM gt_boxes g LEFT JOIN mat m ON m.image = g.image AND m.cls = g.cls AND m.gt = g.gt LEFT JOIN pred_boxes p ON p.image = m.image AND p.det = m.det),
  cat AS (SELECT *, CASE WHEN det IS NULL THEN 'detection_missed' WHEN cover < 0.9 THEN 'poor_crop_coverage' WHEN sk % 7 = 0 THEN 'segmentation_missing' WHEN pk % 5 = 0 THEN 'not_ocr_scorable'
     WHEN pk % 11 = 0 AND sk % 2 = 0 THEN 'invalid_sku_length' WHEN pk % 11 = 0 THEN 'ocr_missing' WHEN pk % 3 = 0 THEN 'ocr_incorrect' ELSE 'correct' END AS category FROM reg)"""


def _regions(spark, sf_dir):
    from gondola.functions import boxes as bx
    from gondola.functions.boxes import Box

    p, g = _sides(spark, sf_dir)
    m = match.confidence_greedy(p, g)["matches"].select("image", "cls", "gt", "det")
    full = fx.gt_boxes(spark, sf_dir).join(m, ["image", "cls", "gt"], "left")
    boxes = p.select("image", "det", *[F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")])
    r = full.join(boxes, ["image", "det"], "left").withColumn("cover", bx.coverage(Box.of(), Box.of("p_")))
    predicted = F.when(F.col("pk") % 11 == 0, "").when(F.col("pk") % 3 == 0, "1").otherwise("2")
    return r.withColumn("category", evaluate.failure_category(F.col("det").isNotNull(), F.col("cover"), F.col("sk") % 7 != 0, F.col("pk") % 5 != 0, predicted, F.col("sk") % 2 == 0, F.lit("2")))


@query(with_tables("SELECT category, count(*) AS n FROM cat GROUP BY category", *_TABLES, more=_MATCHED + "," + _REGION))
def a4_failure_taxonomy(spark, sf_dir):
    return _regions(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("""SELECT unnest(['regions', 'found_rate', 'mean_coverage', 'full_coverage_rate', 'end_to_end', 'conditional']) AS metric, unnest([n::DOUBLE, round(found / n, 6), round(cover, 6), round(whole / found, 6), round(good / scorable, 6), round(good / nullif(read, 0), 6)]) AS value, unnest([NULL, n, found, found, scorable, read]::BIGINT[]) AS denominator
  FROM (SELECT count(*) AS n, count(det) AS found, avg(cover) AS cover, sum(CASE WHEN cover >= 0.999 THEN 1 ELSE 0 END) AS whole, sum(CASE WHEN category = 'correct' THEN 1 ELSE 0 END) AS good, sum(CASE WHEN pk % 5 <> 0 THEN 1 ELSE 0 END) AS scorable, sum(CASE WHEN category IN ('correct', 'ocr_incorrect') THEN 1 ELSE 0 END) AS read FROM cat)""", *_TABLES, more=_MATCHED + "," + _REGION))
def a5_a6_summary(spark, sf_dir):
    r = _regions(spark, sf_dir)
    found = F.col("det").isNotNull()
    w = r.agg(F.count(F.lit(1)).alias("n"), F.count("det").alias("found"), F.avg(F.when(found, F.col("cover"))).alias("cover"), count_if(found & (F.col("cover") >= 0.999)).alias("whole"), count_if(F.col("category") == "correct").alias("good"), count_if(F.col("pk") % 5 != 0).alias("scorable"), count_if(F.col("category").isin("correct", "ocr_incorrect")).alias("read"))
    c = F.col
    out = evaluate.long_summary(w, {"regions": (c("n"), None), "found_rate": (c("found") / c("n"), c("n")), "mean_coverage": (c("cover"), c("found")), "full_coverage_rate": (c("whole") / c("found"), c("found")), "end_to_end": (c("good") / c("scorable"), c("scorable")), "conditional": (c("good") / F.nullif(c("read"), F.lit(0)), c("read"))})
    return out.withColumn("value", _R("value"))


@query(with_tables("SELECT image, sk % 50 AS sku, count(*) AS quantity, string_agg(x1 || ':' || y1, ',' ORDER BY det) AS boxes FROM pred_boxes GROUP BY image, sk % 50", "pred_boxes"))
def a7_sku_payload(spark, sf_dir):
    g = fx.pred_boxes(spark, sf_dir).groupBy("image", (F.col("sk") % 50).alias("sku")).agg(F.array_sort(F.collect_list(F.struct("det", "x1", "y1"))).alias("b"))
    return g.select("image", "sku", F.size("b").alias("quantity"), F.array_join(F.transform("b", lambda x: F.concat_ws(":", x["x1"], x["y1"])), ",").alias("boxes"))


@query(with_tables("SELECT image, string_agg(cls || '=' || n, ';' ORDER BY cls) AS histogram, sum(n) AS n FROM (SELECT image, cls, count(*) AS n FROM pred_boxes GROUP BY image, cls) GROUP BY image", "pred_boxes"))
def a8_label_histogram(spark, sf_dir):
    n = fx.pred_boxes(spark, sf_dir).groupBy("image", "cls").agg(F.count(F.lit(1)).alias("n"))
    h = n.groupBy("image").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("m"), F.sum("n").alias("n"))
    return h.select("image", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("histogram"), "n")


@query(with_tables("""SELECT threshold, sum(hit) AS matched, round(avg(CASE WHEN hit = 1 THEN iou END), 6) AS mean_iou, round(median(CASE WHEN hit = 1 THEN iou END), 6) AS median_iou, round(min(CASE WHEN hit = 1 THEN iou END), 6) AS least_iou, round(avg(CASE WHEN hit = 1 THEN 2 * iou / (1 + iou) END), 6) AS mean_dice
  FROM (SELECT t AS threshold, iou, CASE WHEN iou >= t THEN 1 ELSE 0 END AS hit FROM mat, (SELECT unnest([0.5, 0.75, 0.9, 0.95]::DOUBLE[]) AS t)) GROUP BY threshold""", *_TABLES, more=_PAIRS + "," + CONFIDENCE))
def a11_serving_rollup(spark, sf_dir):
    m = match.confidence_greedy(*_sides(spark, sf_dir))["matches"]
    t = m.select("iou", F.explode(F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95)))).alias("threshold")).withColumn("hit", F.when(F.col("iou") >= F.col("threshold"), F.col("iou")))
    return t.groupBy("threshold").agg(F.count("hit").alias("matched"), _R(F.avg("hit")).alias("mean_iou"), _R(F.median("hit")).alias("median_iou"), _R(F.min("hit")).alias("least_iou"), _R(F.avg(2 * F.col("hit") / (1 + F.col("hit")))).alias("mean_dice"))


@query(with_tables("""SELECT image, n_a = n_b AS same_count, coalesce(delta, 0) <= 1 AND n_a = n_b AS boxes_close, coalesce(delta, 0) AS max_delta FROM (SELECT image, count(*) AS n_a FROM pred_boxes WHERE (pk + sk) % 4 <> 0 OR image % 2 = 0 GROUP BY image) JOIN (SELECT image, count(*) AS n_b FROM gt_boxes GROUP BY image) USING (image)
  LEFT JOIN (SELECT p.image, max(greatest(abs(p.x1 - g.x1), abs(p.y1 - g.y1))) AS delta FROM pred_boxes p JOIN gt_boxes g ON p.image = g.image AND p.det = g.gt GROUP BY p.image) USING (image)""", *_TABLES))
def a12_regression_verdict(spark, sf_dir):
    p, g = fx.pred_boxes(spark, sf_dir), fx.gt_boxes(spark, sf_dir)
    a = p.where("(pk + sk) % 4 <> 0 OR image % 2 = 0").groupBy("image").agg(F.count(F.lit(1)).alias("n_a"))
    b = g.groupBy("image").agg(F.count(F.lit(1)).alias("n_b"))
    pair = p.select("image", "det", "x1", "y1").join(g.select("image", F.col("gt").alias("det"), F.col("x1").alias("a1"), F.col("y1").alias("b1")), ["image", "det"])
    d = pair.groupBy("image").agg(F.max(F.greatest(F.abs(F.col("x1") - F.col("a1")), F.abs(F.col("y1") - F.col("b1")))).alias("delta"))
    out = a.join(b, "image").join(d, "image", "left").na.fill(0, ["delta"])
    return out.select("image", (F.col("n_a") == F.col("n_b")).alias("same_count"), ((F.col("delta") <= 1) & (F.col("n_a") == F.col("n_b"))).alias("boxes_close"), F.col("delta").alias("max_delta"))


@query(with_tables("""SELECT image, n_old, n_new, classes_equal, round(box, 6) AS max_box_delta, round(conf, 6) AS max_conf_delta, coalesce(exact, true) AS mask_equal, coalesce(differing, 0)::BIGINT AS diff_pixels,
    n_old = n_new AND classes_equal AND box <= 1 AND conf <= 0.001 AND coalesce(exact, true) AS passed
  FROM (SELECT coalesce(o.image, n.image) AS image, count(o.det) AS n_old, count(n.det) AS n_new, bool_and(coalesce(o.cls = n.cls, false)) AS classes_equal,
      coalesce(max(greatest(abs(o.x1 - n.x1), abs(o.y1 - n.y1), abs(o.x2 - n.x2), abs(o.y2 - n.y2))), 0)::DOUBLE AS box, coalesce(max(abs(o.conf - n.conf)), 0)::DOUBLE AS conf FROM o FULL JOIN n ON o.image = n.image AND o.det = n.det GROUP BY 1)
  LEFT JOIN (SELECT image, a + b - i = i AS exact, a + b - 2 * i AS differing FROM (SELECT image, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(i, 0) AS i FROM (SELECT image, sum(x2 - x1) AS a FROM o GROUP BY image) FULL JOIN (SELECT image, sum(x2 - x1) AS b FROM n GROUP BY image) USING (image)
    LEFT JOIN (SELECT o.image, sum(greatest(0, least(o.x2, n.x2) - greatest(o.x1, n.x1))) AS i FROM o JOIN n ON o.image = n.image AND o.det = n.det GROUP BY o.image) USING (image))) USING (image)""", "pred_boxes", more="""
  o AS (SELECT image, det, cls, conf / 100 AS conf, x1, y1, x2, y2 FROM pred_boxes WHERE image % 7 <> 5),
  n AS (SELECT image, det, CASE WHEN image % 5 = 1 AND det = 2 THEN 'Z' ELSE cls END AS cls, conf / 100 + CASE WHEN image % 4 = 1 THEN 0.0005 WHEN image % 4 = 2 THEN 0.01 ELSE 0 END AS conf, x1, y1 + CASE WHEN image % 3 = 0 THEN 1 ELSE 0 END AS y1, x2 + CASE WHEN image % 11 = 3 AND det = 1 THEN 2 ELSE 0 END AS x2, y2
    FROM pred_boxes WHERE image % 13 <> 4 AND NOT (image % 17 = 2 AND det = 3))"""))
def a12_regression_five_criteria(spark, sf_dir):
    """Two runs of a model: counts, class lists, box sides, confidences and masks (a run of pixels for each detection)."""
    p = fx.pred_boxes(spark, sf_dir)
    image, det = F.col("image"), F.col("det")
    cols = ["image", "det", "x1", "y1", "x2", "y2"]
    old = p.where("image % 7 <> 5").select(*cols, "cls", (F.col("conf") / 100).alias("conf"))
    drift = F.when(image % 4 == 1, 0.0005).when(image % 4 == 2, 0.01).otherwise(0.0)
    new = p.where("image % 13 <> 4 AND NOT (image % 17 = 2 AND det = 3)").select(
        "image", "det", F.when((image % 5 == 1) & (det == 2), "Z").otherwise(F.col("cls")).alias("cls"), (F.col("conf") / 100 + drift).alias("conf"),
        "x1", (F.col("y1") + F.when(image % 3 == 0, 1).otherwise(0)).alias("y1"), (F.col("x2") + F.when((image % 11 == 3) & (det == 1), 2).otherwise(0)).alias("x2"), "y2",
    )
    runs = lambda df: df.select("image", det.alias("row"), "x1", "x2")
    placed = lambda df: df.withColumnRenamed("det", "pos")
    out = evaluate.regression_verdict(placed(old), placed(new), evaluate.run_overlap(runs(old), runs(new), ["image"]), strip="image")
    return out.withColumns({c: _R(c) for c in ("max_box_delta", "max_conf_delta")})


_RUNS = """
  ra AS (SELECT image, det AS row, x1, x2 FROM pred_boxes), rb AS (SELECT image, gt AS row, x1, x2 FROM gt_boxes),
  sa AS (SELECT image, sum(x2 - x1) AS a FROM ra GROUP BY image), sb AS (SELECT image, sum(x2 - x1) AS b FROM rb GROUP BY image),
  si AS (SELECT ra.image, sum(greatest(0, least(ra.x2, rb.x2) - greatest(ra.x1, rb.x1))) AS i FROM ra JOIN rb ON ra.image = rb.image AND ra.row = rb.row GROUP BY ra.image)"""


@query(with_tables("SELECT image, i AS intersection, a + b - i AS union, a + b - 2 * i AS differing, round(CASE WHEN a + b - i > 0 THEN i / (a + b - i) ELSE 1 END, 6) AS iou, a + b - i = i AS exact FROM (SELECT image, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(i, 0) AS i FROM sa FULL JOIN sb USING (image) LEFT JOIN si USING (image))", *_TABLES, more=_RUNS).replace(" AS union,", ' AS "union",'))
def a13_mask_overlap(spark, sf_dir):
    a = fx.pred_boxes(spark, sf_dir).select("image", F.col("det").alias("row"), "x1", "x2")
    b = fx.gt_boxes(spark, sf_dir).select("image", F.col("gt").alias("row"), "x1", "x2")
    return evaluate.run_overlap(a, b, ["image"]).withColumn("iou", _R("iou"))


@query(with_tables("""SELECT cls, n, round(CASE WHEN n > 0 THEN w / sum(w) OVER () END, 6) AS weight FROM (SELECT cls, n, 1.0 / n AS w FROM (SELECT cls, count(*) AS n FROM gt_boxes GROUP BY cls))""", *_TABLES))
def a17_class_weights(spark, sf_dir):
    n = fx.gt_boxes(spark, sf_dir).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    w = 1.0 / F.greatest(F.col("n"), F.lit(1))
    return n.select("cls", "n", _R(w / F.sum(w).over(Window.partitionBy())).alias("weight"))


@query(with_tables("SELECT image, list_sort(list(conf))[count(*) // 2 + 1] AS upper_median FROM pred_boxes WHERE x2 - x1 >= 24 GROUP BY image", "pred_boxes"))
def a18_upper_median(spark, sf_dir):
    c = fx.pred_boxes(spark, sf_dir).where("x2 - x1 >= 24").groupBy("image").agg(F.sort_array(F.collect_list("conf")).alias("c"))
    return c.select("image", F.element_at("c", (F.floor(F.size("c") / 2) + 1).cast("int")).alias("upper_median"))


_CONFUSION = """
  sh AS (SELECT * FROM pred_boxes WHERE conf > 25),
  cp AS (SELECT *, i / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - i) AS iou FROM (SELECT p.image, p.det, p.cls, p.x1, p.y1, p.x2, p.y2, g.gt, g.cls AS gcls, g.x1 AS a1, g.y1 AS b1, g.x2 AS a2, g.y2 AS b2,
     greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS i FROM sh p JOIN gt_boxes g ON p.image = g.image)),
  cd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, det ORDER BY iou DESC, gt) AS rn FROM cp WHERE iou > 0.45) WHERE rn = 1),
  cm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY iou DESC, det) AS r2 FROM cd) WHERE r2 = 1)"""


@query(with_tables("""SELECT actual, predicted, count(*) AS n FROM (SELECT gcls AS actual, cls AS predicted FROM cm UNION ALL SELECT cls, 'background' FROM gt_boxes g WHERE NOT EXISTS (FROM cm WHERE cm.image = g.image AND cm.gt = g.gt)
  UNION ALL SELECT 'background', cls FROM sh p WHERE NOT EXISTS (FROM cm WHERE cm.image = p.image AND cm.det = p.det) AND image IN (SELECT image FROM cm)) GROUP BY ALL""", *_TABLES, more=_CONFUSION))
def a23_confusion_matrix(spark, sf_dir):
    p, g = _sides(spark, sf_dir)
    return evaluate.confusion(p, g, F.col("conf") > 25)


_CLAIMS = f"""
  clm AS (SELECT image, det, gt, iou FROM (SELECT *, row_number() OVER (PARTITION BY image, cls, gt ORDER BY conf DESC, det) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY image, cls, det ORDER BY iou DESC, gt) AS rn FROM prs) WHERE rn = 1 AND iou > 0.5) WHERE r2 = 1),
  lbl AS (SELECT cls, count(*) AS n FROM gt_boxes GROUP BY cls),
  rk AS (SELECT p.cls, t.threshold, p.conf, p.image, p.det, CASE WHEN c.iou > t.threshold THEN 1 ELSE 0 END AS ok FROM pred_boxes p CROSS JOIN (SELECT {_LEVELS} AS threshold) t LEFT JOIN clm c ON p.image = c.image AND p.det = c.det),
  cu AS (SELECT cls, threshold, sum(ok) OVER w AS tp, count(*) OVER w AS k FROM rk WINDOW w AS (PARTITION BY cls, threshold ORDER BY conf DESC, image, det ROWS UNBOUNDED PRECEDING)),
  en AS (SELECT cu.cls, threshold, k, tp, tp / n AS recall, tp / k AS prec, max(tp / k) OVER (PARTITION BY cu.cls, threshold ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM cu JOIN lbl ON cu.cls = lbl.cls)"""


def _curve(spark, sf_dir, levels=LEVELS):
    p, g = _sides(spark, sf_dir)
    return evaluate.precision_curve(match.claimed(p, g), g, levels, ["cls"], [-F.col("conf"), F.col("image"), F.col("det")])


@query(with_tables("SELECT cls, threshold, round(sum((recall - prev) * env), 6) AS ap FROM (SELECT *, lag(recall, 1, 0) OVER (PARTITION BY cls, threshold ORDER BY k) AS prev FROM en) GROUP BY cls, threshold", *_TABLES, more=_PAIRS + "," + _CLAIMS))
def a24_average_precision(spark, sf_dir):
    return evaluate.average_precision(_curve(spark, sf_dir), ["cls"]).withColumn("ap", _R("ap"))


@query(with_tables("""SELECT cls, max(f1) AS f1, round(arg_max(prec, struct_pack(f := f1, b := -k)), 6) AS precision, round(arg_max(recall, struct_pack(f := f1, b := -k)), 6) AS recall
  FROM (SELECT *, round(CASE WHEN tp > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0 END, 9) AS f1 FROM en WHERE threshold = 0.5) GROUP BY cls""", *_TABLES, more=_PAIRS + "," + _CLAIMS))
def a24_best_f1(spark, sf_dir):
    b = evaluate.best_f1(_curve(spark, sf_dir, LEVELS[:1]), ["cls"])
    return b.select("cls", "f1", _R("precision").alias("precision"), _R("recall").alias("recall"))


_POINTS = """
  al AS (SELECT cls, threshold, k, recall AS r, env AS e FROM en UNION ALL SELECT DISTINCT cls, threshold, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM en UNION ALL SELECT cls, threshold, 1000000000000, max(recall) + 0.01, 0.0::DOUBLE FROM en GROUP BY cls, threshold),
  pt AS (SELECT cls, threshold, r, arg_min(e, k) AS first_e, arg_max(e, k) AS last_e FROM al GROUP BY cls, threshold, r),
  sg AS (SELECT *, lead(r) OVER w AS r2, lead(first_e) OVER w AS e2 FROM pt WINDOW w AS (PARTITION BY cls, threshold ORDER BY r)),
  gp AS (SELECT cls, threshold, x, CASE WHEN r2 IS NULL THEN last_e ELSE last_e + (e2 - last_e) * (x - r) / (r2 - r) END AS y FROM (SELECT k / 100 AS x FROM range(101) z(k)) JOIN sg ON x >= r AND (r2 IS NULL OR x < r2))"""


@query(with_tables("SELECT cls, threshold, round(sum(y * CASE WHEN x IN (0, 1) THEN 0.005 ELSE 0.01 END), 6) AS ap FROM gp GROUP BY cls, threshold", *_TABLES, more=_PAIRS + "," + _CLAIMS + "," + _POINTS))
def a24_average_precision_101(spark, sf_dir):
    return evaluate.average_precision_101(_curve(spark, sf_dir), ["cls"]).withColumn("ap", _R("ap"))


@query(with_tables("SELECT image, det, conf FROM (SELECT image, det, conf, row_number() OVER (PARTITION BY image ORDER BY conf DESC, det) AS rn FROM (SELECT image, z.det AS det, z.conf AS conf FROM (SELECT image, unnest(r.k) AS z FROM kept))) WHERE rn <= 300", "pred_boxes", more="""
  l AS (SELECT image, cls, list({'k': [{'det': det, 'conf': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}]} ORDER BY conf DESC, det) AS l FROM pred_boxes WHERE conf > 10 GROUP BY image, cls),
  kept AS (SELECT image, cls, list_reduce(l, lambda a, x: CASE WHEN list_bool_or(list_transform(a.k, lambda z: greatest(0, least(z.x2, x.k[1].x2) - greatest(z.x1, x.k[1].x1)) * greatest(0, least(z.y2, x.k[1].y2) - greatest(z.y1, x.k[1].y1))
      > 0.45 * ((z.x2 - z.x1) * (z.y2 - z.y1) + (x.k[1].x2 - x.k[1].x1) * (x.k[1].y2 - x.k[1].y1) - greatest(0, least(z.x2, x.k[1].x2) - greatest(z.x1, x.k[1].x1)) * greatest(0, least(z.y2, x.k[1].y2) - greatest(z.y1, x.k[1].y1))))) THEN a ELSE {'k': a.k || x.k} END) AS r FROM l)"""))
def q1_nms(spark, sf_dir):
    return suppress.nms(fx.pred_boxes(spark, sf_dir), 0.45, 10)


def _candidates(spark, sf_dir):
    return text.windows(fx.words(spark, sf_dir), ["image", "line"])


@query(with_tables("""
  SELECT image, line, s::INT AS start, (s + n)::INT AS "end", raw, t AS text, length(t)::INT AS digits FROM (SELECT *, coalesce(nullif(regexp_extract(raw, '(^|[^0-9])([0-9]{10})([^0-9]|$)', 2), ''), nullif(regexp_extract(raw, '(^|[^0-9])([0-9]{6})([^0-9]|$)', 2), ''),
    CASE WHEN NOT regexp_matches(raw, '[A-Za-z/]') THEN (SELECT CASE WHEN length(k) = 11 AND k[2:3] = '10' THEN k[2:11] WHEN length(k) IN (11, 12) AND k[1:2] = '10' THEN k[1:10] WHEN length(k) > 10 AND k[-10:-9] = '10' THEN k[-10:] WHEN length(k) IN (6, 10) THEN k END FROM (SELECT regexp_replace(raw, '[^0-9]', '', 'g') AS k)) END) AS t
  FROM (SELECT a.image, a.line, a.at AS s, n, string_agg(b.text, ' ' ORDER BY b.at) AS raw, count(*) AS c FROM w a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) JOIN w b ON a.image = b.image AND a.line = b.line AND b.at >= a.at AND b.at < a.at + n GROUP BY ALL) WHERE c = n) WHERE t IS NOT NULL""", "words", more="w AS (SELECT *, row_number() OVER (PARTITION BY image, line ORDER BY idx) - 1 AS at FROM words)"))
def q3_candidate_windows(spark, sf_dir):
    return _candidates(spark, sf_dir).select("image", "line", "start", "end", "raw", "text", "digits")


def _read(raw):
    """SQL: the code that a text reads as (S2)."""
    return f"""coalesce(nullif(regexp_extract({raw}, '(^|[^0-9])([0-9]{{10}})([^0-9]|$)', 2), ''), nullif(regexp_extract({raw}, '(^|[^0-9])([0-9]{{6}})([^0-9]|$)', 2), ''),
    CASE WHEN NOT regexp_matches({raw}, '[A-Za-z/]') THEN (SELECT CASE WHEN length(k) = 11 AND k[2:3] = '10' THEN k[2:11] WHEN length(k) IN (11, 12) AND k[1:2] = '10' THEN k[1:10] WHEN length(k) > 10 AND k[-10:-9] = '10' THEN k[-10:] WHEN length(k) IN (6, 10) THEN k END FROM (SELECT regexp_replace({raw}, '[^0-9]', '', 'g') AS k)) END)"""


def _chosen(src, keys):
    """SQL: cand, the windows of 1 to 4 words of ``src`` by ``keys`` that read as a code; kept, those that don't overlap."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY idx) - 1 AS at FROM {src}),
  win AS (SELECT {own}, a.at AS s, z.k, string_agg(b.text, ' ' ORDER BY b.at) AS raw, count(*) AS c, sum(CASE WHEN regexp_matches(b.text, '[0-9]') THEN 0 ELSE 1 END) AS sym, max(b.x2) - min(b.x1) AS width, min(b.x1) AS x1
    FROM n a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) z JOIN n b ON {on} AND b.at >= a.at AND b.at < a.at + z.k GROUP BY {own}, a.at, z.k),
  cand AS (SELECT * FROM (SELECT *, {_read('raw')} AS t FROM win WHERE c = k) WHERE t IS NOT NULL),
  kept AS (SELECT {keys}, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda o: o.s < x[1].e AND x[1].s < o.e)) > 0 THEN a ELSE list_concat(a, x) END)) AS o FROM (
    SELECT {keys}, list([struct_pack(s := s::INT, e := (s + k)::INT, t := t, d := length(t)::INT, x1 := x1)] ORDER BY length(t) DESC, sym, k, width, x1, s, t) AS l FROM cand GROUP BY {keys}))"""


@query(with_tables("""SELECT image, line, o.s AS start, o.e AS "end", o.t AS text, o.d AS digits, o.x1 AS x1 FROM kept""", "words", more=_chosen("words", "image, line")))
def q4_non_overlapping(spark, sf_dir):
    return suppress.non_overlapping(_candidates(spark, sf_dir), ["image", "line"])


@query(with_tables("""SELECT image, line, code AS text, x1 FROM seg WHERE locked UNION ALL SELECT image, line, o.t, o.x1 FROM kept""", "words", more=f"""
  seg AS (SELECT *, sum(locked::INT) OVER (PARTITION BY image, line ORDER BY idx ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, coalesce(length(code) = 10, false) AS locked FROM (SELECT *, {_read('text')} AS code FROM words))),
  fre AS (SELECT * FROM seg WHERE NOT locked), """ + _chosen("fre", "image, line, segment")))
def q5_full_parse(spark, sf_dir):
    """Single words that are whole ten-digit codes first; then windows in the stretches between them; reading order."""
    words = text.free_segments(fx.words(spark, sf_dir), ["image", "line"])
    from gondola.functions import codes

    locked = words.where("locked").select("image", "line", codes.sku_candidate(F.col("text")).alias("text"), "x1", "y1")
    free = words.where("NOT locked")
    rest = suppress.non_overlapping(text.windows(free, ["image", "line", "segment"]), ["image", "line", "segment"])
    return locked.select("image", "line", "text", "x1").unionByName(rest.select("image", "line", "text", "x1"))


@query(with_tables("SELECT image, text, pass, source FROM (SELECT *, row_number() OVER (PARTITION BY image, text ORDER BY d DESC, p, pass) AS rn FROM (SELECT image, text, idx AS pass, CASE sk3 WHEN 0 THEN 'x_rot5' WHEN 1 THEN '' ELSE 'rot180' END AS source, CASE WHEN regexp_full_match(text, '[0-9]+') THEN length(text) ELSE 0 END AS d, CASE sk3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 4 END AS p FROM (SELECT *, (idx * 7) % 3 AS sk3 FROM words))) WHERE rn = 1", "words"))
def q6_best_pass(spark, sf_dir):
    k = (F.col("idx") * 7) % 3
    reads = fx.words(spark, sf_dir).select("image", F.col("idx").alias("pass"), "text", F.when(k == 0, "x_rot5").when(k == 1, "").otherwise("rot180").alias("source"))
    return text.best_pass(reads, ["image"]).select("image", "text", "pass", "source")


@query(with_tables("SELECT image, idx AS pass FROM words w WHERE NOT EXISTS (FROM words v WHERE v.image = w.image AND v.idx < w.idx AND length(v.text) = 10)", "words"))
def q7_until_strong(spark, sf_dir):
    p = fx.words(spark, sf_dir).select("image", F.col("idx").alias("pass"), (F.length("text") == 10).alias("strong"))
    return text.until_strong(p, ["image"]).select("image", "pass")


_VENDOR = "|".join(x.replace(r"\d", "[0-9]").replace(r"\W", "[^A-Za-z0-9_]") for x in codes.VENDOR_SHAPES)
_ITEM = "|".join(x.replace(r"\d", "[0-9]") for x in codes.ITEM_SHAPES)
_BARE = lambda x: f"replace(replace(replace({x}, '-', ''), ' ', ''), 'SKU#', '')"
_LEGACY = f"""
  ln AS (SELECT image, line, string_agg(text, ' ' ORDER BY idx) AS t FROM words GROUP BY image, line),
  vd AS (SELECT image, line, string_split(t, ' ') AS ws, CASE WHEN regexp_full_match(t, '{_VENDOR}') THEN nullif(CASE WHEN length({_BARE('t')}) IN (6, 10) THEN {_BARE('t')} ELSE {_BARE("array_to_string(string_split(t, ' ')[2:], '')")} END, '') END AS v FROM ln),
  wd AS (SELECT image, line, v, i, w, regexp_full_match(w, '{_ITEM}') AS item, regexp_replace(w, '[^0-9]', '', 'g') AS d, regexp_full_match(w, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{1,2}}-[0-9]{{1,2}}-[0-9]{{2,4}}|[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') AS day
    FROM (SELECT image, line, v, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM vd)),
  cn AS (SELECT image, line, 0 AS i, 0 AS j, v AS sku, 'vendor' AS how FROM vd WHERE v IS NOT NULL UNION ALL SELECT image, line, i, 0, d, 'word' FROM wd WHERE item AND d IS DISTINCT FROM v
    UNION ALL SELECT image, line, i, j, sku, 'recovered' FROM (SELECT image, line, v, i, 1 AS j, d AS sku FROM wd WHERE NOT item AND NOT day AND length(d) = 10 AND d[1:2] = '10' UNION ALL SELECT image, line, v, i, 2, d[2:11] FROM wd WHERE NOT item AND NOT day AND length(d) = 11 AND d[2:3] = '10'
      UNION ALL SELECT image, line, v, i, 3, d[1:10] FROM wd WHERE NOT item AND NOT day AND length(d) IN (11, 12) AND d[1:2] = '10' UNION ALL SELECT image, line, v, i, 4, d[-10:] FROM wd WHERE NOT item AND NOT day AND length(d) > 10 AND d[-10:-9] = '10' AND NOT (length(d) = 11 AND d[2:3] = '10')) WHERE sku IS DISTINCT FROM v)"""


@query(with_tables("SELECT image, line, (row_number() OVER (PARTITION BY image, line ORDER BY i, j) - 1)::INT AS pos, sku, how FROM cn", "words", more=_LEGACY))
def q8_legacy_codes(spark, sf_dir):
    w = fx.words(spark, sf_dir).groupBy("image", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))
    return text.legacy_codes(w)


@query(with_tables("""SELECT image, idx, (sum(CASE WHEN before <> line THEN 1 ELSE 0 END) OVER (PARTITION BY image ORDER BY idx, line, text ROWS UNBOUNDED PRECEDING))::INT AS "group" FROM (SELECT *, lag(line) OVER (PARTITION BY image ORDER BY idx, line, text) AS before FROM words)""", "words"))
def q2_line_groups(spark, sf_dir):
    w = fx.words(spark, sf_dir).groupBy("image").agg(F.array_sort(F.collect_list(F.struct("idx", "line", "text"))).alias("w"))
    joined = F.aggregate("w", F.struct(F.lit("").alias("t"), F.lit(0).cast("bigint").alias("l")), lambda a, x: F.struct(F.concat(a["t"], F.when(a["t"] == "", "").when(x["line"] == a["l"], " ").otherwise("\n"), x["text"]).alias("t"), x["line"].alias("l")), lambda a: a["t"])
    # the text is a column first: inside the fold over words, its own fold would run again for every word
    w = w.withColumn("joined", joined)
    lines = text.lines_of(F.col("joined"), F.transform("w", lambda x: x["text"]))
    z = w.select("image", F.posexplode(F.arrays_zip(F.col("w").alias("w"), lines.alias("g"))).alias("i", "z"))
    return z.select("image", F.col("z.w.idx").alias("idx"), F.col("z.g").alias("group"))
