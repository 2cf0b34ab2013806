"""Temporal, review, queue, set and limit operators over the fixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gondola.functions import codes
from gondola.operators import evaluate, review
from gondola.plans import fixtures as fx
from gondola.plans.fixtures import with_tables
from gondola.plans.registry import query

_SLOTS = """
  io AS (SELECT bay, image, row_number() OVER (PARTITION BY bay ORDER BY image) - 1 AS idx, count(*) OVER (PARTITION BY bay) AS n FROM (SELECT DISTINCT bay, image FROM captures)),
  gr AS (SELECT io.*, s.slot, CASE WHEN c.slot IS NULL THEN 0 ELSE 1 END AS seen FROM io JOIN (SELECT DISTINCT bay, slot FROM captures) s ON io.bay = s.bay LEFT JOIN captures c ON c.bay = io.bay AND c.image = io.image AND c.slot = s.slot),
  pr AS (SELECT *, CASE WHEN idx > 0 THEN coalesce(prior, 0) / idx >= 0.34 ELSE total >= 2 AND total / n >= 0.34 END AS predicted FROM (SELECT *, sum(seen) OVER (PARTITION BY bay, slot ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, sum(seen) OVER (PARTITION BY bay, slot) AS total FROM gr)),
  im AS (SELECT bay, image, sum(CASE WHEN seen = 1 AND predicted THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN seen = 0 AND predicted THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN seen = 1 AND NOT predicted THEN 1 ELSE 0 END) AS fn FROM pr GROUP BY bay, image)"""


@query(with_tables("SELECT bay, image, idx, slot, seen, predicted FROM pr", "captures", more=_SLOTS))
def w4_w5_slot_persistence(spark, sf_dir):
    return review.slot_predictions(fx.captures(spark, sf_dir)).select("bay", "image", "idx", "slot", "seen", "predicted")


@query(with_tables("""SELECT bay, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1, mae AS count_mae, coalesce(chronic, 0) AS chronic
  FROM (SELECT bay, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, round(avg(abs(fp - fn)), 4) AS mae FROM im GROUP BY bay) LEFT JOIN (SELECT bay, count(*) AS chronic FROM (SELECT bay, slot FROM captures GROUP BY bay, slot HAVING count(DISTINCT image) >= 2) GROUP BY bay) USING (bay)""", "captures", more=_SLOTS))
def a19_slot_metrics(spark, sf_dir):
    return review.slot_metrics(fx.captures(spark, sf_dir))


@query(with_tables("SELECT bay, slot, count(DISTINCT image) AS n, round(count(DISTINCT image) / max(t), 6) AS share FROM captures JOIN (SELECT bay, count(DISTINCT image) AS t FROM captures GROUP BY bay) USING (bay) GROUP BY bay, slot", "captures"))
def a26_slot_recurrence(spark, sf_dir):
    c = fx.captures(spark, sf_dir)
    t = c.groupBy("bay").agg(F.count_distinct("image").alias("t"))
    return c.join(t, "bay").groupBy("bay", "slot").agg(F.count_distinct("image").alias("n"), F.round(F.count_distinct("image") / F.max("t"), 6).alias("share"))


_VERDICT = "CASE (bay + slot) % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'unsure' WHEN 2 THEN '' ELSE 'yes' END"


@query(with_tables(f"""SELECT level, name, total, yes, "no", unsure, remaining, round(CASE WHEN yes + "no" > 0 THEN yes / (yes + "no") ELSE 0 END, 6) AS precision FROM (
  SELECT CASE WHEN grouping(image) = 1 AND grouping(slot) = 1 THEN 'all' WHEN grouping(image) = 0 THEN 'image' ELSE 'slot' END AS level, coalesce(image, slot::VARCHAR, '') AS name, count(*) AS total, count(*) FILTER (WHERE v = 'yes') AS yes, count(*) FILTER (WHERE v = 'no') AS "no", count(*) FILTER (WHERE v = 'unsure') AS unsure, count(*) FILTER (WHERE v = '') AS remaining
  FROM (SELECT *, {_VERDICT} AS v FROM captures) GROUP BY GROUPING SETS ((), (image), (slot)))""", "captures"))
def a20_detector_audit(spark, sf_dir):
    k = (F.col("bay") + F.col("slot")) % 5
    v = F.when(k == 0, "no").when(k == 1, "unsure").when(k == 2, "").otherwise("yes")
    return review.audit(fx.captures(spark, sf_dir).withColumn("verdict", v))


_REVIEW = """
  rv AS (SELECT *, CASE WHEN status IS NULL THEN '' WHEN status = 'not applicable' THEN 'unreadable' ELSE status END AS canon, lpad((row % 1000000)::VARCHAR, 6, '0') AS expected FROM review)"""


def _reviews(spark, sf_dir):
    r = fx.review(spark, sf_dir)
    return r.withColumns({"canon": codes.review_status(F.col("status"), F.lit(""), F.lit("")), "expected": F.lpad((F.col("row") % 1_000_000).cast("string"), 6, "0")})


@query(with_tables("""SELECT image, count(*) AS total, sum(CASE WHEN canon <> '' THEN 1 ELSE 0 END) AS reviewed, sum(CASE WHEN canon = 'scorable' THEN 1 ELSE 0 END) AS scorable, sum(CASE WHEN canon = 'scorable' AND row % 3 <> 0 THEN 1 ELSE 0 END) AS correct, sum(CASE WHEN canon NOT IN ('', 'scorable') THEN 1 ELSE 0 END) AS non_scorable,
  round(CASE WHEN sum(CASE WHEN canon = 'scorable' THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN canon = 'scorable' AND row % 3 <> 0 THEN 1 ELSE 0 END) / sum(CASE WHEN canon = 'scorable' THEN 1 ELSE 0 END) ELSE 0 END, 6) AS accuracy FROM rv GROUP BY image""", "review", more=_REVIEW))
def a9_a10_review_progress(spark, sf_dir):
    r = _reviews(spark, sf_dir).select("image", F.col("canon").alias("status"), "expected", F.when(F.col("row") % 3 == 0, "0").otherwise(F.col("expected")).alias("predicted"), F.when(F.col("row") % 3 == 0, "1").otherwise(F.col("expected")).alias("hint"), (F.col("row") % 2 == 0).alias("has_prediction"))
    return review.progress(r, ["image"])


@query(with_tables("""SELECT row FROM review WHERE image IN ('src1', 'src2', 'src3') AND status IS NULL AND row IN (SELECT doc_id FROM documents WHERE lang = 'en')""", "review"))
def fl7_annotation_filter(spark, sf_dir):
    batch = fx.read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("row"))
    return fx.review(spark, sf_dir).where(F.col("image").isin("src1", "src2", "src3") & F.col("status").isNull()).join(batch, "row", "left_semi").select("row")


_BALANCE = """
  ri AS (SELECT image || '-' || (row // 5)::VARCHAR AS image, row, lower(trim(reviewer)) AS who, canon <> '' AS done FROM rv),
  sz AS (SELECT image, count(*) AS n FROM ri GROUP BY image),
  mo AS (SELECT image, who FROM (SELECT image, who, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, min(row), who) AS rn FROM ri WHERE done AND who <> '' GROUP BY image, who) WHERE rn = 1),
  pn AS (SELECT image, CASE who WHEN 'fr' THEN 'FR' ELSE who END AS owner FROM mo WHERE who IN ('en', 'de', 'fr')),
  ld AS (SELECT coalesce(sum(CASE WHEN owner = 'de' THEN n END), 0)::BIGINT AS de, coalesce(sum(CASE WHEN owner = 'en' THEN n END), 0)::BIGINT AS en, coalesce(sum(CASE WHEN owner = 'FR' THEN n END), 0)::BIGINT AS fr FROM pn JOIN sz USING (image)),
  td AS (SELECT list_prepend({'de': (SELECT de FROM ld), 'en': (SELECT en FROM ld), 'fr': (SELECT fr FROM ld), 'n': 0::BIGINT, 'o': [{'image': '', 'owner': ''}]},
    list({'de': 0::BIGINT, 'en': 0::BIGINT, 'fr': 0::BIGINT, 'n': n::BIGINT, 'o': [{'image': image, 'owner': ''}]} ORDER BY n DESC, image)) AS l FROM sz WHERE image NOT IN (SELECT image FROM pn)),
  dl AS (SELECT unnest(list_reduce(l, lambda a, x: CASE WHEN a.de <= a.en AND a.de <= a.fr THEN {'de': a.de + x.n, 'en': a.en, 'fr': a.fr, 'n': 0::BIGINT, 'o': list_append(a.o, {'image': x.o[1].image, 'owner': 'de'})}
    WHEN a.en <= a.fr THEN {'de': a.de, 'en': a.en + x.n, 'fr': a.fr, 'n': 0::BIGINT, 'o': list_append(a.o, {'image': x.o[1].image, 'owner': 'en'})} ELSE {'de': a.de, 'en': a.en, 'fr': a.fr + x.n, 'n': 0::BIGINT, 'o': list_append(a.o, {'image': x.o[1].image, 'owner': 'FR'})} END).o) AS z FROM td)"""


@query(with_tables("SELECT image, owner FROM pn UNION ALL SELECT z.image, z.owner FROM dl WHERE z.image <> ''", "review", more=_REVIEW + "," + _BALANCE))
def p1_p2_reviewer_balance(spark, sf_dir):
    """Members en, de and FR; es was removed, so that its images return to the pool."""
    members = spark.createDataFrame([("en", 0), ("de", 0), ("FR", 0)], "member string, pool int")
    r = _reviews(spark, sf_dir).select("image", "row", "reviewer", (F.col("canon") != "").alias("reviewed"))
    return review.balance(r.withColumn("image", F.concat_ws("-", "image", F.expr("row div 5"))), members)


@query(with_tables("""SELECT image, row, n AS next_in_image, coalesce(n, f) AS next_wrapped, coalesce(n, nf) AS next_row FROM (SELECT image, row, lead(row) OVER (PARTITION BY image ORDER BY row) AS n, min(row) OVER (PARTITION BY image) AS f FROM review)
  JOIN (SELECT image, lead(f) OVER (ORDER BY image) AS nf FROM (SELECT image, min(row) AS f FROM review GROUP BY image)) USING (image)""", "review"))
def w9_next_after_save(spark, sf_dir):
    return review.next_after_save(fx.review(spark, sf_dir).select("image", "row"))


_FOLD = """
  fo AS (SELECT image, list_reduce(list_prepend({'status': 'unassigned', 'user': NULL::VARCHAR, 'label': NULL::VARCHAR, 'by': NULL::VARCHAR, 'at': NULL::TIMESTAMP, 'labels': 0, 'a': ''}, list({'status': '', 'user': user::VARCHAR, 'label': 'L' || event_id, 'by': NULL::VARCHAR, 'at': ts::TIMESTAMP, 'labels': 0, 'a': action} ORDER BY ts, event_id)),
    lambda a, x: CASE WHEN x.a = 'assign' AND a.status = 'unassigned' THEN {'status': 'assigned', 'user': x.user, 'label': a.label, 'by': a.by, 'at': x.at, 'labels': a.labels, 'a': ''}
      WHEN x.a = 'label' AND a.status = 'assigned' AND a.user = x.user THEN {'status': 'done', 'user': NULL::VARCHAR, 'label': x.label, 'by': x.user, 'at': x.at, 'labels': a.labels + 1, 'a': ''}
      WHEN x.a = 'relabel' AND a.status = 'done' AND a.by = x.user THEN {'status': 'done', 'user': NULL::VARCHAR, 'label': x.label, 'by': x.user, 'at': x.at, 'labels': a.labels + 1, 'a': ''}
      WHEN x.a = 'skip' AND ((a.status = 'assigned' AND a.user = x.user) OR (a.status = 'done' AND a.by = x.user)) THEN {'status': 'skipped', 'user': NULL::VARCHAR, 'label': a.label, 'by': a.by, 'at': x.at, 'labels': a.labels, 'a': ''}
      WHEN x.a = 'recycle' AND a.status = 'skipped' THEN {'status': 'unassigned', 'user': NULL::VARCHAR, 'label': a.label, 'by': a.by, 'at': x.at, 'labels': a.labels, 'a': ''} ELSE a END) AS s FROM qe GROUP BY image),
  st AS (SELECT image, s.status AS status, s.user AS "user", s.label AS label, s.by AS "by", s.at AS "at", s.labels AS labels FROM fo)"""
#: A user for every seven, so that holders and actors meet.
_QE = "qe AS (SELECT * REPLACE (user % 7 AS user) FROM queue_events)"


def _queue(spark, sf_dir):
    return review.fold_queue(fx.queue_events(spark, sf_dir).withColumn("user", F.col("user") % 7))


@query(with_tables('SELECT image, status, "user", label, "by", labels FROM st', "queue_events", more=_QE + "," + _FOLD))
def t5_queue_state(spark, sf_dir):
    return _queue(spark, sf_dir).select("image", "status", "user", "label", "by", "labels")


@query(with_tables("SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'assigned' AND st.\"at\" < (SELECT max(ts) FROM queue_events) - INTERVAL 20 MINUTE THEN 'unassigned' ELSE status END AS status FROM st) GROUP BY status", "queue_events", more=_QE + "," + _FOLD))
def t4_a15_stale_release(spark, sf_dir):
    now = fx.queue_events(spark, sf_dir).agg(F.max("ts").alias("now"))
    released = review.release_stale(_queue(spark, sf_dir).join(now, F.lit(True)), F.col("now"))
    return released.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables('SELECT "by", image, row_number() OVER (PARTITION BY "by" ORDER BY "at", image) AS nth FROM st WHERE status = \'done\'', "queue_events", more=_QE + "," + _FOLD))
def w10_reviewer_history(spark, sf_dir):
    return _queue(spark, sf_dir).where("status = 'done'").select("by", "image", F.row_number().over(Window.partitionBy("by").orderBy("at", "image")).alias("nth"))


@query(with_tables("""SELECT u."user", coalesce(h.image, f.image) AS image, h.image IS NOT NULL AS resumed FROM (SELECT DISTINCT user::VARCHAR AS "user" FROM qe) u LEFT JOIN (SELECT "user", min(image) AS image FROM st WHERE status = 'assigned' GROUP BY "user") h ON h."user" = u."user" CROSS JOIN (SELECT min(image) AS image FROM st WHERE status = 'unassigned') f""", "queue_events", more=_QE + "," + _FOLD))
def l5_queue_heads(spark, sf_dir):
    users = fx.queue_events(spark, sf_dir).select((F.col("user") % 7).cast("string").alias("user")).distinct()
    return review.queue_heads(_queue(spark, sf_dir), users)


@query(with_tables("SELECT image, count(*) AS score FROM pred_boxes WHERE conf < 40 GROUP BY image ORDER BY score DESC, image LIMIT 20", "pred_boxes"))
def l1_worst_images(spark, sf_dir):
    return fx.pred_boxes(spark, sf_dir).where("conf < 40").groupBy("image").agg(F.count(F.lit(1)).alias("score")).orderBy(F.col("score").desc(), "image").limit(20)


@query(with_tables("SELECT cls, image, det, conf FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY conf, image, det) AS rn, count(*) OVER (PARTITION BY cls) AS n FROM pred_boxes) WHERE rn IN (1, n // 2 + 1, n)", "pred_boxes"))
def l2_worst_median_best(spark, sf_dir):
    rows = fx.pred_boxes(spark, sf_dir).select("cls", "image", "det", "conf")
    return evaluate.ordinal_rows(rows, ["cls"], ["conf", "image", "det"])


@query(with_tables("SELECT image, det FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, det) AS rn FROM pred_boxes) WHERE rn <= 10", "pred_boxes"))
def l4_image_limit(spark, sf_dir):
    return fx.pred_boxes(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("image").orderBy(F.col("conf").desc(), "det"))).where("rn <= 10").select("image", "det")


@query(with_tables("SELECT image FROM pred_boxes WHERE image % 3 = 0 UNION SELECT image FROM gt_boxes WHERE image % 2 = 0", "pred_boxes", "gt_boxes"))
def u1_image_union(spark, sf_dir):
    return fx.pred_boxes(spark, sf_dir).where("image % 3 = 0").select("image").unionByName(fx.gt_boxes(spark, sf_dir).where("image % 2 = 0").select("image")).distinct()


@query(with_tables("SELECT bay, slot, 'both' AS side FROM (SELECT bay, slot FROM captures WHERE image < '2024-01-15' INTERSECT SELECT bay, slot FROM captures WHERE image >= '2024-01-15') UNION ALL SELECT bay, slot, 'gone' FROM (SELECT bay, slot FROM captures WHERE image < '2024-01-15' EXCEPT SELECT bay, slot FROM captures WHERE image >= '2024-01-15')", "captures"))
def u2_slot_sets(spark, sf_dir):
    c = fx.captures(spark, sf_dir)
    a, b = c.where("image < '2024-01-15'").select("bay", "slot"), c.where("image >= '2024-01-15'").select("bay", "slot")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("gone")))


@query(with_tables("SELECT image, det, CASE WHEN cls IN ('A', 'N') THEN 'EMPTY' ELSE cls END AS cls FROM pred_boxes UNION ALL SELECT image, -gt, 'EMPTY' FROM gt_boxes WHERE cls = 'R'", "pred_boxes", "gt_boxes"))
def u4_class_folding(spark, sf_dir):
    p = fx.pred_boxes(spark, sf_dir).select("image", "det", F.when(F.col("cls").isin("A", "N"), "EMPTY").otherwise(F.col("cls")).alias("cls"))
    return p.unionByName(fx.gt_boxes(spark, sf_dir).where("cls = 'R'").select("image", (-F.col("gt")).alias("det"), F.lit("EMPTY").alias("cls")))


@query("SELECT d.doc_id, 'unassigned' AS status FROM documents d WHERE NOT EXISTS (FROM labels l WHERE l.doc_id = d.doc_id)")
def u3_u5_new_rows(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id").join(fx.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").withColumn("status", F.lit("unassigned"))


@query("SELECT doc_id, CASE WHEN b < 90 THEN 'train' WHEN b < 98 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT d.doc_id, ('0x' || md5(d.doc_id::VARCHAR)[1:8])::BIGINT % 100 AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
def p3_dataset_split(spark, sf_dir):
    """90 / 8 / 2 by hash of the id, labelled rows only: the same rows fall in the same part in every run."""
    d = fx.read(spark, sf_dir, "documents").select("doc_id").join(fx.read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").distinct()
    b = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 100
    return d.select("doc_id", F.when(b < 90, "train").when(b < 98, "val").otherwise("test").alias("split"))


@query(with_tables("SELECT image, det FROM pred_boxes WHERE conf >= 25 AND cls NOT IN ('N')", "pred_boxes"))
def fl1_fl2_detection_filter(spark, sf_dir):
    return fx.pred_boxes(spark, sf_dir).where((F.col("conf") >= 25) & ~F.col("cls").isin("N")).select("image", "det")


@query(with_tables("SELECT image, det FROM pred_boxes WHERE (x2 - x1) * (y2 - y1) >= 700 AND (x2 - x1) * (y2 - y1) >= 0.035 * 220 * 90", "pred_boxes"))
def fl3_mask_presence(spark, sf_dir):
    n = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return fx.pred_boxes(spark, sf_dir).where((n >= 700) & (n >= 0.035 * 220 * 90)).select("image", "det")


_BEAMS = """
  be AS (SELECT image, list({'x': (x1 + x2) / 2, 'a': x1, 'b': y1, 'c': x2, 'd': y2} ORDER BY (x1 + x2) / 2, det) AS l FROM pred_boxes WHERE det <= image % 4 GROUP BY image),
  po AS (SELECT image, ['left-center', 'left-before', 'right-before', 'left-after', 'right-after', 'other'][image % 6 + 1] AS position FROM (SELECT DISTINCT image FROM pred_boxes)),
  sk AS (SELECT p.image, p.det, p.x1, p.x2, (p.x1 + p.x2) / 2 AS cx, (p.y1 + p.y2) / 2 AS cy, position, l, len(l) AS n, l[1].x > 110 AS up FROM pred_boxes p JOIN po USING (image) LEFT JOIN be USING (image)),
  sd AS (SELECT *, (x2 < l[1].a) OR CASE WHEN cx < l[1].a THEN true WHEN cx > l[1].c THEN false ELSE cx < l[1].a + (l[1].d - cy) / (l[1].d - l[1].b) * (l[1].c - l[1].a) END AS left1,
      (x1 > l[2].c) OR NOT CASE WHEN cx < l[2].a THEN true WHEN cx > l[2].c THEN false ELSE cx < l[2].c - (l[2].d - cy) / (l[2].d - l[2].b) * (l[2].c - l[2].a) END AS right2,
      CASE WHEN cx < l[1].a THEN true WHEN cx > l[1].c THEN false WHEN up THEN cx < l[1].c - (l[1].d - cy) / (l[1].d - l[1].b) * (l[1].c - l[1].a) ELSE cx < l[1].a + (l[1].d - cy) / (l[1].d - l[1].b) * (l[1].c - l[1].a) END AS lf FROM sk)"""


@query(with_tables("""SELECT image, det FROM sd WHERE CASE WHEN position = 'left-center' AND n = 2 THEN NOT left1 AND NOT right2 WHEN position IN ('left-before', 'right-after') AND n = 1 THEN NOT (x2 < l[1].a OR lf) WHEN position IN ('right-before', 'left-after') AND n = 1 THEN NOT (x1 > l[1].c OR NOT lf) ELSE true END""", "pred_boxes", more=_BEAMS))
def fl4_fl6_beam_filters(spark, sf_dir):
    from gondola.operators.beams import filter_frames

    p = fx.pred_boxes(spark, sf_dir)
    positions = F.array(*map(F.lit, ("left-center", "left-before", "right-before", "left-after", "right-after", "other")))
    meta = p.select("image").distinct().select("image", F.element_at(positions, (F.col("image") % 6 + 1).cast("int")).alias("position"), F.lit(220).alias("width"))
    beams = p.where("det <= image % 4").select("image", "det", "x1", "y1", "x2", "y2")
    return filter_frames(p.select("image", "det", "x1", "y1", "x2", "y2"), beams, meta).select("image", "det")


@query(with_tables("SELECT image, gt FROM gt_boxes WHERE cls IN ('A', 'R') AND x2 > x1 AND y2 > y1", "gt_boxes"))
def fl8_object_truth(spark, sf_dir):
    return fx.gt_boxes(spark, sf_dir).where(F.col("cls").isin("A", "R") & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).select("image", "gt")


@query(with_tables("""SELECT image, count(*) AS labels, sum(CASE WHEN x1 < 0 OR y1 < 0 THEN 1 ELSE 0 END) AS negative, sum(CASE WHEN x2 > 200 THEN 1 ELSE 0 END) AS beyond, count(*) - count(DISTINCT (cls, x1, y1, x2, y2)) AS repeated FROM gt_boxes GROUP BY image""", "gt_boxes"))
def fl9_a16_label_quality(spark, sf_dir):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return fx.gt_boxes(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).alias("labels"), n((F.col("x1") < 0) | (F.col("y1") < 0)).alias("negative"), n(F.col("x2") > 200).alias("beyond"), (F.count(F.lit(1)) - F.count_distinct("cls", "x1", "y1", "x2", "y2")).alias("repeated"))


@query("""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'url' WHEN contains(url, 'blog') THEN 'archive' ELSE 'unresolved' END AS plan FROM pages WHERE NOT starts_with(url, 'ftp')""")
def fl10_restore_plan(spark, sf_dir):
    u = F.col("url")
    return fx.read(spark, sf_dir, "pages").where(~F.startswith(u, F.lit("ftp"))).select("page_id", F.when(F.startswith(u, F.lit("https://")), "url").when(F.contains(u, F.lit("blog")), "archive").otherwise("unresolved").alias("plan"))


@query(with_tables("SELECT image, sk % 18 AS class_id, string_agg(det::VARCHAR, ',' ORDER BY det) AS dets, string_agg(conf::VARCHAR, ',' ORDER BY det) AS confs FROM pred_boxes WHERE sk % 18 BETWEEN 0 AND 14 GROUP BY image, sk % 18", "pred_boxes"))
def fl11_class_partition(spark, sf_dir):
    g = fx.pred_boxes(spark, sf_dir).withColumn("class_id", F.col("sk") % 18).where("class_id BETWEEN 0 AND 14").groupBy("image", "class_id").agg(F.array_sort(F.collect_list(F.struct("det", "conf"))).alias("b"))
    text = lambda c: F.array_join(F.transform("b", lambda x: x[c].cast("string")), ",")
    return g.select("image", "class_id", text("det").alias("dets"), text("conf").alias("confs"))


@query("SELECT count(*) AS n, count(DISTINCT url) AS n_urls, sum(length(html)) AS n_chars FROM pages")
def a14_manifest_summary(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("n_urls"), F.sum(F.length("html")).alias("n_chars"))


@query(with_tables("""SELECT split, cls, count(*) AS instances, count(DISTINCT image) AS images FROM (SELECT *, CASE WHEN image % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM gt_boxes) GROUP BY split, cls""", "gt_boxes"))
def a27_dataset_statistics(spark, sf_dir):
    g = fx.gt_boxes(spark, sf_dir).withColumn("split", F.when(F.col("image") % 10 == 0, "val").otherwise("train"))
    return g.groupBy("split", "cls").agg(F.count(F.lit(1)).alias("instances"), F.count_distinct("image").alias("images"))


@query()
def a25_anchor_fit(spark, sf_dir):
    """k-means anchors on width and height; for each anchor the boxes nearest to it, and the share whose sides fit within 4."""
    from gondola.operators.anchors import fit_anchors

    return fit_anchors(fx.gt_boxes(spark, sf_dir), 5)
