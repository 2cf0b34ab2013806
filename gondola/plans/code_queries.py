"""Codes, keys and prices over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.functions import codes
from gondola.functions.boxes import Box
from gondola.plans import fixtures as fx
from gondola.plans.fixtures import with_tables
from gondola.plans.registry import query

# texts of many shapes from the parts' keys: 0 ten digits, 1 six, 2 spaced, 3 prefixed eleven, 4 twelve, 5 noisy, 6 a date, 7 dashed, 8 SKU:, 9 with X, 10 blank, 11 N/A
_SHAPES_SQL = """
  shapes AS (SELECT p_partkey AS pk, CASE p_partkey % 12
      WHEN 0 THEN '10' || lpad((p_partkey * 7919 % 100000000)::VARCHAR, 8, '0') WHEN 1 THEN lpad((p_partkey * 31 % 1000000)::VARCHAR, 6, '0') WHEN 2 THEN '$1004 ' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '-515:'
      WHEN 3 THEN '110' || lpad((p_partkey * 13 % 100000000)::VARCHAR, 8, '0') WHEN 4 THEN '10' || lpad((p_partkey * 17 % 10000000000)::VARCHAR, 10, '0') WHEN 5 THEN '-338 10' || lpad((p_partkey * 5 % 100000000)::VARCHAR, 8, '0')
      WHEN 6 THEN '02/' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || '/26' WHEN 7 THEN lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((p_partkey % 997)::VARCHAR, 3, '0') WHEN 8 THEN 'SKU:' || lpad((p_partkey % 1000000)::VARCHAR, 6, '0')
      WHEN 9 THEN 'x' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') WHEN 10 THEN ' ' ELSE 'n/a' END AS t FROM part)"""
_DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"


def _shapes(spark, sf_dir):
    k = F.col("p_partkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    texts = (
        F.concat(F.lit("10"), pad(k * 7919 % 100_000_000, 8)), pad(k * 31 % 1_000_000, 6), F.concat(F.lit("$1004 "), pad(k % 1000, 3), F.lit("-515:")),
        F.concat(F.lit("110"), pad(k * 13 % 100_000_000, 8)), F.concat(F.lit("10"), pad(k * 17 % 10_000_000_000, 10)), F.concat(F.lit("-338 10"), pad(k * 5 % 100_000_000, 8)),
        F.concat(F.lit("02/"), pad(k % 28 + 1, 2), F.lit("/26")), F.concat_ws("-", pad(k % 1000, 3), pad(k % 997, 3)), F.concat(F.lit("SKU:"), pad(k % 1_000_000, 6)),
        F.concat(F.lit("x"), pad(k % 100_000, 5)), F.lit(" "), F.lit("n/a"),
    )
    t = F.element_at(F.array(*texts), (k % 12 + 1).cast("int"))
    return fx.read(spark, sf_dir, "part").select(k.alias("pk"), t.alias("t"))


@query(f"""WITH {_SHAPES_SQL}, c AS (SELECT *, {_DIGITS} AS d, regexp_replace(regexp_replace(t, '^[^0-9]+', ''), '[^0-9]+$', '') AS core FROM shapes),
  e AS (SELECT *, CASE WHEN NOT regexp_matches(t, '[A-Za-z]') AND regexp_full_match(core, '[0-9\\s-]+') THEN regexp_replace(core, '[\\s-]+', '', 'g') END AS k FROM c)
  SELECT pk, d AS digits, CASE length(d) WHEN 10 THEN d WHEN 6 THEN '0000' || d END AS published,
    coalesce(nullif(regexp_extract(t, '(^|[^0-9])([0-9]{{10}})([^0-9]|$)', 2), ''), nullif(regexp_extract(t, '(^|[^0-9])([0-9]{{6}})([^0-9]|$)', 2), ''),
      CASE WHEN length(k) = 11 AND substr(k, 2, 2) = '10' THEN substr(k, 2, 10) WHEN length(k) IN (11, 12) AND k[1:2] = '10' THEN k[1:10] WHEN length(k) > 10 AND k[-10:-9] = '10' THEN k[-10:] WHEN length(k) IN (6, 10) THEN k END) AS candidate
  FROM e""")
def s1_s3_sku_normalisers(spark, sf_dir):
    t = F.col("t")
    return _shapes(spark, sf_dir).select("pk", codes.digits(t).alias("digits"), codes.published_sku(t).alias("published"), codes.sku_candidate(t).alias("candidate"))


@query(f"""WITH {_SHAPES_SQL}, k AS (SELECT *, regexp_replace(t, '[\\s._/-]', '', 'g') AS r, upper(trim(t)) IN ('N/A', 'NA', 'N-A', 'X') AS na FROM shapes),
  v AS (SELECT *, CASE WHEN regexp_full_match(r, '[0-9Xx]+') THEN upper(r) ELSE '' END AS token FROM k), w AS (SELECT *, length(token) IN (6, 10) AS ok FROM v)
  SELECT pk, token, ok AS valid, CASE WHEN na THEN 'not-visible' WHEN length(token) = 6 THEN '6-digit' WHEN length(token) = 10 THEN '10-digit' ELSE '' END AS digit_class,
    CASE WHEN na THEN 'non-scorable' WHEN ok THEN 'scorable' ELSE '' END AS scorability,
    CASE WHEN trim(t) = '' THEN NULL WHEN na THEN CASE WHEN upper(trim(t)) = 'X' THEN 'X' ELSE 'N/A' END WHEN ok THEN token END AS value,
    CASE WHEN trim(t) = '' THEN 1 WHEN na OR ok THEN 0 ELSE 2 END AS error,
    CASE WHEN trim(t) = '' OR na THEN t ELSE {_DIGITS} END AS cleaned
  FROM w""")
def s4_s6_review_tokens(spark, sf_dir):
    t = F.col("t")
    typed = codes.expected_input(t)
    error = F.when(typed["error"] == codes.REQUIRED, 1).when(typed["error"] == codes.WRONG_LENGTH, 2).otherwise(0)
    return _shapes(spark, sf_dir).select(
        "pk", codes.token(t).alias("token"), codes.valid_token(t).alias("valid"), codes.digit_class(t).alias("digit_class"), codes.scorability(t).alias("scorability"),
        typed["value"].alias("value"), error.alias("error"), codes.clean_expected(t).alias("cleaned"),
    )


_STATUS = """
  s AS (SELECT *, CASE pk % 5 WHEN 0 THEN 'Reviewed' WHEN 1 THEN 'motion blur' WHEN 2 THEN 'Not Applicable' WHEN 3 THEN '' ELSE 'scorable' END AS status,
    CASE pk % 7 WHEN 0 THEN 'heavy Blur' WHEN 1 THEN 'glare, cropped' WHEN 2 THEN 'low res' WHEN 3 THEN 'uncertain' WHEN 4 THEN 'damage' ELSE '' END AS notes FROM shapes),
  n AS (SELECT *, replace(lower(trim(status)), ' ', '_') AS st, upper(trim(t)) IN ('N/A', 'NA', 'N-A', 'X') AS na, regexp_replace(t, '[\\s._/-]', '', 'g') AS r FROM s),
  r AS (SELECT *, CASE WHEN st IN ('scorable', 'reviewed') THEN 'scorable' WHEN st = 'motion_blur' THEN st
     WHEN st = 'not_applicable' OR na THEN CASE WHEN contains(lower(notes), 'blur') THEN 'motion_blur' WHEN contains(notes, 'glare') THEN 'glare' WHEN contains(notes, 'low res') THEN 'resolution_too_low' WHEN contains(notes, 'damage') THEN 'damaged_label' WHEN contains(notes, 'uncertain') THEN 'ambiguous' ELSE 'unreadable' END
     WHEN regexp_full_match(r, '[0-9Xx]+') AND length(r) IN (6, 10) THEN 'scorable' ELSE '' END AS canon FROM n)"""


@query(f"WITH {_SHAPES_SQL}, {_STATUS} SELECT pk, canon, canon = 'scorable' AS scorable, canon <> '' AS reviewed FROM r")
def s7_s8_review_status(spark, sf_dir):
    pk = F.col("pk")
    status = F.element_at(F.array(*map(F.lit, ("Reviewed", "motion blur", "Not Applicable", "", "scorable"))), (pk % 5 + 1).cast("int"))
    notes = F.element_at(F.array(*map(F.lit, ("heavy Blur", "glare, cropped", "low res", "uncertain", "damage", "", ""))), (pk % 7 + 1).cast("int"))
    canon = codes.review_status(status, F.col("t"), notes)
    return _shapes(spark, sf_dir).select("pk", canon.alias("canon"), (canon == "scorable").alias("scorable"), (canon != "").alias("reviewed"))


@query(f"""WITH {_SHAPES_SQL}, d AS (SELECT *, {_DIGITS} AS d FROM shapes)
  SELECT pk, regexp_full_match(t, '[0-9]{{6}}|[0-9]{{10}}|[0-9]{{3}}-[0-9]{{3}}|[0-9]{{4}}-[0-9]{{3}}-[0-9]{{3}}|SKU[:-]([0-9]{{6}}|[0-9]{{10}})') AS item,
    regexp_full_match(t, '[0-9]{{6}}|[0-9]{{3}}[^A-Za-z0-9_][0-9]{{3}}') AS vendor,
    CASE WHEN regexp_full_match(t, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}') THEN '' ELSE array_to_string(list_distinct(list_filter([
      CASE WHEN length(d) = 10 AND d[1:2] = '10' THEN d END, CASE WHEN length(d) = 11 AND d[2:3] = '10' THEN d[2:11] END, CASE WHEN length(d) IN (11, 12) AND d[1:2] = '10' THEN d[1:10] END, CASE WHEN length(d) > 10 AND d[-10:-9] = '10' THEN d[-10:] END], lambda x: x IS NOT NULL)).list_sort(), ',') END AS recovered
  FROM d""")
def s11_s12_legacy_codes(spark, sf_dir):
    t = F.col("t")
    return _shapes(spark, sf_dir).select("pk", t.rlike(codes.ITEM_CODES).alias("item"), t.rlike(codes.VENDOR_CODES).alias("vendor"), F.array_join(F.array_sort(codes.recovered(t)), ",").alias("recovered"))


@query("""SELECT p_partkey AS pk, CASE WHEN c IN ('handwritte', 'handwritten') THEN 'handwritten' ELSE c END AS class, regexp_replace(lower(p_brand), '[^a-z]', '', 'g') AS label
  FROM (SELECT *, regexp_replace(regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN 'Hand-writte' WHEN 1 THEN 'Price_SKU' ELSE p_brand END), '[^a-z]', '', 'g'), 'sku$', '') AS c FROM part)""")
def s9_s27_labels(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, "Hand-writte").when(F.col("p_partkey") % 3 == 1, "Price_SKU").otherwise(F.col("p_brand"))
    return fx.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), codes.class_token(raw).alias("class"), codes.plain_label(F.col("p_brand")).alias("label"))


@query(with_tables("""
  SELECT image, coalesce(max_by(tok, struct_pack(n := length(tok), t := tok)), '') AS best, coalesce(min_by(d, idx) FILTER (WHERE d <> ''), '') AS first_digits FROM (
    SELECT image, idx, regexp_replace(text, '[^0-9]', '', 'g') AS d, CASE WHEN regexp_full_match(r, '[0-9Xx]+') AND length(r) IN (6, 10) THEN upper(r) END AS tok FROM (SELECT *, regexp_replace(text, '[\\s._/-]', '', 'g') AS r FROM words)) GROUP BY image""", "words"))
def s10_s28_preferred_text(spark, sf_dir):
    w = fx.words(spark, sf_dir).groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("t"))
    return w.select("image", codes.preferred_text(F.col("t")).alias("best"), codes.first_digits(F.array_join("t", "|")).alias("first_digits"))


@query(with_tables("""
  SELECT image, det, '{''' || x1 || ''',''' || y1 || ''',''' || x2 || ''',''' || y2 || '''}' AS text, x1::INT AS r_x1, y2::INT AS r_y2, 1 AS n,
    least(x1, x2 + 5)::DOUBLE AS w_x1, greatest(y1, y2 + 1)::DOUBLE AS w_y2, image || '|' || cls || '|' || x1 || '|' || y1 || '|' || x2 || '|' || y2 AS key,
    lpad(det::VARCHAR, 3, '0') || '_' || cls || '_' || x1 || '_' || y1 || '_' || x2 || '_' || y2 || '.jpg' AS crop, printf('%.1f,%.1f', round_even((x1 + x2) / 2 / 50.0, 0) * 50.0, round_even((y1 + y2) / 2 / 50.0, 0) * 50.0) AS slot
  FROM pred_boxes""", "pred_boxes"))
def s13_s14_s24_codecs_and_keys(spark, sf_dir):
    b = Box.of()
    text = codes.box_text(*b)
    back = codes.parse_box_text(F.concat(text, F.lit(", {'7','8'")))
    wkt = codes.line_boxes(F.concat(F.lit("LINESTRING ("), F.concat_ws(" ", b.x1, b.y1), F.lit(", "), F.concat_ws(" ", b.x2 + 5, b.y2 + 1), F.lit("), (1 2)")))
    return fx.pred_boxes(spark, sf_dir).select(
        "image", "det", text.alias("text"), back[0]["x1"].alias("r_x1"), back[0]["y2"].alias("r_y2"), F.size(back).alias("n"), wkt[0]["x1"].alias("w_x1"), wkt[0]["y2"].alias("w_y2"),
        codes.region_key(F.col("image"), F.col("cls"), b).alias("key"), codes.crop_name(F.col("det"), F.col("cls"), b).alias("crop"), codes.slot_id(b.cx, b.cy, 50.0).alias("slot"),
    )


@query("""
  SELECT event_id, 'shelf-' || event_type AS bucket, 'a/b/' || event_id || '.jpg' AS name, CASE WHEN length((user_id)::VARCHAR) < 4 THEN lpad(user_id::VARCHAR, 4, '0') ELSE user_id::VARCHAR END AS store,
    lpad((user_id % 10000)::VARCHAR, 4, '0') AS f_store, lpad((event_id % 100)::VARCHAR, 2, '0') || '-' || lpad((event_id % 1000)::VARCHAR, 3, '0') AS f_bay, epoch_ms(date_trunc('second', ts)) AS ms
  FROM events""")
def s15_s17_addresses_and_times(spark, sf_dir):
    uri = codes.uri_parts(F.concat(F.lit("gs://shelf-"), F.col("event_type"), F.lit("/a/b/"), F.col("event_id"), F.lit(".jpg")))
    name = F.concat(F.lit("12#"), F.lpad((F.col("user_id") % 10_000).cast("string"), 4, "0"), F.lit("#x#"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit(".jpg"))
    d, iso = codes.file_details(name), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return fx.read(spark, sf_dir, "events").select("event_id", uri["bucket"].alias("bucket"), uri["name"].alias("name"), codes.zfill(F.col("user_id").cast("string"), 4).alias("store"), d["store"].alias("f_store"), d["bay"].alias("f_bay"), codes.epoch_ms(iso).alias("ms"))


_PRICES = """
  p AS (SELECT p_partkey AS pk, (p_partkey * 37 % 4000) / 100.0 AS a, (p_partkey * 37 % 4000 + p_partkey % 140 - 60) / 100.0 AS b FROM part),
  q AS (SELECT *, CASE WHEN a >= 1 THEN trunc(a)::INT ELSE round_even(a * 100, 0)::INT END AS ka, CASE WHEN b >= 1 THEN trunc(b)::INT ELSE round_even(b * 100, 0)::INT END AS kb, abs(a - b) AS away,
     round_even((a % 1) * 100, 0)::INT AS ca, round_even((b % 1) * 100, 0)::INT AS cb FROM p WHERE b > 0)"""


@query(f"""WITH {_PRICES}
  SELECT pk, ka AS key, trunc(a)::INT AS dollars, ca AS cents, abs(ka)::VARCHAR <> abs(kb)::VARCHAR AND (contains(abs(ka)::VARCHAR, abs(kb)::VARCHAR) OR contains(abs(kb)::VARCHAR, abs(ka)::VARCHAR)) AS sub,
    CASE WHEN a = 0 THEN 0.3 WHEN ka = kb THEN 1.0 WHEN contains(abs(ka)::VARCHAR, abs(kb)::VARCHAR) OR contains(abs(kb)::VARCHAR, abs(ka)::VARCHAR) THEN 0.7 WHEN away <= 0.10 THEN 0.9 WHEN away <= 0.50 THEN 0.6 WHEN away <= 1.0 THEN 0.5
      WHEN trunc(a) = trunc(b) AND away < 2 THEN 0.6 ELSE -1.0 END AS similarity,
    CASE WHEN ca // 10 = cb // 10 THEN 0.6 ELSE 0 END + CASE WHEN ca % 10 = cb % 10 THEN 0.4 ELSE 0 END AS cents_similarity
  FROM q""")
def s18_s23_prices(spark, sf_dir):
    k = F.col("p_partkey")
    a, b = (k * 37 % 4000) / 100.0, (k * 37 % 4000 + k % 140 - 60) / 100.0
    parsed = codes.price(F.concat(F.lit("$"), a.cast("string")))
    p = fx.read(spark, sf_dir, "part").where(b > 0)
    return p.select(
        k.alias("pk"), codes.price_key(a).alias("key"), parsed["dollars"].alias("dollars"), parsed["cents"].alias("cents"), codes.price_contains(a, b).alias("sub"),
        codes.price_similarity(a, b).alias("similarity"), codes.cents_similarity(a, b).alias("cents_similarity"),
    )


@query("""
  SELECT p_partkey AS pk, CASE p_partkey % 4 WHEN 0 THEN '-15:' || p_partkey || '|5:' || p_partkey WHEN 1 THEN '0:' || p_partkey WHEN 2 THEN '' ELSE '180:' || p_partkey || '|350:9' END AS hints,
    CASE p_partkey % 4 WHEN 0 THEN 5.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE 180.0 END AS angle,
    CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 ELSE 2 END AS priority FROM part""")
def s25_s26_rotation_and_source(spark, sf_dir):
    k = F.col("p_partkey")
    one = lambda a, s: F.struct(F.lit(a).alias("angle"), s.cast("string").alias("sku"))
    hints = F.when(k % 4 == 0, F.array(one(5, k), one(-15, k))).when(k % 4 == 1, F.array(one(0, k))).when(k % 4 == 3, F.array(one(350, F.lit(9)), one(180, k))).otherwise(F.array().cast("array<struct<angle:int,sku:string>>"))
    text = codes.rotation_text(hints)
    source = F.element_at(F.array(*map(F.lit, ("google_ocr_sku_parse", "x_enhanced_rot5", "rotneg5", "rot10", "rot180", "other", "rot5"))), (k % 7 + 1).cast("int"))
    return fx.read(spark, sf_dir, "part").select(k.alias("pk"), text.alias("hints"), codes.best_rotation(text, k.cast("string")).alias("angle"), codes.source_priority(source).alias("priority"))


@query("""
  SELECT base, min_by(u, struct_pack(id := page_id, pos := pos)) AS url, count(*) AS n FROM (
    SELECT page_id, pos, u, regexp_extract(regexp_replace(u, '[?#].*$', ''), '([^/]*)$', 1) AS base FROM (
      SELECT page_id, generate_subscripts(us, 1) - 1 AS pos, unnest(us) AS u FROM (SELECT page_id, [regexp_replace(x, '[).,;\\]]+$', '') FOR x IN regexp_extract_all(json, '(https?://[^\\s"''<>\\\\]+)', 1)] AS us
        FROM (SELECT page_id, '{"a": "https://cdn.example.org/i/' || page_id % 50 || '.jpg?x=1", "b": [' || url || ', http://img.example.org/' || page_id % 30 || '.png).]}' AS json FROM pages)))
    WHERE regexp_matches(lower(u), '\\.jpg|\\.jpeg|\\.png|\\.webp')) GROUP BY base""")
def s29_j17_url_harvest(spark, sf_dir):
    pid = F.col("page_id")
    text = F.concat(F.lit('{"a": "https://cdn.example.org/i/'), pid % 50, F.lit('.jpg?x=1", "b": ['), F.col("url"), F.lit(", http://img.example.org/"), pid % 30, F.lit(".png).]}"))
    found = fx.read(spark, sf_dir, "pages").select("page_id", F.posexplode(codes.image_urls(text)).alias("pos", "u"))
    return found.groupBy(codes.base_name(F.col("u")).alias("base")).agg(F.min_by("u", F.struct("page_id", "pos")).alias("url"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SHAPES_SQL} SELECT pk, CASE WHEN upper(trim(t)) IN ('N/A', 'NA', 'N-A', 'X') THEN 'not_applicable' WHEN {_DIGITS} = '' THEN 'needs_ground_truth' WHEN {_DIGITS} = lpad((pk * 31 % 1000000)::VARCHAR, 6, '0') THEN 'correct' ELSE 'incorrect' END AS status FROM shapes""")
def s30_expected_status(spark, sf_dir):
    reads = F.array(F.lit("1"), F.lpad((F.col("pk") * 31 % 1_000_000).cast("string"), 6, "0"))
    return _shapes(spark, sf_dir).select("pk", codes.expected_status(F.col("t"), reads).alias("status"))


