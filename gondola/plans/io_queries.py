"""Sources and sinks: tables derived from the given ones are written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from gondola.functions.boxes import Box
from gondola.operators import planogram
from gondola.plans import fixtures as fx
from gondola.plans.fixtures import with_tables
from gondola.plans.registry import query
from gondola.sources import io
from gondola.sources.scratch import shared_path


def _json_lines(df, spark, name):
    path = shared_path(spark, name)
    df.write.text(path)
    return path


def _box(df):
    return df.withColumn("box", F.struct(*[c.cast("int").alias(n) for c, n in zip(Box.of(), ("x1", "y1", "x2", "y2"), strict=True)]))


@query(with_tables("SELECT image, det AS det_id, cls AS class_name, conf / 100.0 AS confidence, x1, y2 FROM pred_boxes WHERE image % 4 <> 3", "pred_boxes"))
def io1_track_source(spark, sf_dir):
    p = _box(fx.pred_boxes(spark, sf_dir).where("image % 4 <> 3"))
    item = F.struct(F.col("det").alias("det_id"), F.col("cls").alias("class_name"), (F.col("conf") / 100).alias("confidence"), F.col("box").alias("orig_bbox"), (F.col("conf") > 50).alias("seg_found"), F.col("image").cast("string").alias("image_name"))
    path = _json_lines(p.select(F.to_json(item)), spark, "tracks")
    t = spark.read.schema(io.TRACK + ", image_name string").json(path)
    return t.select(F.col("image_name").cast("bigint").alias("image"), "det_id", "class_name", "confidence", F.col("orig_bbox.x1").alias("x1"), F.col("orig_bbox.y2").alias("y2"))


@query(with_tables("SELECT image::VARCHAR AS image, det AS det_id, cls AS class_name, x1 FROM pred_boxes", "pred_boxes"))
def io2_payload_source(spark, sf_dir):
    p = _box(fx.pred_boxes(spark, sf_dir))
    rich, plain = F.struct(F.col("det").alias("det_id"), F.col("cls").alias("class_name"), F.col("box").alias("orig_bbox")), F.struct(F.col("det").alias("det_id"), F.col("cls").alias("label"), F.col("box").alias("bbox"), F.col("image").cast("string").alias("image"))
    g = p.groupBy("image").agg(F.collect_list(rich).alias("a"), F.collect_list(plain).alias("b"))
    name = F.col("image").cast("string").alias("image")
    text = F.when(F.col("image") % 3 == 0, F.to_json(F.struct(name, F.col("a").alias("predictions")))).when(F.col("image") % 3 == 1, F.to_json(F.struct(name, F.col("a").alias("detections")))).otherwise(F.to_json("b"))
    bad = spark.range(1).select(F.lit("{not json").alias("value"))
    path = _json_lines(g.select(text.alias("value")).unionByName(bad), spark, "payloads")
    return io.read_payloads(spark, path).select("image", "det_id", "class_name", F.col("box.x1").cast("bigint").alias("x1"))


@query(with_tables("SELECT image::VARCHAR AS image, gt AS shape, cls AS label, x1::DOUBLE AS x1, y2::DOUBLE AS y2 FROM (SELECT image, row_number() OVER (PARTITION BY image ORDER BY gt) - 1 AS gt, cls, x1, y2 FROM gt_boxes)", "gt_boxes"))
def io3_shape_source(spark, sf_dir):
    g = fx.gt_boxes(spark, sf_dir)
    point = lambda kx, ky, x, y: F.create_map(F.lit(kx), x.cast("double"), F.lit(ky), y.cast("double"))
    pts = F.when(F.col("gt") % 2 == 0, F.array(point("x", "y", F.col("x1"), F.col("y1")), point("x", "y", F.col("x2"), F.col("y2")))).otherwise(F.array(point("0", "1", F.col("x1"), F.col("y1")), point("0", "1", F.col("x2"), F.col("y2"))))
    s = g.withColumn("s", F.to_json(F.struct(F.col("cls").alias("label"), pts.alias("points"))))
    one = s.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gt", "s"))), lambda x: x["s"]), ",").alias("j"))
    path = _json_lines(one.select(F.concat(F.lit('{"image":"'), F.col("image"), F.lit('","shapes":['), F.col("j"), F.lit("]}"))), spark, "shapes")
    r = io.read_shapes(spark, path)
    return r.select("image", F.col("shape").cast("bigint").alias("shape"), "label", F.col("points")[0]["x"].alias("x1"), F.col("points")[1]["y"].alias("y2"))


@query("SELECT doc_id, lang, source, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def io4_truth_csv(spark, sf_dir):
    t = fx.read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(fx.read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").na.fill(-1, ["quality"])
    path = shared_path(spark, "truth")
    io.write_table_csv(t, path)
    return io.read_table_csv(spark, path, "doc_id bigint, lang string, source string, quality int")


@query("SELECT event_id::VARCHAR AS url, (event_id % 90)::DOUBLE AS x1, (event_id % 70 + 9)::DOUBLE AS y2 FROM events WHERE event_type = 'click'")
def io5_capture_csv(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    x, y = F.col("event_id") % 90, F.col("event_id") % 70
    text = F.concat(F.lit("LINESTRING ("), F.concat_ws(" ", x, y), F.lit(", "), F.concat_ws(" ", x + 7, y + 9), F.lit(")"))
    path = shared_path(spark, "captures")
    io.write_table_csv(e.select(F.col("event_type").alias("classification"), F.col("event_id").alias("url"), F.col("ts").cast("string").alias("captured_ts"), text.alias("coordinates")), path)
    return io.read_captures(spark, path, "click").select("url", "x1", "y2")


@query(with_tables("SELECT image, det, CASE WHEN det % 2 = 0 THEN 'box' ELSE 'segment' END AS kind, round(x1 / 220.0, 4) AS x1, round(y2 / 100.0, 4) AS y2 FROM pred_boxes", "pred_boxes"))
def io6_label_source(spark, sf_dir):
    p = fx.pred_boxes(spark, sf_dir)
    b = Box(*(c / d for c, d in zip(Box.of(), (220.0, 100.0, 220.0, 100.0), strict=True)))
    box = F.format_string("%.9f %.9f %.9f %.9f", b.cx, b.cy, b.w, b.h)
    seg = F.format_string("%.9f %.9f %.9f %.9f %.9f %.9f", b.x1, b.y1, b.x2, b.y1, b.x2, b.y2)
    ident = F.col("image") * 100 + F.col("det")
    path = _json_lines(p.select(F.concat_ws(" ", ident, F.when(F.col("det") % 2 == 0, box).otherwise(seg))), spark, "labels")
    r = io.read_labels(spark, path)
    return r.select(F.expr("cls div 100").alias("image"), (F.col("cls") % 100).cast("bigint").alias("det"), "kind", F.round("box.x1", 4).alias("x1"), F.round("box.y2", 4).alias("y2"))


@query("SELECT count(*) AS n, sum(page_id) AS ids, count(url) AS with_url, sum(length(url)) AS bytes FROM pages")
def io8_manifest(spark, sf_dir):
    path = shared_path(spark, "manifest")
    fx.read(spark, sf_dir, "pages").select("page_id", "url", F.length("url").alias("size")).write.json(path)
    m = spark.read.schema("page_id bigint, url string, size bigint").json(path)
    return m.agg(F.count(F.lit(1)).alias("n"), F.sum("page_id").alias("ids"), F.count("url").alias("with_url"), F.sum("size").alias("bytes"))


@query()
def io7_file_listing(spark, sf_dir):
    """Every page's bytes as a file of its partition, listed with size and checksum."""
    path = shared_path(spark, "files")
    fx.read(spark, sf_dir, "pages").select("html").write.text(path)
    return io.list_images(spark, path, crc=True).where(F.col("path").rlike(r"\.txt$")).select("size", "crc32")


@query(with_tables("SELECT image, idx + 1 AS idx, text, x1, y1, x2, y2 FROM words", "words"))
def io9_ocr_annotations(spark, sf_dir):
    w = fx.words(spark, sf_dir)
    vertex = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b = Box.of()
    item = F.struct("idx", F.col("text").alias("description"), F.array(vertex(b.x1, b.y1), vertex(b.x2, b.y1), vertex(b.x2, b.y2), vertex(b.x1, b.y2)).alias("vertices"))
    one = w.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("i"))
    full = F.struct(F.lit(-1).cast("bigint").alias("idx"), F.array_join(F.transform("i", lambda x: x["description"]), "\n").alias("description"), F.element_at("i", 1)["vertices"].alias("vertices"))
    r = one.select("image", F.explode(io.ocr_records(F.to_json(F.concat(F.array(full), "i")))).alias("r")).select("image", "r.*")
    return r.select("image", (F.col("idx") + 1).alias("idx"), "text", "x1", "y1", "x2", "y2")


@query(with_tables("SELECT image, x1, y2, conf / 100.0 AS confidence, sk % 16 AS class_id FROM pred_boxes WHERE conf >= 25 AND sk % 16 NOT IN (3, 5)", "pred_boxes"))
def io10_detection_response(spark, sf_dir):
    p = fx.pred_boxes(spark, sf_dir)
    row = F.array(*[c.cast("double") for c in (*Box.of(), F.col("conf") / 100, F.col("sk") % 16)])
    g = p.groupBy("image").agg(F.to_json(F.concat(F.collect_list(row), F.array(F.array(F.lit(1.0))))).alias("j"))
    return g.select("image", F.inline(io.detection_rows(F.col("j")))).where((F.col("confidence") >= 0.25) & ~F.col("class_id").isin(3, 5)).select("image", "x1", "y2", "confidence", "class_id")


@query(with_tables("SELECT lpad((image % 20)::VARCHAR, 4, '0') AS store, '0000' || lpad((pk % 1000000)::VARCHAR, 6, '0') AS sku, x1, y2, CASE WHEN image % 2 = 0 THEN conf / 100.0 END AS confidence FROM pred_boxes WHERE det = 1", "pred_boxes"))
def io11_inventory_payload(spark, sf_dir):
    p = _box(fx.pred_boxes(spark, sf_dir).where("det = 1"))
    sku, store = F.lpad((F.col("pk") % 1_000_000).cast("string"), 6, "0"), (F.col("image") % 20).cast("string").alias("store_number")
    rich = F.struct(store, F.array(F.struct(sku.alias("sku"), F.col("box").alias("bbox"), (F.col("conf") / 100).alias("confidence"), F.lit("t").alias("timestamp"))).alias("packdown_observations"))
    old = F.struct(store, F.create_map(sku, F.format_string("{'%d','%d','%d','%d'}", *Box.of())).alias("sku_bounding"), F.lit("t").alias("timestamp"))
    j = F.when(F.col("image") % 2 == 0, F.to_json(rich)).otherwise(F.to_json(old))
    return p.select(F.explode(io.inventory_rows(j)).alias("o")).select("o.store", "o.sku", "o.x1", "o.y2", "o.confidence")


@query(with_tables("SELECT image, ['left-center', 'right-before'][image % 2 + 1] AS position, count(*) AS beams FROM pred_boxes WHERE det <= image % 4 GROUP BY image", "pred_boxes"))
def io12_side_metadata(spark, sf_dir):
    p = fx.pred_boxes(spark, sf_dir).where("det <= image % 4")
    g = p.groupBy("image").agg(F.collect_list(F.array(*[c.cast("double") for c in Box.of()])).alias("beam_detections"))
    j = F.to_json(F.struct(F.when(F.col("image") % 2 == 0, "left-center").otherwise("right-before").alias("position"), "beam_detections"))
    m = io.beam_metadata(j)
    return g.select("image", m["position"].alias("position"), F.size(m["beam_detections"]).alias("beams"))


@query(with_tables("""SELECT bay, loc, 'cache' AS origin FROM c WHERE bay NOT IN (SELECT bay FROM pick) UNION ALL SELECT bay, loc, 'base' FROM b WHERE bay IN (SELECT bay FROM pick)""", "sequence", more="""
  c AS (SELECT bay, loc FROM sequence WHERE bay <> 'Brand#12'), b AS (SELECT p_brand AS bay, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS loc FROM part),
  gap AS (SELECT bay, bool_or(coalesce(g > 1, false)) AS hole, count(*) AS n FROM (SELECT bay, lead(loc) OVER (PARTITION BY bay ORDER BY loc) - loc AS g FROM c) GROUP BY bay),
  pick AS (SELECT e.bay FROM (SELECT p_brand AS bay, count(*) AS n FROM part GROUP BY p_brand) e LEFT JOIN gap ON e.bay = gap.bay WHERE coalesce(gap.n, 0) < e.n OR hole)"""))
def io13_sequence_refresh(spark, sf_dir):
    from pyspark.sql import Window

    cache = fx.sequence(spark, sf_dir).where("bay <> 'Brand#12'").select("bay", "loc").withColumn("origin", F.lit("cache"))
    base = fx.read(spark, sf_dir, "part").select(F.col("p_brand").alias("bay"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("loc"), F.lit("base").alias("origin"))
    stale = planogram.needs_refresh(cache.select("bay", "loc"), base.groupBy("bay").agg(F.count(F.lit(1)).alias("n")))
    return io.refreshed_sequence(cache, base, stale)


@query(with_tables("SELECT image, count(DISTINCT sk % 50) AS skus, count(*) AS boxes FROM pred_boxes GROUP BY image", "pred_boxes"))
def io14_sku_payload_sink(spark, sf_dir):
    path = shared_path(spark, "published")
    io.sku_payloads(fx.pred_boxes(spark, sf_dir).withColumn("sku", F.col("sk") % 50)).write.json(path)
    back = spark.read.schema("image bigint, payload string").json(path)
    q = F.from_json("payload", "skus array<struct<sku:string,quantity:int>>")
    return back.select("image", F.size(q["skus"]).cast("bigint").alias("skus"), F.aggregate(q["skus"], F.lit(0).cast("bigint"), lambda a, x: a + x["quantity"]).alias("boxes"))


@query("SELECT doc_id, source AS path, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def io15_label_export(spark, sf_dir):
    path = shared_path(spark, "export")
    d = fx.read(spark, sf_dir, "documents").select("doc_id", "source").join(fx.read(spark, sf_dir, "labels"), "doc_id").where("quality = 1")
    io.write_table_csv(d.select("doc_id", F.col("source").alias("path"), F.col("quality").alias("label")).sort("path", "doc_id"), path)
    return io.read_table_csv(spark, path, "doc_id bigint, path string, label int")


@query(with_tables("SELECT image, det, round(x1::DOUBLE, 3) AS x, round(conf / 100.0, 5) AS score, (sk % 15)::INT AS cls, printf('%.6f', (x1 + (x2 - x1) / 2) / 220.0) AS xc FROM pred_boxes", "pred_boxes"))
def io16_detection_exports(spark, sf_dir):
    e = io.detection_exports(fx.pred_boxes(spark, sf_dir).withColumn("cls_id", (F.col("sk") % 15).cast("int")), 220, 100)
    r = F.from_json("record", "image_id bigint, category_id int, bbox array<double>, score double")
    return e.select("image", "det", r["bbox"][0].alias("x"), r["score"].alias("score"), r["category_id"].alias("cls"), F.split("line", " ")[1].alias("xc"))


@query(with_tables("SELECT category, string_agg(line, '; ' ORDER BY image) AS lines FROM (SELECT image, CASE WHEN n > 30 THEN 'full' ELSE 'part' END AS category, image || ': ' || n AS line FROM (SELECT image, count(*) AS n FROM pred_boxes GROUP BY image)) GROUP BY category", "pred_boxes"))
def io17_report_lines(spark, sf_dir):
    n = fx.pred_boxes(spark, sf_dir).groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    lines = n.select(F.when(F.col("n") > 30, "full").otherwise("part").alias("category"), F.struct("image", F.concat_ws(": ", "image", "n").alias("line")).alias("l"))
    return lines.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "; ").alias("lines"))


@query(with_tables("SELECT image || '::' || det AS region_key, image, CASE WHEN det % 3 = 0 THEN 'yes' ELSE '' END AS label FROM pred_boxes", "pred_boxes"))
def io18_review_template(spark, sf_dir):
    r = fx.pred_boxes(spark, sf_dir).select(F.concat_ws("::", "image", "det").alias("region_key"), "image", "det")
    return io.template_rows(r.select("region_key", "image"), r.where("det % 3 = 0").select("region_key", "image", F.lit("yes").alias("label")))
