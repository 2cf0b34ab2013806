"""Sources and sinks of the shelf tables: JSON, CSV, text labels, image listings, payloads.

Schemas are explicit, so that no source is read twice; what cannot be parsed becomes null or goes to the corrupt column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions import codes

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
TRACK = f"det_id bigint, class_name string, confidence double, orig_bbox {BOX}, buffered_bbox {BOX}, seg_found boolean, ocr_found boolean, ocr_texts array<string>"
SHAPES = "image string, shapes array<struct<label:string,points:array<map<string,double>>>>"
INVENTORY = f"store_number string, packdown_observations array<struct<sku:string,bbox:{BOX},confidence:double,timestamp:string>>, sku_bounding map<string,string>, timestamp string"


def file_stem(suffix: str = "") -> Column:
    return F.concat(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1), F.lit(suffix))


def read_tracks(spark: SparkSession, path: str, image: str | None = None) -> DataFrame:
    """A folder of one JSON array an image: a row a detection, the image named by the file. One image reads one file."""
    reader = spark.read.schema(TRACK).option("multiLine", True)
    if image:
        reader = reader.option("pathGlobFilter", f"{image.rsplit('.', 1)[0]}.json")
    return reader.json(path).withColumn("image", file_stem(".jpg"))


def write_tracks(rows: DataFrame, path: str) -> None:
    """rows: image and the columns of a track; one JSON array a line, a folder part an image's hash."""
    one = rows.groupBy("image").agg(F.to_json(F.array_sort(F.collect_list(F.struct("det_id", "class_name", "confidence", "orig_bbox")))).alias("predictions"))
    one.write.json(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload lines of several forms -> image, index, det_id, class_name, confidence, box.

    A bare list, or an object with ``predictions`` or ``detections``; the image comes from the item, else the envelope.
    """
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    items = F.coalesce(F.try_variant_get("v", "$.predictions", "array<variant>"), F.try_variant_get("v", "$.detections", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    each = v.select(F.try_variant_get("v", "$.image", "string").alias("envelope"), F.posexplode(items).alias("index", "item"))
    get = lambda p, t: F.try_variant_get("item", p, t)
    box = F.struct(*[F.coalesce(get(f"$.orig_bbox.{c}", "int"), get(f"$.bbox.{c}", "int")).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return each.select(F.coalesce(get("$.image", "string"), "envelope").alias("image"), "index", get("$.det_id", "bigint").alias("det_id"), F.coalesce(get("$.class_name", "string"), get("$.label", "string")).alias("class_name"), get("$.confidence", "double").alias("confidence"), box.alias("box"))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files -> image, shape, label, points (x, y; keys "x"/"y" or "0"/"1")."""
    s = spark.read.schema(SHAPES).json(path)
    point = lambda p: F.struct(F.coalesce(p["x"], p["0"]).alias("x"), F.coalesce(p["y"], p["1"]).alias("y"))
    each = s.select("image", F.posexplode("shapes").alias("shape", "s"))
    return each.select("image", "shape", F.col("s.label").alias("label"), F.transform("s.points", point).alias("points"))


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_captures(spark: SparkSession, path: str, classification: str) -> DataFrame:
    """Capture CSV of one classification -> url, captured_ts, region, box."""
    c = read_table_csv(spark, path, "classification string, url string, captured_ts string, coordinates string").where(F.col("classification") == classification)
    return c.select("url", "captured_ts", F.posexplode(codes.line_boxes(F.col("coordinates"))).alias("region", "b")).select("url", "captured_ts", "region", "b.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``class xc yc w h`` or ``class x1 y1 x2 y2 ...`` lines -> line, cls, values, box (normalised)."""
    v = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    t = spark.read.text(path).select("value", v.alias("v")).where(F.size("v") >= 5)
    rest = F.slice("v", F.lit(2), F.size("v") - 1)
    xs, ys = F.filter(rest, lambda _, i: i % 2 == 0), F.filter(rest, lambda _, i: i % 2 == 1)
    is_box = F.size("v") == 5
    four = lambda i: F.element_at("v", F.lit(i + 1))
    box = F.when(is_box, F.struct((four(1) - four(3) / 2).alias("x1"), (four(2) - four(4) / 2).alias("y1"), (four(1) + four(3) / 2).alias("x2"), (four(2) + four(4) / 2).alias("y2"))).otherwise(
        F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    )
    return t.select("value", F.element_at("v", 1).cast("int").alias("cls"), F.when(is_box, "box").otherwise("segment").alias("kind"), box.alias("box"))


def list_images(spark: SparkSession, path: str, crc: bool = False) -> DataFrame:
    """path, size and, only if asked (it reads the bytes), crc32 of the files of a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("size"), *([F.crc32("content").alias("crc32")] if crc else []))


def ocr_records(annotations: Column) -> Column:
    """JSON text of OCR annotations -> array of (idx, text, box): the first holds the whole text and is left out."""
    parsed = F.from_json(annotations, "array<struct<description:string,vertices:array<struct<x:int,y:int>>>>")
    word = lambda a, i: F.struct((i).alias("idx"), a["description"].alias("text"), *[f(F.transform(a["vertices"], lambda v: v[c])).alias(n) for n, f, c in (("x1", F.array_min, "x"), ("y1", F.array_min, "y"), ("x2", F.array_max, "x"), ("y2", F.array_max, "y"))])
    return F.transform(F.slice(parsed, F.lit(2), F.greatest(F.size(parsed) - 1, F.lit(0))), word)


def detection_rows(response: Column) -> Column:
    """JSON ``[[x1, y1, x2, y2, confidence, class], ...]`` -> array of structs; rows of another length are dropped."""
    rows = F.filter(F.from_json(response, "array<array<double>>"), lambda r: F.size(r) == 6)
    return F.transform(rows, lambda r: F.struct(*[r[i].cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], r[4].alias("confidence"), r[5].cast("int").alias("class_id")))


def inventory_rows(payload: Column) -> Column:
    """Payload JSON -> array of (store, sku, box, confidence, timestamp); the list wins over the encoded map, even empty."""
    p = F.from_json(payload, INVENTORY)
    store, kind = codes.zfill(p["store_number"], 4), "array<struct<store:string,sku:string,x1:int,y1:int,x2:int,y2:int,confidence:double,timestamp:string>>"
    box = lambda b: [b[c].alias(c) for c in ("x1", "y1", "x2", "y2")]
    rich = F.transform(p["packdown_observations"], lambda o: F.struct(store.alias("store"), codes.published_sku(o["sku"]).alias("sku"), *box(o["bbox"]), o["confidence"].alias("confidence"), o["timestamp"].alias("timestamp")))
    old = F.flatten(F.transform(F.map_entries(p["sku_bounding"]), lambda e: F.transform(codes.parse_box_text(e["value"]), lambda b: F.struct(store.alias("store"), codes.published_sku(e["key"]).alias("sku"), *box(b), F.lit(None).cast("double").alias("confidence"), p["timestamp"].alias("timestamp")))))
    return F.filter(F.coalesce(rich.cast(kind), old.cast(kind)), lambda o: o["sku"].isNotNull())


def beam_metadata(text: Column) -> Column:
    """struct<position, beams> of side metadata JSON; null if it can't be parsed."""
    return F.from_json(text, "position string, beam_detections array<array<double>>")


def sku_payloads(rows: DataFrame) -> DataFrame:
    """image, sku, box -> the published JSON of each image: quantities, and each code's boxes as text."""
    per = rows.groupBy("image", "sku").agg(F.array_sort(F.collect_list(F.struct("x1", "y1", "x2", "y2"))).alias("b"))
    text = F.array_join(F.transform("b", lambda b: codes.box_text(b["x1"], b["y1"], b["x2"], b["y2"])), ", ")
    item = per.select("image", F.struct(F.col("sku").cast("string").alias("sku"), F.size("b").alias("quantity"), text.alias("boxes")).alias("i"))
    one = item.groupBy("image").agg(F.array_sort(F.collect_list("i")).alias("i"))
    quantities = F.transform("i", lambda x: F.struct(x["sku"].alias("sku"), x["quantity"].alias("quantity")))
    bounding = F.map_from_entries(F.transform("i", lambda x: F.struct(x["sku"], x["boxes"])))
    return one.select("image", F.to_json(F.struct("image", quantities.alias("skus"), bounding.alias("sku_bounding"))).alias("payload"))


def detection_exports(rows: DataFrame, width: int, height: int) -> DataFrame:
    """image, det, cls_id, box, conf -> the record line (3 and 5 places) and the normalised label line of each detection."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    record = F.to_json(F.struct(F.col("image").alias("image_id"), F.col("cls_id").alias("category_id"), F.array(*[F.round(c.cast("double"), 3) for c in (F.col("x1"), F.col("y1"), w, h)]).alias("bbox"), F.round(F.col("conf") / 100, 5).alias("score")))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls_id", (F.col("x1") + w / 2) / width, (F.col("y1") + h / 2) / height, w / width, h / height)
    return rows.select("image", "det", record.alias("record"), line.alias("line"))


def refreshed_sequence(cache: DataFrame, base: DataFrame, stale: DataFrame) -> DataFrame:
    """Sequence rows of each bay from the cache, or from the base where the cache is stale and the base has no fewer rows.

    cache, base: bay and more; stale: bay, refresh. Bays without cached rows come from the base.
    """
    n = lambda df, c: df.groupBy("bay").agg(F.count(F.lit(1)).alias(c))
    pick = n(cache, "c").join(n(base, "b"), "bay", "full").join(stale, "bay", "left")
    use = F.coalesce(F.col("c"), F.lit(0)) == 0
    use = use | (F.coalesce("refresh", F.lit(False)) & (F.coalesce(F.col("b"), F.lit(0)) >= F.col("c")))
    pick = pick.select("bay", use.alias("from_base"))
    return cache.join(pick.where("NOT from_base").select("bay"), "bay", "left_semi").unionByName(base.join(pick.where("from_base").select("bay"), "bay", "left_semi"))


def template_rows(regions: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows for regions that the review table lacks, labels blank; those that it has stay as they are."""
    fresh = regions.join(existing.select("region_key"), "region_key", "left_anti")
    return existing.unionByName(fresh.select("region_key", "image", F.lit("").alias("label")))
