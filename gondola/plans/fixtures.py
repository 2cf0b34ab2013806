"""Shelf tables derived from the given tables, by integer arithmetic that both engines do alike.

Each function returns a DataFrame; ``SQL`` holds the same table as a DuckDB query, to be used as a common table
expression through ``with_tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def pred_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, det, cls, x1, y1, x2, y2, conf (integer percent)."""
    li = read(spark, sf_dir, "lineitem").select(*ORDER, "l_returnflag")
    det = F.row_number().over(Window.partitionBy("image").orderBy(*ORDER))
    li = li.withColumn("image", F.expr("l_orderkey div 8")).withColumn("det", det)
    x1, y1 = F.col("l_partkey") % 200, F.col("l_suppkey") % 60
    return li.select(
        "image", "det", F.col("l_returnflag").alias("cls"), x1.alias("x1"), y1.alias("y1"),
        (x1 + 20 + F.col("l_partkey") % 17).alias("x2"), (y1 + 20 + F.col("l_suppkey") % 13).alias("y2"),
        ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber")) % 101).alias("conf"),
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
    )


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, gt, cls, x1, y1, x2, y2: three quarters of the predictions, shifted a little."""
    p = pred_boxes(spark, sf_dir).where("(pk + sk) % 4 <> 0")
    dx, dy = F.col("pk") % 5 - 2, F.col("sk") % 5 - 2
    return p.select("image", F.col("det").alias("gt"), "cls", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"), "pk", "sk")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, store, sku_text (6 digits, 10 digits or malformed), conf, ts."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    six, ten = F.lpad((F.col("l_partkey") % 1_000_000).cast("string"), 6, "0"), F.concat(F.lit("10"), F.lpad((F.col("l_partkey") % 100_000_000).cast("string"), 8, "0"))
    text = F.when(F.col("l_partkey") % 3 == 0, six).when(F.col("l_partkey") % 3 == 1, ten).otherwise(F.concat(F.lit("bad-"), F.col("l_partkey") % 100))
    joined = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select((F.col("o_custkey") % 20).alias("store"), text.alias("sku_text"), (F.col("l_suppkey") % 101).alias("conf"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ts"), "l_orderkey", "l_linenumber", F.col("l_partkey").alias("pk"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bay, loc (with gaps), sku, price."""
    p = read(spark, sf_dir, "part")
    loc = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return p.select(F.col("p_brand").alias("bay"), loc.alias("loc"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("sku"), F.col("p_retailprice").alias("price"), F.col("p_partkey").alias("pk")).where("pk % 29 <> 0")


def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bay, pos (row-major, from 0), price (null where blank): the shelf as read, with errors."""
    pos = F.row_number().over(Window.partitionBy("bay").orderBy("loc")) - 1
    s = sequence(spark, sf_dir).withColumn("pos", pos)
    price = F.when(F.col("pos") % 7 == 3, None).when(F.col("pos") % 11 == 5, F.col("price") + 37).otherwise(F.col("price"))
    return s.select("bay", "pos", price.alias("price"), "sku", "loc")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bay, image (day), slot: the empty slots seen."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("bay"), F.date_format("ts", "yyyy-MM-dd").alias("image"), (F.bround(F.col("value") / 50) * 50).cast("bigint").alias("slot")).distinct()


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, row, reviewer, status (null when unlabelled)."""
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), read(spark, sf_dir, "labels")
    status = F.when(F.col("toxic") == 1, "glare").when(F.col("quality") == 1, "scorable").when(F.col("quality") == 0, "not applicable")
    return d.join(lab, "doc_id", "left").select(F.col("source").alias("image"), F.col("doc_id").alias("row"), F.col("lang").alias("reviewer"), status.alias("status"))


def queue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, user, action, ts, event_id."""
    e = read(spark, sf_dir, "events")
    actions = F.create_map(*[F.lit(x) for kv in (("view", "assign"), ("click", "label"), ("purchase", "relabel"), ("error", "skip"), ("signup", "recycle")) for x in kv])
    return e.select((F.col("event_id") % 500).alias("image"), F.col("user_id").alias("user"), F.coalesce(F.element_at(actions, F.col("event_type")), F.lit("assign")).alias("action"), "ts", "event_id", "value")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, line, idx (in the image), text, box: OCR words with codes, fragments, dates and letters."""
    p = pred_boxes(spark, sf_dir)
    kind = F.col("sk") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("10"), F.lpad((F.col("pk") % 100_000_000).cast("string"), 8, "0")))
        .when(kind == 1, F.lpad((F.col("pk") % 1_000_000).cast("string"), 6, "0"))
        .when(kind == 2, "1004").when(kind == 3, "334-515").when(kind == 4, "02/05/26").otherwise("QTY")
    )
    return p.select("image", F.expr("(det - 1) div 4").alias("line"), (F.col("det") - 1).alias("idx"), text.alias("text"), "x1", "y1", "x2", "y2")


SQL: dict[str, str] = {
    "pred_boxes": """
      SELECT l_orderkey // 8 AS image, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS det,
        l_returnflag AS cls, l_partkey % 200 AS x1, l_suppkey % 60 AS y1, l_partkey % 200 + 20 + l_partkey % 17 AS x2, l_suppkey % 60 + 20 + l_suppkey % 13 AS y2,
        (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 101 AS conf, l_partkey AS pk, l_suppkey AS sk FROM lineitem""",
    "gt_boxes": """
      SELECT image, det AS gt, cls, x1 + pk % 5 - 2 AS x1, y1 + sk % 5 - 2 AS y1, x2 + pk % 5 - 2 AS x2, y2 + sk % 5 - 2 AS y2, pk, sk FROM pred_boxes WHERE (pk + sk) % 4 <> 0""",
    "observations": """
      SELECT o_custkey % 20 AS store, CASE l_partkey % 3 WHEN 0 THEN lpad((l_partkey % 1000000)::VARCHAR, 6, '0') WHEN 1 THEN '10' || lpad((l_partkey % 100000000)::VARCHAR, 8, '0') ELSE 'bad-' || (l_partkey % 100)::VARCHAR END AS sku_text,
        l_suppkey % 101 AS conf, strftime(l_shipdate, '%Y-%m-%d') AS ts, l_orderkey, l_linenumber, l_partkey AS pk FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "sequence": """
      SELECT * FROM (SELECT p_brand AS bay, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS loc, lpad(p_partkey::VARCHAR, 6, '0') AS sku, p_retailprice AS price, p_partkey AS pk FROM part) WHERE pk % 29 <> 0""",
    "price_cells": """
      SELECT bay, pos, CASE WHEN pos % 7 = 3 THEN NULL WHEN pos % 11 = 5 THEN price + 37 ELSE price END AS price, sku, loc
      FROM (SELECT *, row_number() OVER (PARTITION BY bay ORDER BY loc) - 1 AS pos FROM sequence)""",
    "captures": "SELECT DISTINCT user_id AS bay, strftime(ts, '%Y-%m-%d') AS image, (round_even(value / 50, 0) * 50)::BIGINT AS slot FROM events",
    "review": """
      SELECT source AS image, doc_id AS row, lang AS reviewer, CASE WHEN toxic = 1 THEN 'glare' WHEN quality = 1 THEN 'scorable' WHEN quality = 0 THEN 'not applicable' END AS status
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "queue_events": """
      SELECT event_id % 500 AS image, user_id AS user, CASE event_type WHEN 'click' THEN 'label' WHEN 'purchase' THEN 'relabel' WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'recycle' ELSE 'assign' END AS action, ts, event_id, value FROM events""",
    "words": """
      SELECT image, (det - 1) // 4 AS line, det - 1 AS idx, CASE sk % 6 WHEN 0 THEN '10' || lpad((pk % 100000000)::VARCHAR, 8, '0') WHEN 1 THEN lpad((pk % 1000000)::VARCHAR, 6, '0')
        WHEN 2 THEN '1004' WHEN 3 THEN '334-515' WHEN 4 THEN '02/05/26' ELSE 'QTY' END AS text, x1, y1, x2, y2 FROM pred_boxes""",
}
_NEEDS = {"gt_boxes": ["pred_boxes"], "words": ["pred_boxes"], "price_cells": ["sequence"]}


def with_tables(query: str, *names: str, more: str = "") -> str:
    """``query`` with the named fixtures in front, as common table expressions; ``more``: further ones."""
    order: list[str] = []
    for n in names:
        for x in (*_NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in order] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {query}"
