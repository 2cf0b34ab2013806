"""Filters of shelf labels by beams and frame position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions import boxes as bx
from gondola.functions.boxes import Box


def filter_frames(skus: DataFrame, beams: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of ``skus`` (image, box, ...) that belong to the bay of their frame.

    meta: image, position, width. Centre frames with two beams keep what lies between them; before and after frames with
    one beam drop one side (left of it for left-before and right-after, right of it for right-before and left-after).
    Any other number of beams, invalid beams, unknown positions and images without metadata keep all rows.
    """
    b = beams.select("image", F.struct(((F.col("x1") + F.col("x2")) / 2).alias("cx"), "det", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], bx.valid(Box.of()).alias("ok")).alias("b"))
    listed = b.groupBy("image").agg(F.array_sort(F.collect_list("b")).alias("beams"))
    rows = skus.join(meta, "image", "left").join(listed, "image", "left")
    n = F.when(F.exists("beams", lambda x: ~x["ok"]), -1).otherwise(F.size("beams"))
    part = lambda i: Box(*(F.get("beams", F.lit(i))[c] for c in ("x1", "y1", "x2", "y2")))
    sku, first, second = Box.of(), part(0), part(1)
    leans = bx.leans_right_side(first, F.col("width"))
    side = F.regexp_extract("position", "^(left|right)-", 1)
    frame = F.regexp_extract("position", "-(center|before|after)$", 1)
    drop_left = F.concat_ws("-", side, frame).isin("left-before", "right-after")
    keep = (
        F.when((frame == "center") & (n == 2), ~bx.sku_left_of_beam(sku, first) & ~bx.sku_right_of_beam(sku, second, True))
        .when(frame.isin("before", "after") & (n == 1) & drop_left, ~bx.sku_left_of_beam(sku, first, leans))
        .when(frame.isin("before", "after") & (n == 1), ~bx.sku_right_of_beam(sku, first, leans))
        .otherwise(True)
    )
    return rows.where(F.coalesce(keep, F.lit(True))).select(*skus.columns)


def boxes_by_sku(skus: DataFrame) -> DataFrame:
    """image, boxes: the map of each code to its boxes, rebuilt from filtered rows (image, sku, box)."""
    per = skus.groupBy("image", "sku").agg(F.array_sort(F.collect_list(Box.of().struct())).alias("b"))
    return per.groupBy("image").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sku", "b")))).alias("boxes"))
