"""Non-maximum suppression and selection of non-overlapping candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BOX = "struct<neg:double,det:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>"


def nms(preds: DataFrame, threshold: float = 0.45, least_conf: float = 0, classes: Sequence[str] | None = None, agnostic: bool = False, most_in: int = 30_000, most_out: int = 300) -> DataFrame:
    """image, det, cls, conf of the boxes that stay. By confidence (ties: det), a box goes when its IoU with one that
    stays is above ``threshold``; within a class unless ``agnostic``. The caps are the detector's, by confidence.
    """
    shown = preds.where(F.col("conf") > least_conf)
    if classes is not None:
        shown = shown.where(F.col("cls").isin(*classes))
    keys = ["image"] if agnostic else ["image", "cls"]
    box = F.struct((-F.col("conf")).alias("neg"), "det", "x1", "y1", "x2", "y2").cast(_BOX)
    sorted_ = shown.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(box)), 1, most_in).alias("b"))

    def step(kept, x):
        def hit(k):
            inter = F.greatest(F.lit(0), F.least(k["x2"], x["x2"]) - F.greatest(k["x1"], x["x1"])) * F.greatest(F.lit(0), F.least(k["y2"], x["y2"]) - F.greatest(k["y1"], x["y1"]))
            area = lambda z: (z["x2"] - z["x1"]) * (z["y2"] - z["y1"])
            return inter > threshold * (area(k) + area(x) - inter)

        return F.when(F.exists(kept, hit), kept).otherwise(F.array_append(kept, x))

    kept = F.aggregate("b", F.array().cast(f"array<{_BOX}>"), step)
    rows = sorted_.select(*keys, F.inline(kept)).select("image", "det", (-F.col("neg")).alias("conf"), *[k for k in keys if k != "image"])
    ranked = rows.groupBy("image").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("neg"), "det"))), 1, most_out).alias("t"))
    return ranked.select("image", F.inline("t")).select("image", "det", (-F.col("neg")).alias("conf"))


_CAND = "struct<n:int,sym:int,words:int,width:bigint,x1:bigint,start:int,end:int,text:string>"


def non_overlapping(cands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cands: keys, start, end (word places, end exclusive), text, digits, symbol_only, width, x1 -> those that stay.

    More digits first, then fewer symbol-only words, fewer words, smaller width; then from left to right.
    """
    c = F.struct((-F.col("digits")).alias("n"), F.col("symbol_only").alias("sym"), (F.col("end") - F.col("start")).alias("words"), "width", "x1", "start", "end", "text").cast(_CAND)
    g = cands.groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias("c"))

    def step(kept, x):
        return F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.array_append(kept, x))

    return g.select(*keys, F.inline(F.aggregate("c", F.array().cast(f"array<{_CAND}>"), step))).select(*keys, "start", "end", "text", (-F.col("n")).alias("digits"), "x1")
