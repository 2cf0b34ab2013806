"""Anchor boxes for a detector, from the widths and heights of labels."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_anchors(boxes: DataFrame, k: int, ratio: float = 4.0, seed: int = 7) -> DataFrame:
    """anchor, w, h, n (boxes nearest to it), recall (share of those whose sides differ by less than ``ratio``)."""
    wh = boxes.select((F.col("x2") - F.col("x1")).cast("double").alias("w"), (F.col("y2") - F.col("y1")).cast("double").alias("h")).where("w > 0 AND h > 0")
    s = wh.agg(F.stddev_pop("w").alias("w"), F.stddev_pop("h").alias("h")).first()
    sw, sh = s["w"] or 1.0, s["h"] or 1.0
    x = VectorAssembler(inputCols=["sw", "sh"], outputCol="features").transform(wh.withColumns({"sw": F.col("w") / sw, "sh": F.col("h") / sh}))
    model = KMeans(k=k, seed=seed, predictionCol="anchor").fit(x)
    centres = boxes.sparkSession.createDataFrame([(i, float(c[0] * sw), float(c[1] * sh)) for i, c in enumerate(model.clusterCenters())], "anchor int, aw double, ah double")
    near = model.transform(x).join(F.broadcast(centres), "anchor")  # k rows
    worst = F.greatest(F.col("w") / F.col("aw"), F.col("aw") / F.col("w"), F.col("h") / F.col("ah"), F.col("ah") / F.col("h"))
    g = near.groupBy("anchor").agg(F.first("aw").alias("w"), F.first("ah").alias("h"), F.count(F.lit(1)).alias("n"), F.round(F.avg((worst < ratio).cast("int")), 6).alias("recall"))
    return g.select("anchor", F.round("w", 4).alias("w"), F.round("h", 4).alias("h"), "n", "recall")
