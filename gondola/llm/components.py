"""Connected components of a large undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import forget, materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component): each node that has an edge, and the smallest node it is connected with.

    Alternating large-star and small-star rounds: nodes pass on the smallest node that they know, never a list of
    their neighbours, and a hub's minimum is combined before the shuffle. Each round is a table in the shared folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, last = materialize(pairs), None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, pairs = pairs, materialize(small.where("u <> v").distinct())
        forget(before)
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last or not state["n"]:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    out.scratch_path = pairs.scratch_path
    return out
