"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; a document's expected number of copies is its source's target over the
source's size. Whole copies are certain; the fractions are rounded by the pivotal method: two fractions meet, one takes
mass from the other until one of them is integral, and the one that is left meets the next. Documents of a source are
dealt into blocks of about ``block_rows`` rows of like size (a hot source just has more blocks), each block leaves at
most one fraction, and what the blocks leave is combined by the same step, level after level, until each source has one
block. So the words taken stay within about a document of the target, nothing is gathered in one task, and all random
choices are hashes of ids and texts: reruns agree, and rows without ids spread over blocks. Built-in expressions only.

Null texts have size 0, take nothing and are returned. Null sources form one source, the last. Rows that repeat an id
are separate documents. Columns of ``docs`` other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import materialize, unit

UNIT = "struct<size:bigint,h:bigint,doc_id:bigint,p:double,row:bigint>"
DONE = "array<struct<size:bigint,doc_id:bigint,extra:int,row:bigint>>"


def targets(per_source: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size -> also target. Targets share the total by weight and stop at ``cap`` times the size.

    Filling to a common level: source i is full if, at the level where it fills, all targets still fit in the total.
    The table has a row a source, already summed.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "rank")
    all_rows, before = Window.partitionBy(), by_level.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    full = cap * F.col("source_size").cast("double")
    t = per_source.withColumn("rank", F.row_number().over(by_name)).withColumn("w", w).withColumn("level", full / F.col("w"))
    t = t.withColumns(
        {
            "total": F.sum("source_size").over(all_rows).cast("double"),
            "w_left": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
            "filled": F.coalesce(F.sum(full).over(before), F.lit(0.0)),
        }
    ).withColumn("is_full", F.col("filled") + F.col("level") * F.col("w_left") <= F.col("total"))
    open_w = F.sum(F.when(~F.col("is_full"), F.col("w"))).over(all_rows)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("is_full"), full)).over(all_rows), F.lit(0.0))
    t = t.withColumn("target", F.when(F.col("is_full"), full).otherwise(F.least(full, rest * F.col("w") / open_w)))
    return t.drop("rank", "w", "level", "total", "w_left", "filled", "is_full")


def _meet(acc: Column, u: Column, seed: int) -> Column:
    """One pivotal step: the carried unit meets ``u``; a unit that becomes integral goes to ``done``."""
    c, p, q = acc["carry"], u["p"], acc["carry"]["p"]
    s, r = p + q, unit(c["h"], u["h"], F.lit(seed))
    with_p = lambda x, v: F.struct(x["size"].alias("size"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), v.cast("double").alias("p"), x["row"].alias("row"))
    out = lambda x, v: F.array(F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), F.lit(v).alias("extra"), x["row"].alias("row")))
    state = lambda carry, done: F.struct(carry.cast(UNIT).alias("carry"), F.concat(acc["done"], done).cast(DONE).alias("done"))
    below = F.when(r < q / s, state(with_p(c, s), out(u, 0))).otherwise(state(with_p(u, s), out(c, 0)))
    above = F.when(r < (1 - p) / (2 - s), state(with_p(u, s - 1), out(c, 1))).otherwise(state(with_p(c, s - 1), out(u, 1)))
    even = F.when(r < q, state(F.lit(None), F.concat(out(c, 1), out(u, 0)))).otherwise(state(F.lit(None), F.concat(out(c, 0), out(u, 1))))
    return F.when(c.isNull(), state(u, F.array().cast(DONE))).when(F.abs(s - 1) < 1e-12, even).when(s < 1, below).otherwise(above)


def _fold(units: DataFrame, keys: list[str], seed: int) -> DataFrame:
    start = F.struct(F.lit(None).cast(UNIT).alias("carry"), F.array().cast(DONE).alias("done"))
    folded = units.groupBy(*keys).agg(F.array_sort(F.collect_list("u")).alias("us"))
    return folded.withColumn("f", F.aggregate("us", start, lambda a, u: _meet(a, u, seed))).drop("us")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, block_rows: int = 1000, seed: int = 1, text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (int) and taken (long) for each row of ``docs``.

    ``row``: a bigint column that tells rows without ids apart, returned as ``row``; nothing else depends on it, but
    which of the rows that agree in size and id takes which copies.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    sized = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("th"), (F.col(row) if row else F.lit(None)).cast("bigint").alias("row")))
    sized = sized.withColumn("class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    counts = sized.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    goals = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    plan = counts.alias("c").join(goals.alias("g"), F.expr("c.source <=> g.source")).select("c.*", "g.source_size", "g.target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select("source", "class", "source_size", "target", F.floor(ratio).cast("int").alias("base"), (ratio - F.floor(ratio)).alias("p"), F.ceil(F.col("n") / block_rows).alias("blocks"))
    rows = sized.alias("s").join(plan.alias("p"), F.expr("s.source <=> p.source AND s.class = p.class")).select("s.*", "p.source_size", "p.target", "p.base", "p.p", "p.blocks")
    fixed = ["source", "source_size", "target", "base"]
    whole = (F.col("p") == 0) | (F.col("size") == 0)
    taken = [rows.where(whole).select(*fixed, "size", "doc_id", F.lit(0).alias("extra"), "row")]
    h = F.xxhash64("doc_id", "th", F.lit(seed))
    units = rows.where(~whole).select(
        *fixed, "class", F.pmod(F.xxhash64("doc_id", "th", F.lit(seed + 1)), "blocks").alias("block"), F.struct("size", h.alias("h"), "doc_id", "p", "row").cast(UNIT).alias("u")
    )
    level, keys = 0, [*fixed, "class", "block"]
    while True:
        done = materialize(_fold(units, keys, seed + level))
        taken.append(done.select(*fixed, F.explode("f.done").alias("d")).select(*fixed, "d.size", "d.doc_id", "d.extra", "d.row"))
        left = done.where("f.carry IS NOT NULL").select(*fixed, F.col("f.carry").alias("u"), F.xxhash64(*keys).alias("at"))
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        blocks, level, keys = -(-most // block_rows), level + 1, [*fixed, "block"]
        units = left.select(*fixed, F.pmod(F.col("at"), F.lit(blocks)).alias("block"), "u")
    last = (unit(F.col("u.h"), F.lit(seed - 1)) < F.col("u.p")).cast("int")
    taken.append(left.select(*fixed, "u.size", "u.doc_id", last.alias("extra"), "u.row"))
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    copies = F.col("base") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"), *(["row"] if row else []))
