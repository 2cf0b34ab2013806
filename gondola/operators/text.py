"""OCR words to codes: windows, candidates, passes, legacy boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions import codes


def text_boxes(words: DataFrame, sku: Column) -> DataFrame:
    """Words that spell ``sku`` alone, with the next, or between both neighbours; the box spans the words used."""
    w = Window.partitionBy("image").orderBy("idx")
    n = words.withColumns({"nxt": F.lead("text").over(w), "prv": F.lag("text").over(w), "nx2": F.lead("x2").over(w), "px1": F.lag("x1").over(w)})
    span = F.when(F.col("text") == sku, 1).when(F.concat("text", "nxt") == sku, 2).when(F.concat("prv", "text", "nxt") == sku, 3)
    n = n.withColumn("span", span).where("span IS NOT NULL")
    return n.select("image", "idx", "span", F.when(F.col("span") == 3, F.col("px1")).otherwise(F.col("x1")).alias("x1"), F.when(F.col("span") == 1, F.col("x2")).otherwise(F.col("nx2")).alias("x2"))


def windows(words: DataFrame, keys: Sequence[str], most: int = 4) -> DataFrame:
    """Candidates from 1 to ``most`` neighbouring words: keys, start, end, raw, text, digits, symbol_only, width, x1."""
    w = Window.partitionBy(*keys).orderBy("idx")
    word = F.struct("text", "x1", "x2", "y1")
    # a word and those after it, from one window; its candidates are the beginnings of that list
    ahead = F.filter(F.array(word, *[F.lead(word, k).over(w) for k in range(1, most)]), lambda x: x.isNotNull())
    n = words.select(*keys, (F.row_number().over(w) - 1).alias("start"), ahead.alias("ahead"))
    out = n.select(*keys, "start", F.explode(F.transform(F.sequence(F.lit(1), F.size("ahead")), lambda k: F.slice("ahead", 1, k))).alias("p"))
    each = lambda c: F.transform("p", lambda x: x[c])
    texts = each("text")
    out = out.select(
        *keys, "start", (F.col("start") + F.size("p")).alias("end"), F.array_join(texts, " ").alias("raw"), F.size(F.filter(texts, lambda t: ~t.rlike("[0-9]"))).alias("symbol_only"),
        *[f(each(c)).alias(c) for c, f in (("x1", F.array_min), ("x2", F.array_max), ("y1", F.array_min))],
    )
    c = out.withColumn("text", codes.sku_candidate(F.col("raw"))).where("text IS NOT NULL")
    return c.select(*keys, "start", "end", "raw", "text", F.length("text").alias("digits"), "symbol_only", (F.col("x2") - F.col("x1")).alias("width"), "x1", "y1")


def lines_of(full_text: Column, texts: Column) -> Column:
    """The line of the full text that each word stands in, words taken in order; -1 for one that can't be found on.

    A fold over the words: the search goes on from where the last word was found.
    """
    init = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(a, w):
        spot = F.call_function("locate", w, full_text, a["at"])
        line = F.length(F.substring(full_text, F.lit(1), spot)) - F.length(F.translate(F.substring(full_text, F.lit(1), spot), "\n", ""))
        return F.struct(F.when(spot > 0, spot + F.length(w)).otherwise(a["at"]).cast("int").alias("at"), F.array_append(a["out"], F.when(spot > 0, line).otherwise(-1).cast("int")).alias("out"))

    return F.aggregate(texts, init, step, lambda a: a["out"])


def free_segments(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words that are no whole ten-digit code, with ``segment``: how many of those stand before (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy("idx")
    locked = F.coalesce(F.length(codes.sku_candidate(F.col("text"))) == 10, F.lit(False))
    return words.withColumn("locked", locked).withColumn("segment", F.sum(F.col("locked").cast("int")).over(w))


def best_pass(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """reads: keys, pass (order), text, source -> for each text the best read by (digits, source priority), first on ties."""
    digits = F.when(F.col("text").rlike("^[0-9]+$"), F.length("text")).otherwise(0)
    rank = F.struct((-digits).alias("d"), codes.source_priority(F.col("source")).alias("p"), "pass", "source")
    return reads.groupBy(*keys, "text").agg(F.min(rank).alias("r")).select(*keys, "text", (-F.col("r.d")).alias("digits"), F.col("r.pass").alias("pass"), F.col("r.source").alias("source"))


def until_strong(passes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Passes up to and including the first strong one. passes: keys, pass, strong."""
    before = Window.partitionBy(*keys).orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    return passes.withColumn("seen", F.coalesce(F.max("strong").over(before), F.lit(False))).where("NOT seen").drop("seen")


def legacy_codes(lines: DataFrame) -> DataFrame:
    """lines: image, line, text -> image, line, pos, sku, how: the vendor code of a line that is one as a whole, then its
    words in order, each with its own code or with what can be recovered from it. Words that repeat the line's vendor
    code give nothing; ``how`` is vendor, word or recovered.

    A vendor code is the line without dashes, spaces and SKU#; where that has neither six nor ten characters, the same
    of all words but the first.
    """
    t = F.col("text")
    bare = lambda x: F.replace(F.replace(F.replace(x, F.lit("-"), F.lit("")), F.lit(" "), F.lit("")), F.lit("SKU#"), F.lit(""))
    words = F.split(t, " ")
    code = lambda c, how: F.struct(c.alias("sku"), F.lit(how).alias("how"))
    none = F.array().cast("array<struct<sku:string,how:string>>")
    vendor = F.when(t.rlike(codes.VENDOR_CODES), F.when(F.length(bare(t)).isin(6, 10), bare(t)).otherwise(bare(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), ""))))
    v = lines.select("image", "line", words.alias("words"), F.nullif(vendor, F.lit("")).alias("vendor"))
    other = lambda c: ~c.eqNullSafe(F.col("vendor"))
    own = lambda w: F.when(other(codes.digits(w)), F.array(code(codes.digits(w), "word"))).otherwise(none)
    saved = lambda w: F.transform(F.filter(codes.recovered(w), other), lambda c: code(c, "recovered"))
    each = F.flatten(F.transform("words", lambda w: F.when(w.rlike(codes.ITEM_CODES), own(w)).otherwise(saved(w))))
    found = F.concat(F.when(F.col("vendor").isNotNull(), F.array(code(F.col("vendor"), "vendor"))).otherwise(none), each)
    return v.select("image", "line", F.posexplode(found).alias("pos", "c")).select("image", "line", "pos", "c.sku", "c.how")
