"""Near-duplicates by min-max hashing.

Each permutation gives two values of a document's shingle set, its minimum and its maximum, so that ``permutations``
evaluations a shingle make twice as many values. They are banded: documents that agree on all values of a band are
candidates. With 5 values a band and 32 bands, a pair at the threshold 0.8 meets with probability 1 - 3e-6.

Equal sets are folded into one node first. Candidates are never expanded into all pairs of a bucket:

1. Each bucket compares its members with one leader, the member that meets most others. Links that hold on the full
   sets are merged into components. A bucket whose members are all connected is done.
2. While it pays, those outside a bucket's largest component get a leader of their own.
3. What is left is decided by differences. Members of a leader's family are written as their difference from the
   leader: the shingles that they lack, and those that they have beyond it. For two members with ``o`` such differences
   in common, similarity of ``percent`` is the same as (100 + percent) * o >= W_a + W_b - (100 - percent) * |leader|,
   where W = 100 * lacking + percent * added. So a member must share so many differences with a partner that its rarest
   ones, up to a length that follows from W, hold one of them (a prefix filter). Families are joined on those alone,
   never within the component that has most of a difference's members. Which is exact: every candidate pair is
   connected already, or compared, or can't be a link.

Null and empty texts have no shingles and are linked with nothing. Rows are documents of their own, also where they
repeat an id; ``component_id`` is the smallest id among the rows that a row is connected with, null if none has an id.
``kept`` compares the ids; ``first`` is true for exactly one row of a component. Extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.arrays import NON_SPACE, U64, Texts, distinct, lists, mix, reduce_by
from gondola.llm.common import forget, materialize
from gondola.llm.components import components

_SKETCH = "doc_id bigint, h bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>"
SET = ["fp1", "fp2", "n_shingles"]


def _sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, owner, _ = t.words(NON_SPACE).shingles(k)
    s, at = distinct(h, owner, t.n)
    fp1 = reduce_by(np.add, mix(s + U64(1)), at, U64(0)).view(np.int64)
    fp2 = reduce_by(np.bitwise_xor, mix(s ^ U64(0x5DEECE66D1234567)), at, U64(0)).view(np.int64)
    return s, at, fp1, fp2


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h, n_shingles, fp1, fp2 (fingerprint of the set), bands (one key a band; null without shingles)."""
    permutations = -(-bands * rows // 2)
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, t in Texts.chunks(batch.column("text")):
                s, at, fp1, fp2 = _sets(t, k)
                x = (mix(s) >> U64(32)).astype(np.uint32)
                values = np.zeros((2 * permutations, t.n), np.uint32)
                for i in range(permutations):
                    p = x * a[i] + b[i]
                    values[2 * i] = reduce_by(np.minimum, p, at, np.uint32(0))
                    values[2 * i + 1] = reduce_by(np.maximum, p, at, np.uint32(0))
                keys = np.zeros((t.n, bands), U64)
                for i in range(bands):
                    key = np.full(t.n, i + 1, U64)
                    for j in range(rows):
                        key = mix(key * U64(0x9E3779B97F4A7C15) + values[i * rows + j])
                    keys[:, i] = key
                n = np.diff(at)
                full = n > 0
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
                same = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "h")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(n.astype(np.int64)), pa.array(fp1), pa.array(fp2), lists(keys[full].ravel().view(np.int64), ends, pa.int64())],
                    ["doc_id", "h", "n_shingles", "fp1", "fp2", "bands"],
                )

    return keyed(docs).mapInArrow(run, _SKETCH)


def _full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """c, s: the shingle sets of ``nodes`` (c, and doc_id and h of a row that has the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, t in Texts.chunks(batch.column("text")):
                s, at, _, _ = _sets(t, k)
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(lo, hi - lo), lists(s.view(np.int64), at, pa.int64())], ["c", "s"])

    wanted = nodes.select("c", F.col("doc_id").alias("id"), F.col("h").alias("hash")).hint("shuffle_hash")
    texts = keyed(docs).join(wanted, F.expr("doc_id <=> id AND h = hash"))
    # a row that repeats id and text gives its set once more
    return texts.select("c", "text").mapInArrow(run, "c bigint, s array<bigint>").groupBy("c").agg(F.first("s").alias("s"))


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (c, lead) -> also lead_n, w, d (differences from the lead; those added have their lowest bit as it is, those
    lacking are hashed again) and direct (similarity of ``percent`` or more).
    """
    with_c = pairs.join(sets.select("c", "s"), "c")
    both = with_c.join(sets.select(F.col("c").alias("lead"), F.col("s").alias("ls")), "lead")
    both = both.withColumns({"added": F.array_except("s", "ls"), "lacking": F.array_except("ls", "s")})
    w = (100 * F.size("lacking") + percent * F.size("added")).cast("bigint")
    d = F.concat("added", F.transform("lacking", lambda x: F.xxhash64(x)))
    out = both.select("c", "lead", F.size("ls").cast("bigint").alias("lead_n"), w.alias("w"), d.alias("d"))
    return out.withColumn("direct", F.col("w") <= (100 - percent) * F.col("lead_n"))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with ``comp``, the component of ``c``."""
    if labels is None:
        return rows.withColumn("comp", F.col("c"))
    known = labels.select(F.col("node").alias("c"), F.col("component"))
    return rows.join(known, "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")


def _by_differences(family: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """Links (a, b) between members of different components of one leader's family; see the module's text, 3."""
    q, size = 100 + percent, F.size("d").cast("bigint")
    now = _labelled(family, labels)
    mixed = now.groupBy("lead").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("lead")
    now = materialize(now.join(mixed, "lead", "left_semi").where("w > 0"))
    over = F.col("w") - (100 - percent) * F.col("lead_n")
    # how many of a member's rarest differences must hold a shared one: with a member beyond the leader's reach, with one inside
    sized = now.select("lead", "c", "comp", "direct", "w", "lead_n", size.alias("n"), "d").withColumns(
        {
            "short": F.col("n") - F.floor(F.col("w") / q),
            "long": F.when(F.col("direct"), F.lit(0)).otherwise(F.col("n") - F.greatest(F.ceil(over / 100), F.lit(1)) + 1),
        }
    )
    tokens = sized.select("lead", "c", F.explode("d").alias("x"))
    often = tokens.groupBy("lead", "x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = tokens.join(often, ["lead", "x"]).groupBy("lead", "c").agg(F.array_sort(F.collect_list(F.struct("f", "x"))).alias("xs"))
    # differences that nobody else has come first in a member's order
    place = F.posexplode(F.transform("xs", lambda s: s["x"])).alias("i", "x")
    cut = sized.drop("d").join(shared, ["lead", "c"]).withColumn("alone", F.col("n") - F.size("xs"))
    rows = cut.select("lead", "c", "comp", "direct", "w", "lead_n", "n", "short", "long", "alone", place).withColumn("i", F.col("i") + F.col("alone"))
    rows = materialize(rows.where(F.col("i") < F.greatest("short", "long")).withColumn("near", F.col("i") < F.col("short")).select("lead", "x", "c", "comp", "direct", "w", "lead_n", "n", "i", "near"))
    most = rows.groupBy("lead", "x", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("lead", "x").agg(F.max(F.struct("m", "comp")).alias("m"), F.count(F.lit(1)).alias("kinds"))
    few = rows.join(most.where("kinds > 1").select("lead", "x", F.col("m.comp").alias("main")), ["lead", "x"]).where("comp <> main")
    other = rows.select("lead", "x", *[F.col(v).alias(f"{v}2") for v in ("c", "comp", "direct", "w", "n", "i", "near")])
    enough = q * F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")) >= F.col("w") + F.col("w2") - (100 - percent) * F.col("lead_n")
    close = few.join(other, ["lead", "x"]).where("comp <> comp2 AND (direct OR direct2 OR (near AND near2)) AND (comp2 = main OR c < c2)").where(enough)
    pairs = materialize(close.select("lead", "c", "c2").distinct())
    of = lambda c, d: now.select("lead", F.col("c").alias(c), F.col("d").alias(d), F.col("w").alias(f"w{d}"), *(["lead_n"] if c == "c" else []))
    both = pairs.join(of("c", "d1"), ["lead", "c"]).join(of("c2", "d2"), ["lead", "c2"])
    common = F.size(F.array_intersect("d1", "d2"))
    found = both.where(q * common >= F.col("wd1") + F.col("wd2") - (100 - percent) * F.col("lead_n"))
    found = materialize(found.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b")).distinct())
    forget(now, rows, pairs)
    return found


def link(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, rounds: int = 6) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, kept, first for each row of ``docs``."""
    marks = materialize(sketch(docs, k, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "h")).alias("least")
    nodes = marks.where("n_shingles > 0").groupBy(*SET).agg(least, F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("c", F.monotonically_increasing_id()))
    banded = nodes.select("c", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    met = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    joined = materialize(banded.join(met.hint("merge"), "key"))
    degree = joined.groupBy("c").agg(F.sum("m").alias("degree"))
    members = materialize(joined.drop("m").join(degree, "c"))
    forget(joined)
    # the member that meets most others leads: the text that a group's copies were made from, if it is there
    best = F.min(F.struct((-F.col("degree")).alias("o"), "c", "n")).alias("lead")
    wanted = nodes.join(members.select("c").distinct(), "c", "left_semi").select("c", "least.doc_id", "least.h")
    sets = materialize(_full_sets(docs, wanted, k))
    first = members.groupBy("key").agg(best).select("key", F.col("lead.c").alias("lead"))
    pairs = members.join(first, "key").where("c <> lead").select("c", "lead").distinct()
    family = materialize(_compare(pairs, sets, percent))
    direct = lambda f: f.where("direct").select(F.col("c").alias("a"), F.col("lead").alias("b"))
    links, tables = direct(family), []
    labels = components(links)
    for turn in range(rounds):
        now = _labelled(members, labels)
        order = F.xxhash64("c", F.lit(turn)) if turn else -F.col("degree")
        parts = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(order.alias("o"), "c", "n")).alias("lead"))
        main = parts.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 2").select("key", "main.comp")
        left = parts.join(main.select("key", F.col("comp").alias("main")), "key").where("comp <> main")
        lead = left.groupBy("key").agg(F.min(F.struct("lead", "comp", "main")).alias("l")).select("key", F.col("l.lead.c").alias("lead"), F.col("l.lead.n").alias("lead_n"), F.col("l.comp").alias("lead_comp"), F.col("l.main").alias("main"))
        close = now.join(lead, "key").where("comp <> main AND comp <> lead_comp").where(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n"))
        pairs = materialize(close.select("c", "lead").distinct())
        tried = materialize(_compare(pairs, sets, percent).select("c", "lead", "direct"))
        count = tried.agg(F.count(F.lit(1)).alias("n"), F.count_if("direct").alias("found")).first()
        forget(pairs)
        tables.append(tried)
        if count["found"]:
            links = links.unionByName(direct(tried))
            forget(labels)
            labels = components(links)
        if count["found"] * 10 <= count["n"]:
            break
    last = _by_differences(family, labels, percent)
    if not last.isEmpty():
        links = links.unionByName(last)
        labels = components(links)
    named = _labelled(nodes.select("c", *SET, "least"), labels)
    whole = named.groupBy("comp").agg(F.min("least").alias("of"))
    classes = materialize(named.join(whole, "comp").select(*SET, "of.doc_id", "of.row"))
    forget(nodes, members, sets, family, last, *tables, sweep=True)
    rep = classes.select(*SET, F.col("doc_id").alias("component_id"), F.col("row").alias("first_row"))
    out = marks.drop("bands").join(rep.hint("merge"), SET, "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), (alone | (F.col("row") == F.col("first_row"))).alias("first"))
