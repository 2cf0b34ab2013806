"""Five stages from raw documents to a training mix; each stage's rows are written and read back as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import fm_decontam, minmax_dedup, pii_weak, pivotal_mix, quality_classifier
from gondola.llm.common import forget, materialize, packed, table


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model calls good with probability 1/2 or more.

    Rows are judged one by one, whatever their ids. Null and empty texts go. Without any rating, all texts with words stay.
    """
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    inner, whole = packed(docs, "doc_id", "text")
    return whole(quality_classifier.select_good(inner, model))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five words a shingle, similarity 0.8 or more).

    Rows are documents: rows of one id with different texts are judged apart, and of a group without ids one row stays.
    Of rows that agree in id and text, the least in the other columns stays. Texts without words are copies of nothing.
    """
    inner, whole = packed(docs, "doc_id", "text")
    key = {"key_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "key_null": F.col("doc_id").isNull(), "key_h": F.xxhash64("text")}
    groups = minmax_dedup.link(docs.select("doc_id", "text"))
    named = groups.where("first AND n_shingles > 0").select(F.coalesce("doc_id", F.lit(0)).alias("key_id"), F.col("doc_id").isNull().alias("key_null"), F.col("h").alias("key_h"))
    named = materialize(named)
    others = [c for c in inner.columns if c != "text"]
    # the join deals the texts out by this key, and the grouping needs no other order
    one = inner.withColumns(key).join(named.hint("shuffle_hash"), list(key), "left_semi").groupBy(*key).agg(F.min(F.struct(*others, "text")).alias("d"))
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return whole(one.select("d.*").select(*inner.columns).unionByName(inner.where(~some)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in benchmark phrases.

    Rows are judged one by one, whatever their ids; null and empty texts stay, as does all without a benchmark.
    """
    inner, whole = packed(docs, "doc_id", "text")
    found = fm_decontam.contamination(inner, table(spark, sf_dir, "benchmark"), keep=tuple(inner.columns))
    return whole(found.where(~F.col("contaminated")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by the kind of data; null texts stay null, and ids play no part."""
    own = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    inner, whole = packed(docs, *own)
    clean = pii_weak.redact(pii_weak.detect(inner))
    if "n_chars" in own:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole(clean)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies and taken words.

    Rows are numbered for it, so that each has its own copies, with or without an id. Null sources form one source;
    texts without words have size 0 and are taken only where whole copies are due. Columns of these two names that are
    there already are replaced.
    """
    own = ("doc_id", "text", "source")
    inner, whole = packed(docs, *own)
    numbered = materialize(inner.withColumn("row", F.monotonically_increasing_id()))
    taken = materialize(pivotal_mix.mix(numbered, row="row").where("copies > 0").select("row", F.struct("copies", "taken").alias("mix")))
    mixed = numbered.join(taken.hint("shuffle_hash"), "row")
    return whole(mixed, copies=F.col("mix.copies"), taken=F.col("mix.taken"))


STAGES = [
    ("quality_classifier", rate_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: Training, components and rounding can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
