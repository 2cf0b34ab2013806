"""Every stage and query on documents whose other columns have the names that operators use inside."""

import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gondola.llm import queries

SF = "/root/testdata/sf0.001"
NAMES = (
    "items spans n_words n_hit n_items contaminated base cands added copies taken __row __id __null __h __w __l row key h c k d n "
    "rest mix first kept component_id n_shingles grade size source_size target key_id key_null key_h rules gram m0 _row item a.b x`y"
).split()
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/documents"
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").write.parquet(path)
    return spark.read.parquet(path)


def wide(df):
    return df.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(name) for i, name in enumerate(NAMES)])


def rows(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, docs, name):
    plain, clash = STAGES[name](spark, docs, SF), STAGES[name](spark, wide(docs), SF)
    mixed = {"copies", "taken"} if name == "mixing" else set()
    assert rows(clash, docs.columns) == rows(plain, docs.columns)
    assert rows(clash, mixed) == rows(plain, mixed)
    assert [c for c in clash.columns if c not in mixed] == [c for c in wide(docs).columns if c not in mixed]
    for i, column in enumerate(NAMES):
        if column not in mixed:
            assert all(r[column] == f"{i}:{r['doc_id']}" for r in clash.collect())


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op2_minmax_near_dedup", "op4_fm_decontamination", "op5_rule_ledger", "op7_pivotal_mix", "op8_bwt_dedup", "op9_weak_pii", "op10_license_scan", "op12_secret_scan"])
def test_query(spark, name):
    folder = tempfile.mkdtemp(prefix="spark-")
    for table in ("labels", "benchmark"):
        shutil.copy(f"{SF}/{table}.parquet", f"{folder}/{table}.parquet")
    wide(spark.read.parquet(f"{SF}/documents.parquet")).write.parquet(f"{folder}/documents.parquet")
    plain, clash = queries.QUERIES[name](spark, SF), queries.QUERIES[name](spark, folder)
    assert plain.columns == clash.columns and sorted(map(str, plain.collect())) == sorted(map(str, clash.collect()))


def test_one_id_in_many_rows_does_not_reach_the_driver(spark):
    from gondola.llm import quality_classifier

    some = spark.createDataFrame([(1, "good words here. " * 9), (2, "bad"), (3, "so so")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    many = some.unionByName(some.where("doc_id = 2").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("i"))
    a, b = quality_classifier.fit(some, labels), quality_classifier.fit(many, labels)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_blocks_of_a_benchmark_without_ids(spark):
    from gondola.llm import fm_decontam

    words = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(40)]
    bench = spark.createDataFrame([(None if i % 2 else i // 4, w) for i, w in enumerate(words)] * 3, "item_id long, text string")
    some = spark.createDataFrame([(i if i % 3 else None, f"here {w} there") for i, w in enumerate(words)] * 2, "doc_id long, text string")
    one = fm_decontam.digest(fm_decontam.contamination(some, bench))
    many = fm_decontam.digest(fm_decontam.contamination(some, bench, block_mb=0.001))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
