"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gondola.llm import bwt_dedup, compact_windows, conversation_repair, fm_decontam, license_scan, minmax_dedup, pii_weak, pivotal_mix, quality_classifier, rule_ledger, secret_scan, url_lm, whitening
from gondola.llm.common import materialize, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.link(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))


def op4_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontam.digest(fm_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "fail_mask")


def op6_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.filter_urls(table(spark, sf_dir, "pages"))


def op7_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_weak.annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "base", "cands")
    found = materialize(found)  # offsets and votes only, no text
    return pii_weak.digest(pii_weak.decide(found, pii_weak.fit(found)))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(conversation_repair.prepare(*conversation_repair.damage(table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_minmax_near_dedup, op3_compact_windows, op4_fm_decontamination, op5_rule_ledger, op6_url_language_models, op7_pivotal_mix, op8_bwt_dedup, op9_weak_pii, op10_license_scan, op11_embedding_whitening, op12_secret_scan, op13_conversation_repair)
}
