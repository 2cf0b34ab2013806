"""Nulls, repeats, ties, empty tables and clashing columns, for the pipeline's stages and near-duplicates."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from gondola.llm import fm_decontam, minmax_dedup

SF = "/root/testdata/sf0.001"


def turned(n):
    """Words of two letters that a polynomial modulo 2^64 can't tell apart when they are swapped."""
    bits = "0"
    while len(bits) < n:
        bits += "".join("10"[int(b)] for b in bits)
    return bits[:n].translate(str.maketrans("01", "ab")), bits[:n].translate(str.maketrans("01", "ba"))


def test_words_that_polynomials_confuse_stay_apart(spark):
    a, b = turned(1024)
    rows = [(1, a), (2, b), (3, a)]
    got = {r["doc_id"]: r["component_id"] for r in minmax_dedup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    found = fm_decontam.contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("x", a)], "item_id string, text string")).collect()
    assert {r["doc_id"]: r["n_hit"] for r in found} == {1: 1, 2: 0, 3: 1}


def test_near_dedup_rows_are_documents(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    near = text("b") + " more"
    rows = [(3, text("b")), (7, text("b")), (7, text("a")), (60, text("a")), (None, near), (None, text("z")), (None, text("z") + " end"), (8, "x " * 200_000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, c bigint, row bigint")
    got = minmax_dedup.link(df, k=2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (0, 0, True), (0, 3, False), (3, 3, True), (7, 3, False), (7, 7, True), (8, 8, True), (60, 7, False),
    ]
    assert sorted(r["component_id"] or 0 for r in got if r["first"]) == [0, 3, 7, 8]


def test_families_beyond_their_leader(spark):
    """Members that the leader doesn't reach are linked with each other, or with members that it reaches."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(240):
        w, edits = list(base), (i % 12) * 6
        for j in range(edits):
            # a small vocabulary, at places that some share: differences in common
            w[(j * 7 + (i % 5) * 3) % 300] = f"x{(i % 4)}_{j % 9}"
        rows.append((i, " ".join(w + [f"end{i}"])))
    from tests.llm.test_against_brute_force import groups, shingles

    for k in (2, 5):
        got = {r["doc_id"]: r["component_id"] for r in minmax_dedup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), k=k).collect()}
        assert got == groups({d: shingles(t, k) for d, t in rows})


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def long_text(seed):
    return " ".join(f"{seed}{i * 7919 % 1000} and of the" for i in range(40))


def test_stages_on_null_and_repeated_ids(spark):
    a, b = long_text("a"), long_text("b")
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, b + " x", "en", None, 3), (None, a, "de", "s", 4), (None, long_text("q"), "de", None, 5), (None, long_text("q"), "de", "t", 5), (5, None, None, None, None), (5, None, None, None, None), (6, "", "en", "t", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, df, SF).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:1], r["n_chars"] or 0) for r in kept) == [(0, "q", 5), (1, "a", 1), (1, "b", 2), (5, "", 0), (5, "", 0), (6, "", 0)]
    assert len(corpus_pipeline.drop_contaminated(spark, df, SF).collect()) == len(rows)
    clean = corpus_pipeline.redact_personal_data(spark, df.withColumn("text", F.concat("text", F.lit(" a@b.co"))), SF).collect()
    assert len(clean) == len(rows) and sum(r["text"] is None for r in clean) == 2
    assert all(r["text"] is None or r["text"].endswith(" <EMAIL>") for r in clean)
    mixed = corpus_pipeline.mix_sources(spark, df, SF).collect()
    assert all(r["taken"] == r["copies"] * len(re.findall(r"\S+", r["text"] or "")) for r in mixed)
    rated = corpus_pipeline.rate_quality(spark, df, SF)
    assert rated.columns == df.columns and all(r["text"] for r in rated.collect())


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_recall_of_near_passages(spark):
    """Planted pairs at three similarities, each once in the corpus; brute force knows them by construction."""
    import numpy as np

    from gondola.llm import compact_windows

    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows, kind = [], {}
    for edits in (2, 3, 4):  # similarity 0.90, 0.86, 0.82
        for _ in range(40):
            passage = words(200)
            other = list(passage)
            for i in range(edits):
                other[20 + i * 160 // edits + int(rng.integers(0, 20))] = words(1)[0]
            for p in (passage, other):
                kind[len(rows)] = edits
                rows.append((len(rows), " ".join(words(40) + p + words(int(rng.integers(20, 60))))))
    got = {r["doc_id"]: r for r in compact_windows.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for edits, least in ((2, 0.97), (3, 0.95), (4, 0.9)):
        ids = [d for d, k in kind.items() if k == edits]
        assert np.mean([d in got and got[d]["n_repeated"] >= 180 for d in ids]) >= least, edits
    assert all(r["n_repeated"] <= 205 for r in got.values())
