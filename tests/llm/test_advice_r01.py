"""Cases of the first review round."""

import numpy as np

import corpus_pipeline
from gondola.llm import compact_windows, fm_decontam, pii_weak, pivotal_mix


def test_spoken_addresses_in_square_brackets(spark):
    rows = [(1, "write to john [at] example [dot] com today"), (2, "write to john (at) example (dot) com today"), (3, "write to john [at] example [dot] com (today)"), (4, "no address")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cands = {r["doc_id"]: [(c["kind"], c["start"], c["end"]) for c in r["cands"]] for r in pii_weak.annotate(df).collect()}
    assert cands == {1: [("spoken", 9, 36)], 2: [("spoken", 9, 36)], 3: [("spoken", 9, 36)], 4: []}
    clean = {r["doc_id"]: r["text"] for r in pii_weak.redact(pii_weak.detect(df)).collect()}
    assert clean == {1: "write to <SPOKEN> today", 2: "write to <SPOKEN> today", 3: "write to <SPOKEN> (today)", 4: "no address"}


def test_decontamination_in_blocks_keeps_rows_with_null_and_repeated_ids(spark):
    long = " ".join(f"k{i}" for i in range(13)), " ".join(f"m{i}" for i in range(13))
    items = [("1", long[0]), ("2", long[1]), ("3", "zebra"), ("4", "alpha beta gamma")]
    rows = [(5, "zebra", "a"), (5, "clean words " * 30 + "zebra", "b"), (5, "nothing here", "c"), (None, "alpha beta gamma", "d"), (None, "clean", None), (None, None, "e"), (7, " ".join(long), "f"), (7, " ".join(long), "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for keep in (("doc_id",), ("doc_id", "text", "lang")):
        one, many = (sorted(map(str, fm_decontam.contamination(df, bench, block_mb=mb, keep=keep).collect())) for mb in (32, 1e-5))
        assert len(many) == len(rows) and one == many


def test_mixing_stage_keeps_rows_without_ids(spark):
    rows = [(i if i % 3 else None, f"w{i} " * (i % 20 + 1), "ab"[i % 2]) for i in range(300)] + [(None, "same text", "a")] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = pivotal_mix.mix(df).where("copies > 0").collect()
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    assert sum(r["doc_id"] is None for r in want) > 50
    key = lambda r: (r["doc_id"] or -1, r["source"], r["copies"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(r["taken"] == r["copies"] * len(r["text"].split()) for r in got)


def least_phrase(rng):
    """Five words whose shingle comes before all others under the first hash."""
    many = [" ".join(f"f{x}" for x in rng.integers(0, 1 << 30, 5)) for _ in range(20_000)]
    chunk = compact_windows.Texts.chunks(compact_windows.pa.array(many))
    token = np.concatenate([compact_windows._tokens(t)[0] for _, _, t in chunk])
    return many[int(np.argmin(compact_windows.mix(token ^ compact_windows.mix(np.full(1, 1, np.uint64)))))].split()


def test_passages_that_share_a_frequent_shingle_and_boilerplate(spark):
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    phrase, header, footer, rows = least_phrase(rng), words(80), words(80), []
    for i in range(20):
        # halves too short for windows of their own: all pairs meet under one hash value
        passage = words(40) + phrase + words(40)
        rows += [(2 * i + k, " ".join([*passage, f"end{i}{k}"])) for k in (0, 1)]
        passage = words(40) + phrase + words(40)
        rows += [(1000 + 2 * i + k, " ".join([*header, *passage, *footer, f"end{i}{k}"])) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in compact_windows.near_passages(df, pairs=1).collect()}
    assert {d for d, _ in rows} == set(got)
    assert all(r["n_repeated"] == r["n_words"] - 1 for r in got.values())


def test_windows_between_confirmed_spans_stay_open(spark):
    at = lambda m: (m << 32) | m
    members = spark.createDataFrame([(1, 7, at(m), 0) for m in (10, 50, 90)] + [(1, 8, at(10), 0)], "key bigint, t bigint, m bigint, w bigint")
    spans = spark.createDataFrame([(7, 0, 40), (7, 80, 120)], "t bigint, lo bigint, hi bigint")
    rows = compact_windows.open_windows(members, spans).collect()
    assert {(r["t"], r["m"] >> 32) for r in rows if r["open"]} == {(7, 50), (8, 10)}


def test_regions_of_two_passages_at_like_shifts(spark):
    hits = [(1, 2, m << 32, (lo << 32) | hi, (m + s) << 32, ((lo + s) << 32) | (hi + s)) for _ in (0, 1) for m, lo, hi, s in ((40, 10, 70, 17), (1030, 1000, 1060, 12))]
    df = spark.createDataFrame(hits, "a bigint, b bigint, ma bigint, wa bigint, mb bigint, wb bigint")
    got = sorted((r["a1"], r["a2"], r["b1"], r["b2"]) for r in compact_windows._regions(df).collect())
    assert got == [(10, 70, 27, 87), (1000, 1060, 1012, 1072)]


def test_passages_beyond_two_million_words(spark):
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(1, " ".join(map(str, range(2_100_000))) + " " + passage), (2, "x y z " + passage)]
    got = {r["doc_id"]: r["spans"] for r in compact_windows.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "2100000:2100100", 2: "3:103"}
