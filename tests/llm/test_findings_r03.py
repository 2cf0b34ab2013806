"""op3: texts that repeat a line, and windows that share a key but little else."""

from __future__ import annotations

import numpy as np

from gondola.llm import compact_windows


def test_a_line_repeated_in_a_text_is_one_member(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    rows = [(i, " ".join(words(60) + ["Is", "onhe."] * 1000)) for i in range(3)] + [(9, " ".join(words(300)))]
    texts = spark.createDataFrame(rows, "t bigint, text string")
    found = compact_windows.all_windows(texts, 4, 44, 50, 80).collect()
    # a window a place before, some 8,000 for each text
    assert sum(1 for r in found if r["t"] == 0) < 200
    assert [(r["m"], r["w"]) for r in found if r["own"] and r["t"] == 0] == [(60, 2060)]
    got = {r["doc_id"]: r["spans"] for r in compact_windows.near_passages(texts.toDF("doc_id", "text")).collect()}
    assert got == {i: "60:2060" for i in range(3)}


def test_sketches_hold_the_tokens_of_their_side():
    rng = np.random.default_rng(5)
    token, at = rng.integers(1, 1 << 63, 100, dtype=np.uint64), np.array([0, 40, 40, 100])
    back, ahead = compact_windows.sketched(token, at)
    bits = lambda x: int(np.bitwise_or.reduce(np.uint64(1) << (compact_windows.mix(x) >> np.uint64(58))))
    for a, z in ((0, 40), (40, 100)):
        for i in range(a, z):
            assert int(back[i]) == bits(token[max(a, i - 21) : i + 1]) and int(ahead[i]) == bits(token[i : min(z, i + 22)])


def test_a_place_nearest_to_itself_is_passed_over():
    x = np.array([1, 2] * 60, np.uint64)
    assert compact_windows.passages(x[:119], x[1:], 50, 80, 1)


def test_regions_compared_in_a_batch_have_the_passages_of_each_pair():
    rng = np.random.default_rng(6)
    pairs = []
    for i in range(400):
        x = [f"w{v}" for v in rng.integers(0, 40 if i % 7 == 0 else 1 << 40, int(rng.integers(3, 300)))]
        y = list(x)
        for _ in range(int(rng.integers(0, 10))):
            at, new = int(rng.integers(0, len(y))), [f"e{v}" for v in rng.integers(0, 1 << 40, int(rng.integers(0, 12)))]
            y[at : at + int(rng.integers(0, 3))] = new or ["e"]
        pairs.append((" ".join(x), " ".join(y)))
    pairs += [(pairs[0][0], y) for _, y in pairs[1:20]] + [("", "a b"), ("a", "a")]
    one, two = (compact_windows.pa.array(z) for z in zip(*pairs, strict=True))
    none = np.zeros(len(pairs), np.int64)
    got = compact_windows.compared(one, two, none, none > 0, 50, 80)

    def tokens(column):
        made = [(compact_windows._tokens(t), t.n) for _, _, t in compact_windows.Texts.chunks(column)]
        return [h[at[i] : at[i + 1]] for (h, at), n in made for i in range(n)]

    want = [(i, *p) for i, (x, y) in enumerate(zip(tokens(one), tokens(two), strict=True)) for p in compact_windows.passages(x, y, 50, 80)]
    assert len(want) > 100 and sorted(map(tuple, got.tolist())) == sorted(want)


def test_keys_and_pairs_that_go_through_many_batches(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "3")
    try:
        rows = [(k, t, t % 3, 5, False) for k in range(6) for t in range(k)] + [(9, 4, 4, 4, False)] * 8 + [(8, t % 2, 1, 1, False) for t in range(8)] + [(7, 1, 2, 3, True)] * 2
        rows += [(1, 50, 0, 9, True)]
        got = compact_windows.colliding(spark.createDataFrame(rows, "key bigint, t bigint, m bigint, w bigint, own boolean")).collect()
        want = {r for r in rows if r[4] or len({x[1:3] for x in rows if x[0] == r[0] and not x[4]}) > 1}
        assert want <= set(map(tuple, got)) and {r["key"] for r in got} - {r[0] for r in want} <= {1}
        hits = [(a, a + 1, (10 * i) << 32, ((10 * i) << 32) | (10 * i + 40), (10 * i) << 32, ((10 * i) << 32) | (10 * i + 40)) for a in range(5) for i in range(20)]
        got = compact_windows._regions(spark.createDataFrame(hits, "a bigint, b bigint, ma bigint, wa bigint, mb bigint, wb bigint")).collect()
        assert sorted(map(tuple, got)) == [(a, a + 1, 0, 230, 0, 230) for a in range(5)]
    finally:
        spark.conf.set(conf, before)


def test_shuffle_files_go_after_each_step(spark, monkeypatch):
    called = []
    monkeypatch.setattr(compact_windows, "let_go", lambda s: called.append(s), raising=False)
    compact_windows.near_passages(spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"))
    assert len(called) >= 9


def test_words_are_counted_as_the_pattern_does(spark):
    rows = [(i, i, t) for i, t in enumerate(["", " ", "a", "a b", " a\tb\n c ", "ä ö ü", "x" * 50, "a\x0bb\x0cc\rd", "end "])]
    got = compact_windows.word_counts(spark.createDataFrame(rows, "doc_id bigint, t bigint, text string")).collect()
    assert {r["doc_id"]: r["n_words"] for r in got} == dict(enumerate([0, 0, 1, 2, 3, 2, 1, 4, 1]))
