"""op3: parts of texts that differ elsewhere, and windows of a key that share too little."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gondola.llm import compact_windows
from gondola.llm.compact_windows import U64


def variants(rng, n, words, share):
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in np.flatnonzero(rng.random(words) < share)[::-1].tolist():
            text[at : at + 1] = ([], [f"e{rng.integers(0, 1 << 40)}"], [text[at], f"e{rng.integers(0, 1 << 40)}"])[int(rng.integers(0, 3))]
        out.append(" ".join(text))
    return out


def tokens(texts):
    made = [compact_windows._tokens(t) for _, _, t in compact_windows.Texts.chunks(pa.array(texts))]
    return [h[x:y] for h, at in made for x, y in zip(at[:-1], at[1:], strict=True)]


def test_all_parts_that_are_alike_enough_are_found():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        m, q = np.cumsum(rng.integers(1, 4, n)), np.cumsum(rng.integers(1, 4, n)) + 9
        if rng.random() < 0.3:
            q[int(rng.integers(0, n)) :] -= int(rng.integers(0, 20))
        want = np.zeros(n, bool)
        for i in range(n):
            for j in range(i, n):
                if (np.diff(q[i : j + 1]) <= 0).any():
                    break
                both = j - i + 1
                if min(m[j] - m[i], q[j] - q[i]) + 5 >= 12 and 100 * both >= 80 * (m[j] - m[i] + q[j] - q[i] + 2 - both):
                    want[i : j + 1] = True
        got = np.zeros(n, bool)
        for i, j in compact_windows.alike(m, q, 12, 80):
            assert not got[i : j + 1].any()
            got[i : j + 1] = True
        assert (got == want).all()


def test_a_good_part_beside_many_edits_is_a_passage():
    words = [f"w{i}" for i in range(300)]
    # every tenth word is another one, but in 60 words
    other = [w if 100 <= i < 160 or i % 10 else f"e{i}" for i, w in enumerate(words)]
    other[130] = "x"
    x, y = tokens([" ".join(words), " ".join(other)])
    (x1, x2, y1, y2) = compact_windows.passages(x, y, 50, 80)[0]
    assert x1 <= 101 and x2 + 5 >= 159 and (y1, y2) == (x1, x2)


def test_spans_of_texts_that_differ_in_places(spark):
    rng = np.random.default_rng(2)
    texts = variants(rng, 40, 200, 0.035)
    own = tokens(texts)
    want = [np.zeros(len(t.split()), bool) for t in texts]
    for i, x in enumerate(own):
        for j, y in enumerate(own):
            for x1, x2, _, _ in compact_windows.passages(x, y, 50, 80) if i != j else ():
                want[i][x1 : x2 + 5] = True
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    missed = {i: set(np.flatnonzero(w).tolist()) for i, w in enumerate(want)}
    for r in compact_windows.near_passages(rows).collect():
        for span in r["spans"].split(","):
            low, high = map(int, span.split(":"))
            missed[r["doc_id"]] -= set(range(low, high))
    assert sum(w.sum() for w in want) > 5000
    assert sum(map(len, missed.values())) < 0.03 * sum(w.sum() for w in want)


def judged(texts, places):
    width = 44
    made = [compact_windows._tokens(t) for _, _, t in compact_windows.Texts.chunks(pa.array(texts))]
    assert len(made) == 1
    token, at = made[0]
    of = np.arange(len(texts))
    c, d = (np.array(z) for z in zip(*places, strict=True))
    back, ahead = compact_windows.sketched(token, at)
    near = compact_windows.contexts(token, at, of, c, width)
    row = np.stack([np.zeros(len(of), np.int64), of, (c << 32) | d, of, of >= 0, back[at[of] + d].view(np.int64), ahead[at[of] + c].view(np.int64)])
    return {(int(i), int(j)) for u, v, _ in compact_windows.near_pairs(row, near, width, 50, 80) for i, j in zip(u, v, strict=True)}


def test_windows_with_a_passage_around_them_are_judged_alike():
    rng = np.random.default_rng(3)
    texts = variants(rng, 60, 140, 0.03)
    own = tokens(texts)
    for at in (30, 70, 100):
        token = own[0][at]
        some = [i for i, x in enumerate(own) if np.count_nonzero(x == token) == 1]
        place = [int(np.flatnonzero(own[i] == token)[0]) for i in some]
        got = judged([texts[i] for i in some], [(p, p) for p in place])
        sketch = [compact_windows.sketched(own[i], np.array([0, len(own[i])])) for i in some]
        n = 0
        for u, i in enumerate(some):
            for v, j in enumerate(some[u + 1 :], u + 1):
                x, y = own[i][max(0, place[u] - 48) : place[u] + 92], own[j][max(0, place[v] - 48) : place[v] + 92]
                p = min(place[u], 48)
                if any(x1 <= p <= x2 for x1, x2, _, _ in compact_windows.passages(x, y, 50, 80)) and any(
                    int(np.bitwise_count(sketch[u][s][place[u]] & sketch[v][s][place[v]])) >= compact_windows.COMMON for s in (0, 1)
                ):
                    assert (u, v) in got
                    n += 1
        assert n > 20


def test_a_common_line_alone_brings_no_windows_together():
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    line = words(25)
    assert not judged([" ".join(words(60) + line + words(60)) for _ in range(80)], [(68, 70)] * 80)
    assert not judged([" ".join(["that"] * 200 + line + words(60)), " ".join(words(200) + line)], [(208, 210)] * 2)
    assert not len(compact_windows.contexts(np.zeros(0, U64), np.zeros(2, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 44))


def test_keys_of_many_batches_are_judged_whole(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    rng = np.random.default_rng(5)
    text = " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 120))
    bodies = spark.createDataFrame([(t, text + f" e{t}") for t in range(9)], "t bigint, text string")
    rows = [(k, t, (50 << 32) | 52, (40 << 32) | 70, t > 2) for k in range(5) for t in range(k)] + [(7, t, 60 << 32 | 61, 50 << 32 | 80, False) for t in range(9)]
    members = spark.createDataFrame(rows, "key bigint, t bigint, m bigint, w bigint, open boolean")
    spark.conf.set(conf, "3")
    try:
        near = compact_windows._contexts(bodies, members, 44)
        for best in (False, True):
            got = compact_windows._judged(near, 44, 50, 80, best).collect()
            pairs = {(r["key"], *sorted((r["t"], r["t2"]))) for r in got}
            assert {p[0] for p in pairs} == {4} and len(got) == (1 if best else 3)
            assert all((r["w"], r["w2"]) == ((2 << 32) | 141,) * 2 for r in got)
    finally:
        spark.conf.set(conf, before)
