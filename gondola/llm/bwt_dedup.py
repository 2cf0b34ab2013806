"""Exact removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if some ``length``-byte string that covers it also starts anywhere else, in the same document or another.

Equal strings must meet in one place without sorting the corpus in one place. Every ``length``-byte string is keyed by
the smallest hash among its ``gram``-byte strings; equal strings have equal keys, and neighbouring strings mostly share
one, so that they travel as segments. A key that one segment has can't repeat. For keys with several:
- segments with equal bytes are folded, with their number: a content that occurs twice repeats as a whole;
- where a key has several contents, shards of them are sorted as one text of segments. On the shard's transform,
  string intervals are extended backwards, breadth first: all strings of one length, then the next. An interval's right
  end gets its common-prefix value the first time that it appears, so values come in increasing order, and the search
  stops at ``length``: neighbours that have no value by then share ``length`` bytes or more. No prefix array is made;
- a key with more contents than a shard takes (a phrase that very many documents share) is split first. All strings of
  a key hold its gram, and those that hold it at nearly the same place also have the bytes around it in common. So the
  strings are divided by the place of the gram into ranges, and keyed anew by the bytes that all strings of the range
  cover: equal strings still meet. Folding and transforms then go on as above; what is still too large is divided into
  narrower ranges, down to single strings, which only equal ones can join.

Texts are UTF-8 bytes; null texts are empty, and texts under ``length`` bytes lose nothing. Rows are documents, also if
they repeat an id or a text (then both copies repeat). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.arrays import BASE, U64, Texts, mix
from gondola.llm.common import forget, materialize

PIECE = 1 << 22
#: A segment has fewer strings than this.
STRINGS = 1 << 15
INVERSE = pow(BASE, -1, 1 << 64)


def _power(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class _Rolling:
    """Hashes of any stretch of eight bytes or more: a polynomial over mixed eight-byte strings, not over bytes."""

    def __init__(self, data: np.ndarray):
        n = max(0, len(data) - 7)
        eight = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)) if n else np.zeros(0, U64)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(mix(eight ^ U64(BASE)) * _power(BASE, n), out=self.sums[1:])
        self.inverse = _power(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end - 7] - self.sums[start]) * self.inverse[start])

    def all(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - (size - 7))
        return mix((self.sums[size - 7 :] - self.sums[:n]) * self.inverse[:n])


def _segments(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, key, content, start, number of strings and place of the gram in the first) of each segment; starts are
    within the text, and the last two are packed in one number (see ``STRINGS``).
    """
    none = (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    size = np.diff(at)
    if not len(data) or size.max() < length:
        return none
    roll = _Rolling(data)
    grams = roll.all(gram)
    least = (grams & ~U64(0xFFFFFF)) | np.arange(len(grams), dtype=U64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    where = (least & U64(0xFFFFFF)).astype(np.int64)
    inside = np.zeros(len(where) + 1, np.int64)
    long = size >= length
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, (at[1:] - length + 1)[long], -1)
    valid = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    w = where[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (w[1:] != w[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(valid)))
    start, m = valid[first], w[first]
    content = mix(roll.of(start, start + count + length - 1) + mix((m - start).astype(U64) * U64(1 << 20) + count.astype(U64)))
    text = np.searchsorted(at, start, "right") - 1
    return text, grams[m], content, start - at[text], (m - start) * STRINGS + count


def _pieces(t: Texts, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, offset, bytes, limits): a text beyond PIECE goes in pieces that overlap, every string in one."""
    if t.n == 1 and len(t.data) > PIECE:
        for a in range(0, len(t.data) - length + 1, PIECE):
            d = t.data[a : a + PIECE + length - 1]
            yield 0, a, d, np.array([0, len(d)])
    else:
        yield 0, 0, t.data, t.at


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """d, h (name the text), key, content, start, n for all segments of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, h = b.column("d").to_numpy(), b.column("h").to_numpy()
            for lo, _, t in Texts.chunks(b.column("text")):
                for row, offset, data, at in _pieces(t, length):
                    text, key, content, start, n = _segments(data, at, length, gram)
                    text = text + lo + row
                    cols = [d[text], h[text], key.view(np.int64), content.view(np.int64), (start + offset).astype(np.int32), n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["d", "h", "key", "content", "start", "n"])

    return docs.mapInArrow(run, "d bigint, h bigint, key bigint, content bigint, start int, n int")


def repeated_strings(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each content: which of its ``length``-byte strings start anywhere else in these contents."""
    size = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(size + 1)
    at = np.concatenate([[0], ends])
    text = np.zeros(ends[-1], np.uint8)
    raw = np.frombuffer(b"".join(contents), np.uint8)
    spots = np.arange(len(raw)) + np.repeat(np.arange(len(contents)), size)
    # bytes that no UTF-8 text has leave room for a 0 between contents
    text[spots] = raw + 1
    n = len(text)
    # suffixes in order of their first ``depth`` >= length bytes
    key = np.zeros(n, U64)
    for j in range(8):
        key[: n - j] |= text[j:].astype(U64) << U64(56 - 8 * j)
    depth = 8
    order = np.argsort(key)
    while True:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if depth >= length:
            break
        nxt = np.zeros(n, np.int64)
        if depth < n:
            nxt[:-depth] = rank[depth:] + 1
        key = ((rank << 32) | nxt).view(U64)
        order = np.argsort(key)
        depth *= 2
    bwt = text[order - 1]
    head = text[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])
    # where the suffix that is one byte longer stands: symbols of the transform, in order
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    valued = np.zeros(n + 1, bool)
    valued[starts] = True
    low, high = starts[:-1], starts[1:]
    low, high = low[low < high], high[low < high]
    owner, serial = np.full(n + 1, -1, np.int64), 0
    for _ in range(1, length):
        if not len(low):
            break
        many = high - low
        rows = np.arange(many.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        which = np.repeat(np.arange(serial, serial + len(low)), many)
        serial += len(low)
        on = bwt[rows] != 0
        to, which = back[rows[on]], which[on]
        owner[to] = which
        # rows of one interval with one symbol go to neighbouring places
        last = (owner[to + 1] != which) | (head[np.minimum(to + 1, n - 1)] != head[to])
        before = (owner[to - 1] != which) | (head[to - 1] != head[to])
        low, high = np.sort(to[before]), np.sort(to[last]) + 1
        fresh = ~valued[high]
        low, high = low[fresh], high[fresh]
        valued[high] = True
    same = ~valued
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    out = []
    for i in range(len(contents)):
        r = row[at[i] : at[i] + size[i] - length + 1]
        out.append(same[r] | same[r + 1])
    return out


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "z": int(z)} for a, z in zip(edge[::2], edge[1::2], strict=True)]


def _expand(contents: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """key, content, bytes, partitioned and sorted by key -> key, content, runs of repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[int, int]] = []
        texts: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            found = [_runs(x) for x in repeated_strings(texts, length)]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in names], pa.int64()), pa.array([c for _, c in names], pa.int64()), pa.array(found, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))],
                ["key", "content", "runs"],
            )

        for b in batches:
            for k, c, x in zip(*(b.column(i).to_pylist() for i in ("key", "content", "bytes")), strict=True):
                if total > shard_bytes and names[-1][0] != k:
                    yield flush()
                    names, texts, total = [], [], 0
                names.append((k, c)), texts.append(x)
                total += len(x)
        if names:
            yield flush()

    return contents.mapInArrow(run, "key bigint, content bigint, runs array<struct<a:int,z:int>>")


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted segments (d, h, key, content, start, n, kinds), and g, the place of the gram in the first string."""
    each = wanted.groupBy("d", "h").agg(F.collect_list(F.struct("key", "content", "start", "n", "kinds")).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, w in zip(b.column("text"), b.column("w").to_pylist(), strict=True):
                raw = text.as_py().encode()
                cut = [raw[x["start"] : x["start"] + x["n"] % STRINGS + length - 1] for x in w]
                cols = [pa.array([x[c] for x in w], pa.int64()) for c in ("key", "content", "kinds")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x["n"] // STRINGS for x in w], pa.int32()), pa.array(cut, pa.binary())], ["key", "content", "kinds", "g", "bytes"])

    return docs.join(each.hint("shuffle_hash"), ["d", "h"]).select("text", "w").mapInArrow(run, "key bigint, content bigint, kinds bigint, g int, bytes binary")


PART = "key bigint, content bigint, g int, bytes binary, up_key bigint, up_content bigint, up_at int"


def _divided(contents: DataFrame, length: int, width: int) -> DataFrame:
    """contents (key, content, g, bytes, up_key, up_content, up_at) -> parts of the same form whose strings hold the gram
    at ``width`` neighbouring places, keyed by the bytes that all of them cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("key", "content", "g", "bytes", "up_key", "up_content", "up_at")}
            for key, g, x, uk, uc, at in zip(*(b.column(c).to_pylist() for c in ("key", "g", "bytes", "up_key", "up_content", "up_at")), strict=True):
                # string i holds the gram at g - i; a range of places [low, low + width) is a stretch of strings
                i, n = 0, len(x) - length + 1
                while i < n:
                    low = (g - i) // width * width
                    z = min(n, g - low + 1)
                    # what a string at any place of the range covers, counted from the gram
                    a, c = g - low, g - (low + width - 1) + length
                    name = f"{key}:{low}:".encode() + x[max(a, 0) : c] if a < c else b""
                    part = x[i : z + length - 1]
                    out["key"].append(xxhash.xxh3_64_intdigest(name) - (1 << 63))
                    out["content"].append(xxhash.xxh3_64_intdigest(f"{g - i}:".encode() + part, 1) - (1 << 63))
                    for k, v in (("g", g - i), ("bytes", part), ("up_key", uk), ("up_content", uc), ("up_at", at + i)):
                        out[k].append(v)
                    i = z
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return contents.mapInArrow(run, PART)


def _remove(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                raw, parts, end, removed, n = (text.as_py() or "").encode(), [], 0, 0, 0
                for s in sorted((x["a"], x["z"]) for x in spans.as_py() or ()):
                    if s[0] > end or not n:
                        parts.append(raw[end : s[0]])
                        n, removed, end = n + 1, removed + s[1] - s[0], s[1]
                    elif s[1] > end:
                        removed, end = removed + s[1] - end, s[1]
                parts.append(raw[end:])
                out.append((len(raw), removed, n, hashlib.sha256(b"".join(parts)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _decided(contents: DataFrame, length: int, most: int, shard_bytes: int, widths: tuple[int, ...]) -> DataFrame:
    """contents: key, content, kinds (contents of the key), g, bytes -> key, content, runs of repeated strings."""
    one = contents.where(F.col("kinds") <= most)
    runs = [_expand(one.repartition("key").sortWithinPartitions("key", "content"), length, shard_bytes)]
    left = contents.where(F.col("kinds") > most)
    left = left.select("key", "content", "g", "bytes", F.col("key").alias("up_key"), F.col("content").alias("up_content"), F.lit(0).alias("up_at"))
    for width in widths:
        if left.isEmpty():
            break
        parts = materialize(_divided(left, length, width))
        contents = parts.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"))
        kinds = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max("copies").alias("most")).where("kinds > 1 OR most > 1")
        known = materialize(contents.join(kinds.drop("most"), "key"))
        # a part that occurs twice repeats as a whole; of the others, those that share a key go on
        twice = parts.join(known.where("copies > 1").select("key", "content"), ["key", "content"], "left_semi")
        whole = F.struct(F.col("up_at").alias("a"), (F.col("up_at") + F.octet_length("bytes") - (length - 1)).cast("int").alias("z"))
        again = materialize(twice.groupBy("up_key", "up_content").agg(F.collect_list(whole).alias("runs")))
        runs.append(again.select(F.col("up_key").alias("key"), F.col("up_content").alias("content"), "runs"))
        several = parts.join(known.where("kinds > 1"), ["key", "content"])
        small = several.where(F.col("kinds") <= most)
        first = small.groupBy("key", "content").agg(F.first("bytes").alias("bytes"))
        found = _expand(first.repartition("key").sortWithinPartitions("key", "content"), length, shard_bytes).where(F.size("runs") > 0)
        back = small.where("copies = 1").select("key", "content", "up_key", "up_content", "up_at").join(found, ["key", "content"])
        moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("up_at")).alias("a"), (r["z"] + F.col("up_at")).alias("z")))
        runs.append(back.select(F.col("up_key").alias("key"), F.col("up_content").alias("content"), moved.alias("runs")))
        left = several.where(F.col("kinds") > most).select(*parts.columns)
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def removed_spans(docs: DataFrame, length: int = 200, gram: int = 32, most: int = 2_000, shard_bytes: int = 1 << 20, widths: tuple[int, ...] = (64, 16, 4, 1)) -> DataFrame:
    """docs: d, h, text -> d, h, spans (byte ranges that go, end exclusive; they may overlap).

    ``most``: contents of a key that one shard takes; ``widths``: of the ranges that larger keys are divided into.
    """
    cut = segments(docs, length, gram)
    often = cut.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    several = materialize(cut.join(often, "key", "left_semi"))
    contents = several.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("d", "h", "start", "n")).alias("one"))
    contents = materialize(contents)
    by_key = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = contents.join(by_key, "key").select("key", "content", "one.*", "kinds")
    texts = materialize(_cut(docs, mixed, length))
    some = _decided(texts, length, most, shard_bytes, widths).where(F.size("runs") > 0)
    whole = contents.where("copies > 1").select("key", "content", F.lit(None).cast("array<struct<a:int,z:int>>").alias("runs"))
    single = some.join(contents.where("copies > 1").select("key", "content"), ["key", "content"], "left_anti")
    decided = materialize(whole.unionByName(single))
    hit = several.join(decided, ["key", "content"])
    strings = F.col("n") % STRINGS
    runs_or_all = F.coalesce("runs", F.array(F.struct(F.lit(0).alias("a"), strings.alias("z"))))
    each = hit.select("d", "h", "start", F.explode(runs_or_all).alias("r"))
    span = F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.z") + (length - 1)).alias("z"))
    out = materialize(each.groupBy("d", "h").agg(F.collect_set(span).alias("spans")))
    forget(several, contents, texts, decided, sweep=True)
    return out


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text and a name for the text: d (the id, or the least number for null) and h (hash of the text)."""
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), d.alias("d"), F.xxhash64("text").alias("h"))


def dedup(docs: DataFrame, length: int = 200, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay) for each row of ``docs``."""
    docs = named(docs)
    spans = removed_spans(docs.select("d", "h", "text"), length, **how)
    return _remove(docs.join(spans.hint("shuffle_hash"), ["d", "h"], "left").select("doc_id", "text", "spans"), length)
