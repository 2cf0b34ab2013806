"""Benchmark decontamination with an FM-index for each training shard.

A shard's words become symbols of the benchmark's vocabulary. Words that no benchmark item has can't lie inside any
occurrence, so they end a run, and runs shorter than the shortest test phrase are left out: exact, and it makes the
indexed text small. Over the rest the shard builds its suffix order, the Burrows-Wheeler transform and a wavelet matrix
for ranks. All test phrases (13-word windows of the items; a shorter item is one phrase) are searched backwards at
once; occurrences are located by walking to sampled suffix positions, and become hit words, merged into spans.

Shards are consecutive rows of a partition, so nothing is shuffled. The benchmark goes to the executors in blocks of
at most ``block_mb`` MB of text each; every block is searched in all documents.

Null and empty texts have no words and are hit by nothing; items without words have no phrase; null item ids count as
the empty string. Rows are independent, however many blocks there are: null and repeated ids stay separate rows. With
several blocks the rows are numbered in a table first, and the parts of a row are put together by that number. Extra
columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gondola.llm.arrays import ALNUM, Texts, lists
from gondola.llm.common import materialize, scan

SAMPLE = 16


class FMIndex:
    """Over symbols 2 .. sigma - 1, with 1 between runs; the end of the text gets a 0 of its own."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.append(text, 0)
        n, self.bits = len(text), max(1, int(sigma).bit_length())
        rank, step = text.astype(np.int64), 1
        # suffixes by their first ``step`` symbols, then twice as many; the end of the text sorts first
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[:-step or None] = rank[step:] + 1
            key = (rank << 32) | nxt
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 or step >= n:
                break
        self.order = order
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        level, self.ones, self.zeros = self.bwt, [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        marked = order % SAMPLE == 0
        self.marked, self.samples = marked, order[marked].astype(np.int64)
        self.sample_rank = np.concatenate([[0], np.cumsum(marked)])
        del self.order

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``row`` of the transform."""
        low, high = np.zeros_like(row), row
        for i, b in enumerate(range(self.bits - 1, -1, -1)):
            up, ones, zeros = (symbol >> b) & 1 == 1, self.ones[i], self.zeros[i]
            low = np.where(up, zeros + ones[low], low - ones[low])
            high = np.where(up, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase."""
        count = len(phrases.start)
        low, high = np.zeros(count, np.int64), np.full(count, len(self.bwt), np.int64)
        end = phrases.start + phrases.length - 1
        for j in range(int(phrases.length.max()) if count else 0):
            on = np.flatnonzero((phrases.length > j) & (low < high))
            s = phrases.text[end[on] - j].astype(np.int64)
            low[on] = self.first[s] + self.rank(s, low[on])
            high[on] = self.first[s] + self.rank(s, high[on])
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back until a sampled one."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        left = np.flatnonzero(~self.marked[row])
        while len(left):
            s = self.bwt[row[left]]
            row[left] = self.first[s] + self.rank(s, row[left])
            steps[left] += 1
            left = left[~self.marked[row[left]]]
        return self.samples[self.sample_rank[row]] + steps


class Phrases:
    """The test phrases of a block of items, as stretches of one array of symbols. Made once, on the driver; the arrays
    that go to the executors take about four times the block's text.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        items = sorted(set(items))
        words = Texts(*_joined([t for _, t in items])).words(ALNUM)
        self.vocabulary = np.unique(words.hash)
        self.text = (np.searchsorted(self.vocabulary, words.hash) + 2).astype(np.int32)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.vocabulary & np.uint64((1 << 20) - 1)] = True
        self.names = [name for name, _ in items]
        n = words.n
        many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), many)
        step = np.arange(len(self.item)) - np.repeat(np.cumsum(many) - many, many)
        self.start = (words.at[:-1][self.item] + step).astype(np.int32)
        self.length = np.minimum(n, window).astype(np.int32)[self.item]
        self.least = int(self.length.min()) if len(self.length) else 0


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def _runs(symbols: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with a 1 after each run, word of each) of the runs of at least ``least`` words within a document."""
    inside = np.concatenate([[False], symbols > 1, [False]])
    cut = np.zeros(len(symbols) + 1, bool)
    cut[at] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    long = end - begin >= least
    begin, end = begin[long], end[long]
    size = end - begin + 1
    offset = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
    word = np.arange(len(offset)) + offset
    out = np.append(symbols, 1)[word]
    if len(size):
        out[np.cumsum(size) - 1] = 1
    return out, word


def search(docs: DataFrame, items: list[tuple[str, str]], window: int = 13, shard_symbols: int = 1 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, spans (merged word ranges, end exclusive), items (those with a phrase in the text)."""
    sent = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        ids: list[list[pa.Array]] = []
        counts: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        words = size = 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(counts)
            at = np.concatenate([[0], np.cumsum(n)])
            symbols, word = (np.concatenate(x) for x in zip(*parts, strict=True))
            starts, ends, doc_items = np.zeros(0, np.int64), np.zeros(0, np.int64), {}
            if len(symbols) and len(phrases.start):
                index = FMIndex(symbols, len(phrases.vocabulary) + 2)
                low, high = index.search(phrases)
                many = high - low
                which = np.repeat(np.arange(len(low)), many)
                rows = np.arange(len(which)) + np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                place = word[index.locate(rows)]
                step = np.zeros(at[-1] + 1, np.int32)
                np.add.at(step, place, 1)
                np.add.at(step, place + phrases.length[which], -1)
                hit = np.concatenate([[False], np.cumsum(step)[:-1] > 0, [False]])
                cut = np.zeros(len(hit), bool)
                cut[at] = True
                starts = np.flatnonzero(hit[1:-1] & (~hit[:-2] | cut[:-2]))
                ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | cut[1:-1])) + 1
                owner = np.searchsorted(at, place, "right") - 1
                found = np.unique((owner << 32) | phrases.item[which])
                for d, i in zip((found >> 32).tolist(), (found & 0xFFFFFFFF).tolist(), strict=True):
                    doc_items.setdefault(d, set()).add(phrases.names[i])
            own = np.searchsorted(at, starts, "right") - 1
            span_at = np.searchsorted(own, np.arange(len(n) + 1))
            base = at[own]
            spans = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"])
            names = pa.array([sorted(doc_items.get(i, ())) for i in range(len(n))], pa.list_(pa.string()))
            same = [pa.concat_arrays(x) for x in zip(*ids, strict=True)]
            out = [*same, pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), spans), names]
            return pa.RecordBatch.from_arrays(out, [*keep, "n_words", "spans", "items"])

        for b in batches:
            for lo, hi, t in Texts.chunks(b.column("text")):
                w = t.words(ALNUM)
                symbols = np.ones(len(w.hash), np.int64)
                maybe = np.flatnonzero(phrases.filter[w.hash & np.uint64((1 << 20) - 1)])
                at = np.searchsorted(phrases.vocabulary, w.hash[maybe])
                known = phrases.vocabulary[np.minimum(at, max(0, len(phrases.vocabulary) - 1))] == w.hash[maybe] if len(maybe) else np.zeros(0, bool)
                symbols[maybe[known]] = at[known] + 2
                runs, word = _runs(symbols, w.at, max(1, phrases.least))
                ids.append([b.column(c).slice(lo, hi - lo) for c in keep]), counts.append(w.n), parts.append((runs, word + words))
                words, size = words + len(w.hash), size + len(runs)
                if size >= shard_symbols or words >= 1 << 22:
                    yield flush()
                    ids, counts, parts, words, size = [], [], [], 0, 0
        if ids:
            yield flush()

    read = docs.select(*dict.fromkeys((*keep, "text")))
    found = StructType.fromDDL("n_words bigint, spans array<struct<start:int,end:int>>, items array<string>")
    return read.mapInArrow(run, StructType([*[read.schema[c] for c in keep], *found.fields]))


def _merge(spans: Column) -> Column:
    """Union of spans, in order."""
    kind = "struct<start:int,end:int>"
    none = F.array().cast(f"array<{kind}>")

    def step(a: Column, s: Column) -> tuple[Column, Column]:
        apart = a.isNull() | (s["start"] > a["end"])
        wider = F.struct(a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"))
        return F.when(apart, s).otherwise(wider), F.when(apart & a.isNotNull(), F.array(a)).otherwise(none)

    return scan(F.array_sort(spans), F.lit(None).cast(kind), kind, kind, step, lambda a: F.when(a.isNull(), none).otherwise(F.array(a)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_mb: int = 16, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, n_hit, n_items, items (sorted), spans, contaminated (a twentieth of the words or more is hit)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    mb = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 1e6
    blocks = int(mb // block_mb) + 1
    found, row = None, "_row"
    if blocks > 1:
        docs = materialize(docs.select(*dict.fromkeys((*keep, "text"))).withColumn(row, F.monotonically_increasing_id()))
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).collect()  # of bounded size
        part = search(docs, [(r["item"], r["text"]) for r in block], window, keep=keep if blocks == 1 else (row,))
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy(row).agg(F.max("n_words").alias("n_words"), _merge(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = docs.select(*keep, row).join(found, row).drop(row)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("bigint")})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")
