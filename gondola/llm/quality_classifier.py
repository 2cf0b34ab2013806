"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector over hashed words and a few shape features is shared by all
grades, with ordered thresholds. From it come the expected grade and the tail probability of the best grade, on which
documents are selected.

Training reads at most ``fit_rows`` labelled documents (a documented bound; those whose ids hash lowest, so that reruns
agree); their feature indices, and nothing else, come to the driver. Scoring reads every word of every document, where
the weights (2 MB) are sent to the executors.

Ratings with a null are skipped; several ratings of a document count as the lowest. Without any rating, the model is
neutral and keeps all documents. Null and empty texts have grade 0 and are rejected. Rows are independent, so repeated
ids, ties and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.arrays import ALNUM, NON_SPACE, Texts, byte_class

BITS = 18
SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>")
UPPER, BANG = byte_class(lambda b: 65 <= b <= 90), byte_class(lambda b: b == 33)
LINE = byte_class(lambda b: b != 10)
#: Upper ends of the bins of each shape feature; a feature has one active bin.
SHARES = np.array([0.001, 0.01, 0.03, 0.1, 0.3, 0.6])
LENGTHS = np.array([5, 20, 50, 100, 300, 1000, 3000])
SHAPES = (("symbols", SHARES), ("capitals", SHARES), ("bangs", SHARES), ("repeated_lines", SHARES), ("repeated_runs", SHARES), ("words", LENGTHS))
STRIDE = 16
SIZE = (1 << BITS) + STRIDE * len(SHAPES)
TOP = 2


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, where each text's begin, number of words): hashed words that occur, and a bin for each shape."""
    w = t.words(ALNUM)
    key = np.unique((w.owner().astype(np.int64) << 20) | (w.hash >> np.uint64(64 - BITS)).astype(np.int64))
    raw = t.words(NON_SPACE)
    n, size = raw.n, np.maximum(np.diff(t.at), 1)

    def repeats(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        total = np.bincount(owner, minlength=t.n)
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        return 1 - np.bincount(o[new], minlength=t.n) / np.maximum(total, 1)

    lines = t.words(LINE, lower=False)
    run, owner, _ = raw.shingles(3)
    values = (t.count(SYMBOL) / size, t.count(UPPER) / size, t.count(BANG) / size, repeats(lines.hash, lines.owner()), repeats(run, owner), n)
    every = [key]
    for i, (v, (_, bins)) in enumerate(zip(values, SHAPES, strict=True)):
        every.append((np.arange(t.n, dtype=np.int64) << 20) | ((1 << BITS) + STRIDE * i + np.searchsorted(bins, v)))
    key = np.sort(np.concatenate(every))
    return (key & ((1 << 20) - 1)).astype(np.int32), np.searchsorted(key, np.arange(t.n + 1) << 20), n


#: Entries of the training sample that one step of a sum goes through.
CHUNK = 1 << 18


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, for grades 1 .. TOP

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k), a row for each k."""
        return 1 / (1 + np.exp(-np.clip(score[None, :] - self.thresholds[:, None], -30, 30)))


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 harmless but poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(toxic.isNotNull() & quality.isNotNull(), 2)


def _minimise(fun, x: np.ndarray, rounds: int, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halving steps."""
    f, g = fun(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = -g, []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
            d = d + (a - rho * (y @ d)) * s
        slope, step = g @ d, 1.0
        for _ in range(25):
            x2 = x + step * d
            f2, g2 = fun(x2)
            if f2 <= f + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = x2 - x, g2 - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        done = abs(f - f2) < 1e-9 * max(1.0, abs(f))
        x, f, g = x2, f2, g2
        if done:
            break
    return x


def train(index: np.ndarray, at: np.ndarray, y: np.ndarray, ridge: float = 1e-4, least_docs: int = 8, rounds: int = 150) -> Model:
    """Maximum likelihood with a ridge; words of fewer than ``least_docs`` training documents get no weight."""
    weights = np.zeros(SIZE, np.float32)
    if not len(y):
        return Model(weights, np.zeros(TOP))
    seen = sum(np.bincount(index[i : i + CHUNK], minlength=SIZE) for i in range(0, len(index), CHUNK)) + np.zeros(SIZE, np.int64)
    cols = np.flatnonzero(seen >= min(least_docs, max(1, len(y) // 4)))
    place = np.full(SIZE, -1, np.int32)
    place[cols] = np.arange(len(cols), dtype=np.int32)
    col, n = place[index], len(y)
    keep = col >= 0
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))[keep]
    col = col[keep]
    # sums over all entries go chunk by chunk: what a step holds besides the entries is small
    parts = [slice(i, i + CHUNK) for i in range(0, len(col), CHUNK)]

    def fun(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, first, gaps = x[: len(cols)], x[len(cols)], np.exp(np.clip(x[len(cols) + 1 :], -20, 5))
        theta = first + np.concatenate([[0], np.cumsum(gaps)])
        z = np.zeros(n)
        for e in parts:
            z += np.bincount(row[e], w[col[e]], n)
        up = lambda k: 1 / (1 + np.exp(-np.clip(z - theta[k - 1], -35, 35)))
        low = np.choose(y, [np.ones(n), *[up(k) for k in range(1, TOP + 1)]])
        high = np.choose(y, [*[up(k) for k in range(1, TOP + 1)], np.zeros(n)])
        p = np.maximum(low - high, 1e-12)
        loss = -np.log(p).sum() / n + ridge / 2 * (w @ w)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        dz = -(slope_low - slope_high) / p / n
        dtheta = np.array([(np.where(y == k, slope_low, 0) - np.where(y == k - 1, slope_high, 0)) @ (1 / p) / n for k in range(1, TOP + 1)])
        tail = np.cumsum(dtheta[::-1])[::-1]
        slope = ridge * w
        for e in parts:
            slope += np.bincount(col[e], dz[row[e]], len(cols))
        return loss, np.concatenate([slope, [tail[0]], tail[1:] * gaps])

    x = _minimise(fun, np.zeros(len(cols) + TOP), rounds)
    weights[cols] = x[: len(cols)]
    return Model(weights, x[len(cols)] + np.concatenate([[0], np.cumsum(np.exp(np.clip(x[len(cols) + 1 :], -20, 5)))]))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Model:
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # at most fit_rows rows of 12 bytes
    # of the rows of one id the text of the least hash counts, once: repeated ids don't add to what reaches the driver
    one = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    texts = one.select("doc_id", "grade", "t.text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, t in Texts.chunks(b.column("text")):
                index, at, _ = features(t)
                x = [index[at[i] : at[i + 1]].tobytes() for i in range(t.n)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), b.column("grade").slice(a, z - a), pa.array(x, pa.binary())], ["doc_id", "grade", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for _, _, x in rows])]).astype(np.int64)
        grades = np.array([g for _, g, _ in rows], np.int64)
        index = np.frombuffer(b"".join(x for _, _, x in rows), np.int32)
        del rows
        model = train(index, at, grades)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([np.asarray(model.thresholds, np.float64).tobytes()], pa.binary())], ["weights", "thresholds"])

    # the bounded sample meets in one task of an executor; the driver gets the model alone
    encoded = texts.mapInArrow(encode, "doc_id bigint, grade int, x binary").repartition(1)
    made = encoded.mapInArrow(learn, "weights binary, thresholds binary").first()
    none = np.zeros(0, np.int32)
    empty = train(none, np.zeros(1, np.int64), np.zeros(0, np.int64))
    return empty if made is None else Model(np.frombuffer(made["weights"], empty.weights.dtype), np.frombuffer(made["thresholds"], np.float64))


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good, kept (``p_good >= least``, and the text has words)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            for a, z, t in Texts.chunks(b.column("text")):
                index, at, n = features(t)
                total = np.concatenate([[0.0], np.cumsum(m.weights[index].astype(np.float64))])
                p = m.probabilities(total[at[1:]] - total[at[:-1]])
                p[:, n == 0] = 0
                good = np.round(p[-1], 9)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(a, z - a), pa.array(np.round(p.sum(0), 9)), pa.array(good), pa.array((good >= least) & (n > 0))], ["doc_id", "expected_grade", "p_good", "kept"]
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, expected_grade double, p_good double, kept boolean")


def select_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for b in batches:
            kept = np.zeros(b.num_rows, bool)
            for a, z, t in Texts.chunks(b.column("text")):
                index, at, n = features(t)
                total = np.concatenate([[0.0], np.cumsum(m.weights[index].astype(np.float64))])
                kept[a:z] = (np.round(m.probabilities(total[at[1:]] - total[at[:-1]])[-1], 9) >= least) & (n > 0)
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
