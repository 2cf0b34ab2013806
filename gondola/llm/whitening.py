"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers (see ``usable``), so that counts, sums and deviations are exact. Executors add up what they
see of the scatter, centred at the rounded mean before it is multiplied; d x d sums reach the driver, which no number of
rows makes larger. There the scatter is factored as L L' (rows in pivot order) and the columns of L are rotated in pairs
until all are orthogonal: their squared norms are the eigenvalues, the columns divided by their norms the components.

Rows without a usable vector are left out: null, empty, with a null, non-finite or too large entry (beyond 2^50), or of
another length than most vectors have (on a tie, the longer). Repeated rows count as often as they occur. Components of
no variance can't be scaled to one and are not reported, so that there may be fewer than asked for; without any, or
without usable rows, the result is empty. Other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows that one step of a task holds as doubles.
ROWS = 4096


def usable(vector: Column) -> Column:
    """Whether a vector has entries and each is a number below 2^50 in size."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 50), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


@dataclass
class Whitening:
    """``n`` and ``sums`` of the fitted vectors (exact); a row of ``components`` for each of ``values`` (falling), the
    eigenvalues of the covariance; ``trace`` of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L and the pivot order p with a[p][:, p] = L L'; L has a column for each pivot that is more than rounding."""
    a, d = a.astype(np.float64).copy(), len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    least = max(0.0, np.trace(a)) * np.finfo(float).eps
    for k in range(d):
        at = k + int(np.argmax(np.diag(a)[k:]))
        if not a[at, at] > least:
            return factor[:, :k], order
        a[[k, at]], factor[[k, at]], order[[k, at]] = a[[at, k]], factor[[at, k]], order[[at, k]]
        a[:, [k, at]] = a[:, [at, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until no two have a cosine beyond rounding.

    A round of the tournament rotates disjoint pairs at once; a sweep lets every two columns meet.
    """
    g = factor.copy()
    k = g.shape[1]
    ring = [*range(k), *[-1] * (k % 2)]
    for _ in range(sweeps if k > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if a >= 0 and b >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            i, j = np.array(pairs).T
            x, y = g[:, i], g[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            cosine = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            worst = max(worst, float(cosine.max()))
            turn = cosine > 1e-16
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, c * t, 0.0)
            g[:, i], g[:, j] = c * x - s * y, s * x + c * y
        if worst < 1e-15:
            break
    return g


def spectrum(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (rows) of a scatter matrix, those above rounding only."""
    factor, order = cholesky(scatter)
    turned = jacobi(factor)
    values = (turned * turned).sum(0)
    rank = np.argsort(-values, kind="stable")
    rank = rank[values[rank] > len(scatter) * np.finfo(float).eps * values.max(initial=0.0)]
    rows = np.zeros((len(rank), len(scatter)))
    rows[:, order] = (turned[:, rank] / np.sqrt(values[rank])).T
    largest = np.abs(rows).argmax(1)
    return values[rank], rows * np.sign(rows[np.arange(len(rank)), largest])[:, None]


def _whole(column: pa.ListArray, d: int) -> np.ndarray:
    """Vectors of a batch as rows of whole numbers."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)).astype(np.int64) + SHIFT


def _whole_sql(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(SCALE * c.cast("double")) + SHIFT).cast("bigint"))


def _scatter(rows: DataFrame, d: int, mean: list[int]) -> np.ndarray:
    """Sums of products of the entries less ``mean``. A product of two entries below 2^20 is exact, as are their sums
    until they need 53 bits."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = np.zeros((d, d)), np.array(mean, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = (_whole(batch.slice(at, ROWS).column(0), d) - middle).astype(np.float64)
                total += y.T @ y
        yield pa.record_batch({"i": pa.array(np.arange(d), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.float64()))})

    sums = rows.mapInArrow(part, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for r in sums.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def vectors(table: DataFrame, row: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """The usable rows as (row, vector), and their length (0 if there are none)."""
    fine = table.select(F.col(row).alias("vec_id"), F.col(vector).alias("v")).where(usable(F.col("v")))
    most = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (fine.where(F.size("v") == most["d"]), most["d"]) if most else (fine, 0)


def fit(rows: DataFrame, d: int) -> Whitening:
    """The whitening of all ``vectors`` rows. d sums and d x d products reach the driver."""
    sums = rows.select(F.posexplode(_whole_sql(F.col("v"))).alias("i", "x")).groupBy("i").agg(F.count("x").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).orderBy("i").collect() if d else []
    if not sums:
        return Whitening(0, [], np.zeros((0, d)), np.zeros(0), 0.0)
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    mean = [(2 * x + n) // (2 * n) for x in s]
    off = np.array([x - n * m for x, m in zip(s, mean, strict=True)], np.float64)
    centred = _scatter(rows, d, mean) - np.outer(off, off) / n
    values, components = spectrum(centred)
    return Whitening(n, s, components, values / n, float(np.trace(centred)) / n)


def _project(model: Whitening, x: np.ndarray, k: int) -> np.ndarray:
    """(x - sums / n) on the first ``k`` components, each divided by its standard deviation."""
    mean = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, mean, strict=True)])
    scaled = model.components[:k] / np.sqrt(model.values[:k])[:, None]
    return ((x - np.array(mean, np.int64)).astype(np.float64) - rest) @ scaled.T


def identity_error(rows: DataFrame, d: int, model: Whitening, k: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity, from the whitened rows themselves."""
    if not k:
        return 0.0

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                z = _project(model, _whole(batch.slice(at, ROWS).column(0), d), k)
                total += np.vstack([z.T @ z, z.sum(0)])
        yield pa.record_batch({"i": pa.array(np.arange(k + 1), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.float64()))})

    sums = rows.select("v").mapInArrow(part, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1, k))
    for r in sums.collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, row: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """One row for each usable row and component up to ``most``: vec_id, component, n, deviation, whitened, explained,
    identity_error. ``deviation`` is null where it exceeds a long."""
    rows, d = vectors(table, row, vector)
    model = fit(rows.select("v"), d)
    k = min(most, len(model.values))
    error = identity_error(rows, d, model, k)
    kind = rows.schema["vec_id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not k:
        return table.sparkSession.createDataFrame([], schema)
    n, sums, share = model.n, model.sums, model.values[:k] / model.trace

    def deviation(x: np.ndarray) -> list[int | None]:
        fits = n < 1 << 31 and max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums))) < 1 << 62
        y = n * x - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object)
        small = fits and float(np.abs(y).max(initial=0)) ** 2 * d < 9e18
        total = (y * y).sum(1) if small else (y.astype(object) ** 2).sum(1)
        return [int(t) if t < 1 << 63 else None for t in total]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                x, m = _whole(some.column(1), d), some.num_rows
                z = _project(model, x, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                        pa.array(np.full(m * k, n)),
                        pa.array(deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(z.ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(put, schema)
