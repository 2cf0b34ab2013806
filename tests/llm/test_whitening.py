"""Whitening against exact fractions and a dense eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(vectors):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = np.array([[n * r[j] - s[j] for j in range(d)] for r in x], object)
    dev = [int(sum(int(a) ** 2 for a in r)) for r in y]
    v = np.array([[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    return n, dev, v, y.astype(float) / n


def test_whitening_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, dev, v, y = plain([r["embedding"] for r in rows])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:8], u[:, ::-1][:, :8].T
    got = queries.op11_embedding_whitening(spark, SF).toPandas()
    assert len(got) == 8 * len(rows) and (got["n"] == n).all() and got["identity_error"].nunique() == 1
    assert got["identity_error"].max() < 1e-9
    by = got.set_index(["vec_id", "component"]).sort_index()
    for k in range(8):
        mine = by.xs(k + 1, level="component").loc[[r["vec_id"] for r in rows]]
        want = y @ u[k] / math.sqrt(e[k])
        sign = np.sign(mine["whitened"].to_numpy() @ want)
        assert np.allclose(mine["whitened"], sign * want, atol=1e-7)
        assert mine["deviation"].tolist() == dev
        assert np.allclose(mine["explained"], e[k] / np.trace(v), rtol=1e-9)


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (7, 7), (12, 5), (33, 33)])
def test_spectrum(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * np.logspace(0, -4, rank)
    values, rows = whitening.spectrum(a @ a.T)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert len(values) == rank and np.allclose(values, want, rtol=1e-6)
    assert np.allclose(rows @ rows.T, np.eye(rank), atol=1e-7)
    assert np.allclose(a @ a.T @ rows.T, rows.T * values, atol=1e-12 * values[0] + 1e-14)


def test_equal_eigenvalues_and_zero():
    values, rows = whitening.spectrum(np.diag([2.0, 5.0, 5.0, 0.0]))
    assert np.allclose(values, [5.0, 5.0, 2.0]) and np.allclose(rows @ rows.T, np.eye(3))
    assert len(whitening.spectrum(np.zeros((3, 3)))[0]) == 0


def test_rows_of_any_kind(spark):
    schema = "vec_id bigint, embedding array<float>, n string, whitened string, v string"
    nan, inf = float("nan"), float("inf")
    odd = [(90, None), (91, []), (92, [1.0, None]), (93, [nan, 1.0]), (94, [1.0, -inf]), (95, [1.0, 2.0, 3.0]), (96, [3e38, 0.0])]
    good = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [-0.25, 2.0]), (3, [1e6, -7.5]), (4, [0.0, 0.001])]
    table = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in good + odd], schema)
    got = whitening.whiten(table).toPandas()
    n, dev, _, _ = plain([np.float32(v) for _, v in good])
    assert len(got) == 2 * len(good) and (got["n"] == n).all() and got["identity_error"].max() < 1e-4
    dev = [x if x < 1 << 63 else None for x in dev]
    exact = [r["deviation"] for r in whitening.whiten(table).where("component = 1").collect()]
    assert sorted(exact, key=str) == sorted(dev, key=str) and None in dev
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.where("vec_id > 89")).count() == 0  # one vector has no variance
    assert whitening.whiten(table.where("vec_id = 1")).count() == 0
    copies = table.where("vec_id < 5").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3000))))
    many = whitening.whiten(copies).toPandas()
    assert len(many) == 4 * 3000 * 2 and many["identity_error"].max() < 1e-4
