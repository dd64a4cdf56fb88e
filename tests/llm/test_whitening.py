import math

import numpy as np
import pandas as pd
import pytest

from barloom.llm import whitening
from barloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def by_numpy(vectors):
    """All of the contract by dense linear algebra on the covariance."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values, found = np.linalg.eigh(cov)
    return x, n, s, values[::-1], found[:, ::-1], np.trace(cov)


def test_query_equals_dense_algebra(spark):
    got = QUERIES["op11_embedding_whitening"](spark, SMALL).toPandas()
    table = pd.read_parquet(f"{SMALL}/embeddings.parquet")
    x, n, s, values, found, trace = by_numpy(table.embedding)
    assert len(got) == 4 * len(table) and (got.n == n).all() and got.identity_error.max() < 1e-9
    at = {v: i for i, v in enumerate(table.vec_id)}
    for c, rows in got.groupby("component"):
        order = rows.vec_id.map(at).to_numpy()
        expected = ((x - s / n) @ found[:, c - 1] / np.sqrt(values[c - 1]))[order]
        sign = np.sign(expected @ rows.whitened)
        assert np.abs(expected - sign * rows.whitened).max() < 1e-8
        assert np.allclose(rows.explained, values[c - 1] / trace, rtol=1e-10)
        assert (rows.deviation == ((n * x - s) ** 2).sum(1)[order]).all()


@pytest.mark.parametrize("d", [1, 2, 3, 10, 40])
def test_solver_on_matrices_of_known_values(d):
    rng = np.random.default_rng(d)
    for sigma in (rng.uniform(1, 2, d), 10.0 ** -np.arange(d), np.ones(d), np.r_[np.full(d - d // 2, 3.0), np.zeros(d // 2)]):
        u, v = (np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(2))
        r = np.linalg.qr(u @ np.diag(sigma) @ v.T, mode="r")
        diagonal, upper, _ = whitening.bidiagonal(r)
        full = np.diag(diagonal) + np.diag(upper, 1)
        exact = np.linalg.svd(full, compute_uv=False) ** 2
        values = whitening.dqds(diagonal, upper)
        assert np.allclose(values, exact, rtol=1e-10, atol=1e-15 * exact[0])
        values, found = whitening.principal(r, 4)
        assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-10
        gram = r.T @ r
        assert np.linalg.norm(gram @ found - found * values) < 1e-12 * d * values[0]


def test_small_values_of_a_graded_bidiagonal_keep_their_digits():
    diagonal, upper = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -np.arange(1, 23, 2.0)
    values = whitening.dqds(diagonal, upper)
    # The product of all values is known exactly: a lost digit in any of them shows in it.
    assert abs(np.log(values).sum() - 2 * np.log(diagonal).sum()) < 1e-12


def test_edges(spark):
    v = lambda *x: list(map(float, x))
    rows = [(1, v(1, 2)), (1, v(1, 2)), (None, v(0, 1)), (3, v(5, -0.001)), (4, None), (5, []), (6, [1.0, None])]
    rows += [(7, v(math.nan, 1)), (8, v(math.inf, 1)), (9, v(1e30, 1)), (10, v(1, 2, 3))]
    docs = spark.createDataFrame([(i, x, 7, "x") for i, x in rows], "vec_id long, embedding array<double>, n long, component string")
    got = whitening.whiten(docs).toPandas()
    assert len(got) == 8 and set(got.component) == {1, 2} and (got.n == 3).all()
    assert got.vec_id.isna().sum() == 2 and (got.vec_id == 1).sum() == 4
    x, n, s, *_ = by_numpy([v(1, 2), v(0, 1), v(5, -0.001)])
    assert set(got.deviation) == set(((n * x - s) ** 2).sum(1))
    for part in ("false", "vec_id = 1", "vec_id = 4"):  # none, equal vectors, no usable one
        assert whitening.whiten(docs.where(part)).count() == 0


def test_many_equal_vectors_and_large_numbers(spark):
    hot = [(i, [0.5, 0.25, 1.0]) for i in range(2000)]
    rng = np.random.default_rng(1)
    rows = hot + [(10_000 + i, rng.integers(-4_000_000_000, 4_000_000_000, 3).astype(float).tolist()) for i in range(1000)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(20)).toPandas()
    x, n, s, *_ = by_numpy([r[1] for r in rows])
    assert (got.n == 1001).all() and len(got) == 9000 and got.identity_error.max() < 1e-9
    exact = {r[0]: sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for r, v in zip(rows, x, strict=True)}
    assert all(int(dev) == exact[i] for i, dev in zip(got.vec_id, got.deviation, strict=True))


def test_triangles_are_folded_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    x = np.random.default_rng(3).integers(-99, 99, (300, 5))
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(9)
    r = whitening.triangle(frame, x.mean(0))
    c = x - x.mean(0)
    assert np.allclose(r.T @ r, c.T @ c)
