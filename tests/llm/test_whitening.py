"""Whitening against numpy's eigenvectors and Python's whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def test_eigenvectors_of_many_matrices():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 40):
        for kind in range(5):
            q = np.linalg.qr(rng.normal(size=(n, n)))[0]
            spread = [rng.random(n) + 0.1, np.ones(n), np.r_[np.full((n + 1) // 2, 5.0), rng.random(n // 2)], 10.0 ** -np.arange(n), np.arange(n) * 1.0][kind]
            a = (q * spread) @ q.T if kind < 4 else np.diag(spread)
            a = (a + a.T) / 2
            values, vectors = whitening.leading_components(a, 8)
            want = np.linalg.eigvalsh(a)[::-1][:8]
            size = max(np.abs(a).max(), 1e-300)
            assert len(values) == (min(n, 8) if np.abs(a).max() else 0)
            if len(values):
                assert np.abs(values - want).max() < 1e-13 * n * size
                assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
                assert np.abs(vectors @ a - values[:, None] * vectors).max() < 1e-12 * size


def whole(v):
    return np.floor(1024 * np.asarray(v, np.float32).astype(float)).astype(int) + 100_000


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(300, 12)) * np.linspace(3, 0.5, 12)) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    v[10] = v[11]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [float("inf")] * 12), (905, [1.0] * 3)]
    d = spark.createDataFrame(rows + odd + [(None, rows[0][1])], SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("w", "at", "n", "component", "deviation")})
    got = whitening.whiten(d).collect()
    x = np.array([whole(r[1]) for r in rows + [rows[0]]])
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = y @ axes / np.sqrt(values)
    assert len(got) == n * 8 and {r["vec_id"] for r in got} == {*range(300), None}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(8):
        w = np.array([by[i, k + 1]["whitened"] for i in range(300)])
        assert min(np.abs(w - want[:300, k]).max(), np.abs(w + want[:300, k]).max()) < 1e-9
    for i in range(300):
        r = by[i, 1]
        assert r["deviation"] == sum((n * int(a) - int(t)) ** 2 for a, t in zip(x[i], s, strict=True)) == r["deviation_exact"]
    assert {r["n"] for r in got} == {n} and all(math.isclose(by[0, k + 1]["explained"], values[k] / np.trace(y.T @ y / n), rel_tol=1e-9) for k in range(8))
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_degenerate_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert make([]).count() == make([(1, [1.0, 2.0])]).count() == make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == make([(1, None)]).count() == 0
    one = make([(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0])]).collect()  # a single direction
    assert {r["component"] for r in one} == {1} and all(r["explained"] == pytest.approx(1) for r in one)


def test_numbers_beyond_64_bits(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3e9, 2.0])]
    got = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    x = [(1 << 50, 100_000), (-(1 << 50), 101_024), (1024 * 3 * 10**9 + 100_000, 102_048)]
    s = [sum(c) for c in zip(*x, strict=True)]
    for k, r in enumerate(rows):
        want = sum((3 * a - t) ** 2 for a, t in zip(x[k], s, strict=True))
        assert got[r[0]]["deviation_exact"] == want and got[r[0]]["deviation"] == (want if want < 1 << 63 else None)
