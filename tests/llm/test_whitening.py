"""Whitening against a dense eigendecomposition, and against exact integers."""

import math

import numpy as np
import pytest

from ledgerloom.llm import whitening


def dense(size, seed, spread):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((3 * size, size)) * np.exp(-spread * np.arange(size) / size)
    a -= a.mean(0)
    return a.T @ a / len(a)


@pytest.mark.parametrize(("size", "wanted", "spread"), [(1, 1, 1), (20, 32, 1), (64, 32, 0.1), (64, 64, 2), (250, 10, 3), (250, 10, 30)])
def test_eigenpairs(size, wanted, spread):
    c, calls = dense(size, size, spread), []
    values, vectors, residuals = whitening.jacobi_davidson(lambda q: (calls.append(1), c @ q)[1], size, wanted)
    want = np.linalg.eigvalsh(c)[::-1][: min(wanted, size)]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert residuals.max() < 1e-12 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(c @ vectors - vectors * values).max() < 1e-12 * want[0]


def test_equal_eigenvalues():
    c = np.diag([5.0] * 7 + [1.0] * 43)
    values, vectors, residuals = whitening.jacobi_davidson(lambda q: c @ q, 50, 12)
    assert np.allclose(values, [5] * 7 + [1] * 5) and residuals.max() < 1e-12


def test_minres_solves():
    c = dense(30, 1, 2)
    away = np.linalg.qr(np.random.default_rng(0).standard_normal((30, 4)))[0]
    r = np.random.default_rng(1).standard_normal((30, 3))
    r -= away @ (away.T @ r)
    theta = np.array([0.3, 0.11, 0.9])
    t = whitening.corrections(lambda q: c @ q, theta, r, away, 60)
    p = np.eye(30) - away @ away.T
    for i in range(3):
        assert np.linalg.norm(p @ (c @ t[:, i] - theta[i] * t[:, i]) + r[:, i]) < 1e-6 * np.linalg.norm(r[:, i])


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, x double, key string, whitened int").repartition(3)


def result(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.query(spark, str(tmp_path)).collect()


def test_query_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((90, 40)).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist())] + [(200 + i, vectors[1].tolist()) for i in range(40)]
    bad = [(300, None), (301, []), (302, [1.0] * 39), (303, [math.nan] * 40), (304, [math.inf] + [0.0] * 39), (305, [None] + [0.0] * 39)]
    got = result(spark, good + bad, tmp_path)
    assert len(got) == 32 * len(good) and {r["vec_id"] for r in got} == {i for i, _ in good}
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(good, x, strict=True)}
    centre = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    cov = centre.T @ centre / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    want = {i: w for (i, _), w in zip(good, centre @ u / np.sqrt(e), strict=True)}
    signs = {}
    for r in got:
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        k = r["component"] - 1
        assert abs(r["explained"] - e[k] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-10
        w = want[r["vec_id"]][k]
        signs.setdefault(k, 1 if w * r["whitened"] > 0 else -1)
        assert abs(signs[k] * r["whitened"] - w) < 1e-8
    assert len({r["identity_error"] for r in got}) == 1


def test_less_variance_than_components(spark, tmp_path):
    flat = [(i, [float(i % 5), 1.0, float(i % 3), 2.0 * (i % 5)]) for i in range(30)]
    got = result(spark, flat, tmp_path / "a")
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-10
    assert result(spark, [(1, [1.0, 2.0])] * 5, tmp_path / "b") == []
    assert result(spark, [(1, None)], tmp_path / "c") == []
    table(spark, [(1, [1.0])]).limit(0).write.parquet(f"{tmp_path}/d/embeddings.parquet")
    assert whitening.query(spark, f"{tmp_path}/d").collect() == []


def test_large_entries():
    x = whitening.entries(__import__("pyarrow").array([[1e12, -1e12], [0.0, 0.5]]))
    centre = whitening.centred(x, 2, [int(s) for s in x.sum(0)])
    assert centre.tolist() == [[64 * 10**12, -64 * 10**12 - 32], [-64 * 10**12, 64 * 10**12 + 32]]
    assert whitening.deviations(centre) == [None, None]
    assert whitening.deviations(centre // 10**6) == [2 * (64 * 10**6) ** 2 + 2 * 64 * 10**6 + 1, 2 * (64 * 10**6) ** 2]
