"""Operator 12 against plain arithmetic in whole numbers."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest

from letterloom.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def whole(c):
    return int(np.floor(64 * np.float64(c))) + 1_000_000


def exact_covariance(x):
    n, dims = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(dims)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(dims)] for i in range(dims)])


def test_contract(spark):
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    x = np.array([[whole(c) for c in v] for _, v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums).astype(np.float64) / n
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    got = queries.op12_whitening(spark, SF).collect()
    assert len(got) == 32 * n and {r["component"] for r in got} == set(range(1, 33))
    by_id = {v: k for k, (v, _) in enumerate(vectors)}
    w = np.zeros((n, 32))
    for r in got:
        k = by_id[r["vec_id"]]
        w[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert 0 <= r["identity_error"] <= 1e-4
    assert np.abs(w.T @ w / n - np.eye(32)).max() == pytest.approx(got[0]["identity_error"], abs=1e-12)
    # each component spans an eigenvector: the projections of all rows have its variance in every direction of the centred values
    direction = centred.T @ w / n
    assert np.allclose(direction / np.linalg.norm(direction, axis=0), np.linalg.eigh(centred.T @ centred / n)[1][:, ::-1][:, :32] * np.sign(np.einsum("ij,ij->j", direction, np.linalg.eigh(centred.T @ centred / n)[1][:, ::-1][:, :32])), atol=1e-6)


def test_covariance_is_exact():
    rng = np.random.default_rng(0)
    for scale in (5, 10**6, 10**11):
        x = rng.integers(-scale, scale, (40, 5))
        rest = x.sum(axis=0).tolist()
        got = whitening.covariance(len(x), whitening._squares(x).tolist(), rest)
        assert np.allclose(got, exact_covariance(x.tolist()), rtol=1e-15, atol=0)


def test_deviations_that_no_long_holds():
    x = np.array([[2**33, 0], [1, 2], [3, 4]], np.int64)
    n, sums = 3, [int(v) for v in x.sum(axis=0)]
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    fitted = whitening.Fit(n, sums, centre, [s - n * int(m) for s, m in zip(sums, centre, strict=True)], np.ones(2), np.eye(2), 2.0)
    want = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert whitening._deviation(x, fitted) == [w if w < 2**63 else None for w in want] and None in whitening._deviation(x, fitted)


def test_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=3).tolist()) for k in range(30)]
    rows = [*good, (0, good[0][1]), (None, good[1][1]), (90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [float("inf"), 1.0, 1.0]), (95, [1.0, 2.0]), (96, [1.0, 2.0])]
    frame = spark.createDataFrame([(v, e, "x", 1) for v, e in rows], "vec_id long, embedding array<double>, whitened string, n int")
    got = whitening.whiten(frame).collect()
    assert len(got) == 32 * 3 + 2 * 2
    three = [r for r in got if r["vec_id"] not in (95, 96)]
    assert {r["n"] for r in three} == {32} and {r["vec_id"] for r in three} == {*range(30), None}
    assert all(r["n"] == 2 and r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in got if r["vec_id"] in (95, 96))
    y = np.array([r["whitened"] for r in three]).reshape(-1, 3)
    assert np.allclose(y.T @ y / 32, np.eye(3), atol=1e-9) and three[0]["identity_error"] < 1e-9
    assert whitening.whiten(frame.limit(0)).collect() == []
    assert whitening.whiten(frame.where("embedding is null")).collect() == []
