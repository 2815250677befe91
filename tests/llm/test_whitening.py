"""Whitening: eigenvectors against numpy, the query against a plain computation, odd rows."""

import math

import numpy as np
import pytest

from sparkloom.llm import eigen
from sparkloom.llm import whitening as m


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_leading_eigenvectors(n):
    rng = np.random.default_rng(n)
    for spread in (1.0, 1e-6, 1e6):
        a = rng.normal(size=(n, n)) * spread
        a = a @ a.T
        k = min(4, n)
        values, vectors = eigen.leading(a, k)
        want = np.linalg.eigvalsh(a)[::-1][:k]
        assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * want[0])
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0]


@pytest.mark.parametrize("spectrum", [[1, 1, 1, 1, 1], [5, 5, 5, 1, 0], [2, 2 - 1e-9, 2 - 2e-9, 1, 1], [3, 0, 0, 0, 0], [1e8, 1, 1, 1e-8, 0], [0, 0, 0, 0, 0]])
def test_clusters_stay_orthogonal(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(5, 5)))
    for a in (q @ np.diag(spectrum) @ q.T, np.diag(spectrum).astype(float)):
        a = (a + a.T) / 2
        values, vectors = eigen.leading(a, 4)
        assert np.allclose(values, sorted(spectrum, reverse=True)[:4], atol=1e-13 * max(spectrum))
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * (max(spectrum) or 1)


def plain(rows, k=4):
    """Rows of the query, by numpy's own eigenvectors and exact sums."""
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [
        (i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), float((np.array(x) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c])), values[c] / np.trace(v))
        for i, x in rows
        for c in range(k)
    ]


def assert_rows(got, want):
    got, want = sorted(got, key=lambda r: (r.vec_id, r.component)), sorted(want)
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in want]
    for c in {r.component for r in got}:
        a, b = np.array([r.whitened for r in got if r.component == c]), np.array([w[4] for w in want if w[1] == c])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert all(abs(r.explained / w[5] - 1) < 1e-9 and r.identity_error < 1e-9 for r, w in zip(got, want))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert_rows(m.op13_whitening(spark, sf_dir).collect(), plain(rows))


def table(spark, tmp_path, rows, schema="vec_id long, embedding array<float>, x int, whitened string"):
    spark.createDataFrame([(i, v, 1, "w") for i, v in rows], schema).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return m.op13_whitening(spark, str(tmp_path)).collect()


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=6)]) for i in range(40)]
    hot = [(100 + i, good[0][1]) for i in range(60)]  # copies weigh once
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [1.0] * 5)]
    assert_rows(table(spark, tmp_path, good + hot + bad), plain(good + hot))


def test_tiny_tables(spark, tmp_path):
    assert table(spark, tmp_path, []) == []
    assert table(spark, tmp_path, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)]) == []
    got = table(spark, tmp_path, [(1, [0.0, 0.0]), (2, [1.0, -1.0]), (2, [1.0, -1.0]), (None, [0.5, -0.5])])  # one direction: one component
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (1, 1, 3), (2, 1, 3), (2, 1, 3)]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)


def test_large_numbers_stay_exact(spark, tmp_path):
    rows = [(0, [2.0**20, 0.0]), (1, [0.0, 2.0**21]), (2, [2.0**22, 1.0])]
    assert_rows(table(spark, tmp_path, rows), plain(rows, 2))


def test_covariance_does_not_depend_on_partitions(spark):
    x = [[int(c) for c in r] for r in np.random.default_rng(2).integers(-300, 300, (200, 5))]
    df = spark.createDataFrame([(r,) for r in x], "x array<long>")
    one, many = m.fit(df.coalesce(1)), m.fit(df.repartition(7))
    assert one.sums == many.sums and np.allclose(one.values, many.values, rtol=1e-13)
