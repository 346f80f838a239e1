import math

import numpy as np
import pytest

from promptspread.llm import whitening
from promptspread.llm.queries import QUERIES
from tests.conftest import SF_ORACLE


def check(rows, vectors, k):
    """Rows against a plain computation with whole vectors, Python integers and numpy's eigenvalues."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    centred = np.array([[(n * v - t) / n for v, t in zip(row, sums)] for row in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > d * 1e-15 * e[0]).sum()))
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
        assert r.n == n and r.identity_error <= 1e-9
        assert abs(r.explained - e[r.component - 1] / np.trace(cov)) <= 1e-12
    assert len(rows) == k * n and set(by) == {i for i, _ in vectors}
    for at, (i, _) in enumerate(vectors):
        assert by[i][1].deviation == sum((n * v - t) ** 2 for v, t in zip(x[at], sums))
        assert set(by[i]) == set(range(1, k + 1))
    w = np.array([[by[i][c].whitened for c in range(1, k + 1)] for i, _ in vectors])
    gaps = np.minimum(np.abs(np.diff(e, prepend=np.inf)), np.abs(np.diff(e, append=-np.inf)))
    for c in range(k):
        if gaps[c] > 1e-6 * e[0]:  # else any basis of the shared space is right
            theirs = centred @ u[:, c] / np.sqrt(e[c])
            assert min(np.abs(w[:, c] - theirs).max(), np.abs(w[:, c] + theirs).max()) < 1e-8 / (gaps[c] / e[0]) * 1e-3 + 1e-7
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-9


def test_query_against_plain_python(spark):
    vectors = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet").collect()
               if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    check(QUERIES["op12_whitening"](spark, SF_ORACLE).collect(), vectors, 32)


def test_result_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet")
    a = whitening.fit(*whitening._rows(df, "vec_id", "embedding", whitening.Settings()))
    b = whitening.fit(*whitening._rows(df.repartition(7), "vec_id", "embedding", whitening.Settings()))
    assert a.n == b.n and a.centre == b.centre and a.rest == b.rest and (a.values == b.values).all() and (a.vectors == b.vectors).all()


def symmetric(rng, spectrum):
    q, _ = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))
    return (q * spectrum) @ q.T


@pytest.mark.parametrize("spectrum", [
    np.arange(1, 41.0) ** 3, 10.0 ** np.arange(-9, 11), np.repeat([1.0, 2.0, 5.0], 7), 1 + 1e-13 * np.arange(30), np.append(np.zeros(20), [1.0, 1e6]),
    np.concatenate([1e4 + 1e-6 * np.arange(6), np.arange(20)]), np.array([3.0]), np.array([0.0, 0.0, 7.0])], ids=str)
def test_leading_pairs_of_hard_spectra(spectrum):
    v = symmetric(np.random.default_rng(len(spectrum)), spectrum)
    v = (v + v.T) / 2
    k = min(len(spectrum), 12)
    values, vectors = whitening.leading(v, k)
    norm = np.abs(spectrum).max()
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:k]).max() < 1e-13 * norm * len(spectrum)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * norm * len(spectrum)


def test_counts_against_all_eigenvalues():
    rng = np.random.default_rng(9)
    v = symmetric(rng, rng.normal(size=25))
    e = np.linalg.eigvalsh(v)
    diagonal, side = whitening.tridiagonal(v)
    shifts = np.concatenate([e - 1e-9, e + 1e-9, [-9, 0, 9]])
    assert whitening.above(diagonal, side, shifts).tolist() == [int((e > x).sum()) for x in shifts]
    assert np.abs(np.sort(np.linalg.eigvalsh(np.diag(diagonal) + np.diag(side, 1) + np.diag(side, -1))) - e).max() < 1e-13


def test_exact_sums_of_large_numbers():
    rng = np.random.default_rng(4)
    for size in (10, 1 << 20, 1 << 40, 1 << 60):
        y = rng.integers(-size, size, (50, 3))
        exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
        assert whitening.products(y).tolist() == exact
        assert whitening.column_sums(y).tolist() == [sum(map(int, c)) for c in y.T]
        theirs = [sum((50 * int(v) - r) ** 2 for v, r in zip(row, [1, 2, 3])) for row in y]
        assert whitening.deviations(y, 50, [1, 2, 3]) == [t if t < 2 ** 63 else None for t in theirs]


def test_odd_rows_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    good += [(100, good[0][1]), (101, [1e3, -1e3, 0.0, 0.5]), (102, [0.0, 0.0, 0.0, 0.0])]
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [1.0, float("nan"), 2.0, 3.0]), (203, [float("inf"), 1.0, 2.0, 3.0]), (204, [1.0, 2.0]), (205, []),
           (206, [1e300, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "n", 1, 0.5) for i, v in good + odd], "vec_id long, embedding array<double>, n string, component int, whitened double")
    check(whitening.whiten(df).collect(), good, 32)
    twice = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [4.0, 8.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(twice).collect()
    assert len(rows) == 3 and {r.component for r in rows} == {1} and sum(r.vec_id is None for r in rows) == 2  # one direction only


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []
