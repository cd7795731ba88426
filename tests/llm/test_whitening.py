"""Whitening against exact brute force with fractions, hard spectra, odd input."""

from fractions import Fraction

import numpy as np
import pytest

from trialgrid.llm import whitening
from trialgrid.llm.whitening import Exact


def brute(rows, components=4):
    """(x of each row, n, S, covariance as fractions, eigenvalues and vectors in double) of rows (id, vector)."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    mean = [Fraction(v, n) for v in s]
    cov = [[sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n for b in range(d)] for a in range(d)]
    return kept, n, s, cov


def matrix(values, rng):
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(Exact)
    for _ in range(3):
        q = q + q @ (np.eye(d) - q.T @ q) / 2
    a = (q * np.asarray(values).astype(Exact)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 32, 32),
        np.concatenate([np.linspace(1, 1.0001, 20), np.linspace(2, 3, 12)]),  # a cluster that float32 can't tell
        np.concatenate([[5, 5 + 1e-7, 5 + 2e-7], np.logspace(-9, 0, 20)]),
        1 + 1e-6 * np.arange(24),  # one cluster of all
        np.array([3.0, 1.0]),
    ],
)
def test_eigenvectors_to_double_precision(values):
    a, q = matrix(values, np.random.default_rng(7))
    found, x = whitening.eigenvectors(a)
    order = np.argsort(-values, kind="stable")
    gap = np.abs(values[:, None] - values[None, :])[~np.eye(len(values), dtype=bool)].min() / np.abs(values).max()
    assert np.abs(found - values[order]).max() <= 4e-16 * np.abs(values).max()
    off = np.minimum(np.abs(x - q[:, order]), np.abs(x + q[:, order])).max()
    assert off <= 1e-16 + 1e-18 / gap  # what the extended precision of the matrix itself allows
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15


def test_equal_eigenvalues_end_in_an_orthonormal_basis():
    for values in (np.ones(5), np.r_[np.full(4, 2.0), np.zeros(6)], np.zeros(3)):
        a, _ = matrix(values, np.random.default_rng(1))
        found, x = whitening.eigenvectors(a)
        assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15
        assert np.abs(np.asarray(a, float) @ x - x * found).max() < 1e-15


def test_packed_vectors_tell_all_values():
    x = np.array([[0, -1, 127], [-128, 3, 4], [-129, 0, 0], [1 << 20, 2, -(1 << 31)], [(1 << 63) - 1, -(1 << 63), 5]])
    cells = whitening._pack(x)
    assert (whitening._unpack(cells, 3) == x).all() and [len(c) for c in cells] == [3, 3, 6, 12, 24]
    centre = [1, -2, 3]
    want = sum(np.outer(r, r) for r in x.astype(object) - np.array(centre, object))
    assert (whitening._products(x, centre) == want).all()


def test_against_fractions(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 6)) * [3, 1, 1, 0.5, 0.2, 0.1]
    vectors = [[float(np.float32(c)) for c in v] for v in base]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500 + i, vectors[0]) for i in range(400)] + [(9, vectors[9]), (None, vectors[3])]
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5), (904, [1.0]), (905, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, n int, component int").repartition(5)
    got = whitening.whiten_embeddings(df).collect()
    kept, n, s, cov = brute(rows)
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n} == {150}
    assert sorted(map(str, (r["vec_id"] for r in got if r["component"] == 1))) == sorted(str(i) for i, _ in rows)
    values, x = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, x = values[::-1], x[:, ::-1]
    trace = float(sum(cov[k][k] for k in range(6)))
    mean = np.array([v / n for v in s])
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, v in kept:
        deviation = sum((n * a - b) ** 2 for a, b in zip(v, s))
        for c in range(4):
            r = by[i, c + 1][0]
            want = float((np.array(v) - mean) @ x[:, c] / np.sqrt(values[c]))
            sign = signs.setdefault(c, np.sign(want * r["whitened"]) or 1)
            assert r["deviation"] == deviation and abs(r["whitened"] * sign - want) < 1e-9
            assert abs(r["explained"] / (values[c] / trace) - 1) < 1e-12
    assert {r["identity_error"] for r in got}.pop() < 1e-12


def test_odd_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten_embeddings(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten_embeddings(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    one = whitening.whiten_embeddings(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten_embeddings(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], kind)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and len(line) == 15
    huge = whitening.whiten_embeddings(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], kind)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] in (1, 2))
