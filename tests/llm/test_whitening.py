"""Whitening against whole-number arithmetic and a dense eigensolver, and the counts by themselves."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from octavilla.llm.common import table
from octavilla.llm.whitening import above, leading_eigenpairs, op13_embedding_whitening, whitened_rows


def symmetric(n, seed, values=None):
    rnd = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rnd.standard_normal((n, n)))
    values = rnd.standard_normal(n) if values is None else np.asarray(values, float)
    return (q * values) @ q.T, values


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.floats(-2, 2))
def test_counts_equal_the_spectrum(n, seed, shift):
    a, values = symmetric(n, seed)
    if np.abs(values - shift).min() > 1e-9:
        assert above((a + a.T) / 2, shift) == (values > shift).sum()


def test_counts_need_blocks_of_two():
    assert above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert above(np.zeros((3, 3)), 0.0) == 0 and above(np.eye(3), 0.5) == 3
    a = np.zeros((6, 6))
    a[:3, 3:] = np.arange(9).reshape(3, 3) + np.eye(3)
    assert above(a + a.T, 0.0) == 3


@pytest.mark.parametrize("values", [
    np.arange(1, 30), 10.0 ** -np.arange(12), [5, 5, 5, 4, 4, 3, 2, 1, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.25, 1e-3], [7] * 9,
    [3, 2, 0, 0, 0], [1e-20, 2e-20, 5e-20], np.linspace(1, 2, 64) ** 4])
def test_leading_pairs(values):
    a, values = symmetric(len(values), 7, values)
    a = (a + a.T) / 2
    e, v = leading_eigenpairs(a, 8)
    want = np.sort(values[values > 1e-12 * values.max()])[::-1][:8]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-13 * values.max())
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12
    assert np.abs(a @ v - v * e).max() <= 1e-13 * values.max() * len(values)
    assert (np.diff(e) <= 0).all()


def expected(vectors, most=8):
    x = [[math.floor(Fraction(float(c)) * 1024) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    z = [[n * r[i] - s[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    keep = min(most, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    centred = np.array([[c / n for c in r] for r in z])
    return n, [sum(c * c for c in r) for r in z], centred @ v[:, :keep] / np.sqrt(e[:keep]), e[:keep] / e.sum()


def compare(rows, vectors, near=1e-7):
    n, deviation, whitened, explained = expected(vectors)
    assert [r.n for r in rows] == [n] * len(vectors)
    assert [r.deviation for r in rows] == [d if d < 2**63 else None for d in deviation]
    got = np.array([r.whitened for r in rows]).reshape(len(rows), -1)
    assert got.shape == whitened.shape
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - sign * whitened).max(initial=0) < near
    for r in rows:
        assert np.allclose(r.explained, explained, rtol=1e-9) and (r.identity_error is None or r.identity_error < 1e-9)


def test_whitening_equals_whole_number_arithmetic(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((300, 12)) * np.arange(1, 13) + 5
    x[:, 11] = x[:, 0]
    bad = [None, [], [1.0, None] + [0.0] * 10, [float("nan")] * 12, [float("inf")] * 12, [1.0, 2.0]]
    rows = [(k, [float(c) for c in v], "own") for k, v in enumerate(x)] + [(None, v, "x") for v in bad]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(4)
    got = whitened_rows(vectors)
    assert got.columns == ["vec_id", "embedding", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(sorted(got.collect(), key=lambda r: r.vec_id), x)
    assert whitened_rows(vectors.limit(0)).count() == 0


def test_few_dimensions_equal_rows_and_large_entries(spark):
    def run(vectors):
        frame = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        rows = sorted(whitened_rows(frame).collect(), key=lambda r: r.vec_id)
        compare(rows, vectors)
        return rows

    rnd = np.random.default_rng(2)
    assert len(run(rnd.standard_normal((40, 3)))[0].whitened) == 3
    line = np.outer(np.arange(20), [1.0, 2, 3, 4])
    assert len(run(line)[0].whitened) == 1
    equal = run(np.ones((5, 6)))
    assert equal[0].whitened == [] and equal[0].identity_error is None and equal[0].deviation == 0
    assert run(rnd.standard_normal((1, 4)))[0].explained == []
    run(rnd.standard_normal((30, 5)) * 1e9)
    with_huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitened_rows(with_huge).collect()] == [None, None]


def test_query_equals_dense_solver(spark, sf):
    vectors = {r.vec_id: r.embedding for r in table(spark, sf, "embeddings").collect()}
    rows = op13_embedding_whitening(spark, sf).collect()
    ids = sorted(vectors)
    n, deviation, whitened, explained = expected([vectors[i] for i in ids])
    assert len(rows) == 8 * len(ids) and {r.component for r in rows} == set(range(1, 9))
    at = {i: k for k, i in enumerate(ids)}
    got = np.zeros((n, 8))
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[at[r.vec_id]]) and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - sign * whitened).max() < 1e-6
