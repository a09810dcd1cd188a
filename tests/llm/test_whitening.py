"""Whitening against an eigendecomposition of the whole covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from returnlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, most=4):
    """(n, deviation by row, whitened by row, explained) by numpy on the distinct quantised vectors."""
    kept = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > values[0] * 1e-12).sum())) if values[0] > 0 else 0
    x = np.array([x for _, x in kept])
    return kept, n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(df, rows):
    got = whitening.whiten(df).collect()
    kept, n, deviation, white, explained = brute(rows)
    k = white.shape[1]
    assert len(got) == len(kept) * k and {r.n for r in got} <= {n}
    want = sorted(((i is None, i or 0), int(d)) for (i, _), d in zip(kept, deviation))
    assert sorted({((r.vec_id is None, r.vec_id or 0), r.deviation) for r in got}) == sorted(set(want))
    for c in range(k):
        mine = [r for r in got if r.component == c + 1]
        assert math.isclose(mine[0].explained, explained[c], rel_tol=1e-6) and mine[0].identity_error < 1e-8
        a = np.array([r.whitened for r in sorted(mine, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))])
        order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, deviation[i]))
        b = white[order, c]
        assert np.allclose(a, b * np.sign(a @ b), atol=1e-7)
    return got


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(11)
    scales = np.concatenate([[3.0, 2.0, 1.5, 1.2], np.full(8, 0.2)])
    data = (random.normal(size=(400, 12)) * scales).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(data)]


def test_like_the_eigendecomposition(spark, vectors):
    odd = [(1000, None), (1001, [None] + [0.0] * 11), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (None, vectors[3][1]), (1004, [-0.0] * 12), (1005, [0.0] * 12)]
    rows = vectors + odd + [(2000 + i, vectors[0][1]) for i in range(300)] + vectors[:5]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS key", "1 AS component", "'l' AS length", "2 AS n").repartition(9)
    check(df, rows)


def test_fewer_vectors_than_dimensions(spark, vectors):
    for many in (2, 3, 6):
        check(spark.createDataFrame(vectors[:many], SCHEMA), vectors[:many])


def test_dependent_and_far_dimensions(spark, vectors):
    rows = [(i, [*v[:4], v[0], 0.0, v[1] + v[2], 1000.0 + 500 * v[3]]) for i, v in vectors]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None), (2, [])], [(1, [1.0, 2.0])] * 3, [(1, [0.001]), (2, [0.002])]):
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.count() == 0 and got.columns[0] == "vec_id"


def test_lengths_and_far_values(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [0.5, 0.0]), (4, [1.0]), (5, [1.0, 2.0, 3.0])]
    assert {r.vec_id for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 2, 3}
    far = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [4.0, 3.0]), (4, [1.0, 9.0])]
    got = whitening.whiten(spark.createDataFrame(far, SCHEMA)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4} and all(r.deviation is None for r in got if r.vec_id < 3)


def test_triangular_solve_and_shift():
    random = np.random.default_rng(2)
    r = np.triu(random.normal(size=(6, 6))) + 4 * np.eye(6)
    x = random.normal(size=(50, 6))
    assert np.allclose(whitening.solve_rows(x, r) @ r, x)
    flat = np.ones((5, 5))  # singular
    factor = whitening.shifted_cholesky(flat, 100, False)
    assert np.allclose(factor.T @ factor, flat, atol=1e-6) and np.allclose(factor, np.triu(factor))
