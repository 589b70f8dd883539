"""Whitening by the exact characteristic polynomial, against plain exact arithmetic and numpy."""

from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import queries, whitening


def plain_polynomial(matrix):
    """Faddeev-LeVerrier in fractions, constant first."""
    d = len(matrix)
    m, coefficients = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (coefficients[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        coefficients.append(-sum(matrix[i][t] * m[t][i] for i in range(d) for t in range(d)) / k)
    return [int(c) for c in reversed(coefficients)]


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (5, 5), (7, 3), (9, 9)])
def test_polynomial_roots_and_vectors(spark, d, rank):
    rng = np.random.default_rng(d)
    x = rng.integers(-2000, 2000, (rank, d))
    matrix = [[int(v) for v in row] for row in x.T @ x]
    assert whitening.characteristic_polynomial(spark, matrix, per_task=2) == plain_polynomial(matrix)
    values, vectors = whitening.components(spark, matrix, d)
    exact = np.sort(np.linalg.eigvalsh(np.array(matrix, float)))[::-1]
    assert len(values) == rank and np.allclose(values, exact[:rank], rtol=1e-9)
    u = np.array(vectors)
    assert np.allclose(u @ u.T, np.eye(rank), atol=1e-12)
    assert np.allclose(np.array(matrix, float) @ u.T, u.T * values, rtol=0, atol=1e-9 * values[0])


def test_hessenberg_with_zero_pivots(spark):
    for matrix in ([[2, 0, 0, 1], [0, 3, 1, 0], [0, 1, 3, 0], [1, 0, 0, 2]], [[5, 0, 0], [0, 7, 0], [0, 0, 5]]):
        assert whitening.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)
    values, vectors = whitening.components(spark, [[5, 0, 0], [0, 7, 0], [0, 0, 5]], 3)  # a root of two
    assert values == [7, 5, 5] and np.allclose(np.array(vectors) @ np.array(vectors).T, np.eye(3))


def test_close_roots_have_their_own_vectors(spark):
    """Two eigenvalues that agree to 15 digits: doubles can't tell their vectors apart."""
    big = 10**15
    matrix = [[big + 1, 0, 1], [0, big, 0], [1, 0, big - 1]]
    values, vectors = whitening.components(spark, matrix, 3)
    t = (np.array(matrix, object) - big * np.eye(3, dtype=object)).astype(float)
    for v, u in zip([2**0.5, 0, -(2**0.5)], vectors, strict=True):
        assert np.allclose(t @ np.array(u), v * np.array(u), atol=1e-12)


def plain(vectors, k=4):
    fit = sorted({tuple(v) for v in vectors})
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    a = np.array([[n * sum(v[i] * v[j] for v in fit) - s[i] * s[j] for j in range(d)] for i in range(d)], float)
    e, u = np.linalg.eigh(a)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    y = np.array([[n * v[i] - s[i] for i in range(d)] for v in vectors], object)
    return n, [int((r * r).sum()) for r in y], (y.astype(float) @ u) / np.sqrt(e), e / np.trace(a)


def test_query_equals_numpy(spark, sf):
    rows = queries.QUERIES["op12_whitening"](spark, sf).collect()
    source = {r["vec_id"]: [int(np.floor(256 * float(c))) for c in r["embedding"]] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(source)
    n, deviation, white, explained = plain([source[i] for i in ids])
    assert len(rows) == 4 * len(ids)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    for c in range(4):
        w = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert np.allclose(w, white[:, c], atol=1e-8) or np.allclose(-w, white[:, c], atol=1e-8)
        assert got[ids[0], c + 1]["explained"] == pytest.approx(explained[c], rel=1e-9)
    assert [got[i, 1]["deviation"] for i in ids] == deviation
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


SCHEMA = "vec_id long, embedding array<float>, n int, component string, x long"


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(50, None), (51, [nan, 1.0, 2.0]), (52, [inf, 1.0, 2.0]), (53, [None, 1.0, 2.0]), (54, []), (55, [1.0]), (56, [1e30, 0.0, 0.0]),
             (None, [0.5, 0.5, -0.5]), (0, [0.25, 0.0, -0.0]), (3, rows[7][1])]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA)).collect()
    kept = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]) for i, v in rows[:40] + rows[-3:]]
    assert sorted((r["vec_id"] if r["vec_id"] is not None else -1) for r in got) == sorted([i if i is not None else -1 for i, _ in kept] * 3)
    n, deviation, _, _ = plain([v for _, v in kept])
    assert {r["n"] for r in got} == {n} == {42} and sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation)
    assert rows and got[0]["identity_error"] < 1e-9


def test_no_variance_no_rows_and_wide_values(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(i, [1.0, 2.0], 1, "c", 2) for i in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 1, "c", 2) for i in range(5)], SCHEMA)
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1) and got[0]["identity_error"] < 1e-12
    wide = spark.createDataFrame([(i, [1e15 * i, float(i % 3)], 1, "c", 2) for i in range(6)], SCHEMA)
    got = whitening.whiten(wide).collect()
    assert len(got) == 12 and all(r["deviation"] is None for r in got) and got[0]["identity_error"] < 1e-9
