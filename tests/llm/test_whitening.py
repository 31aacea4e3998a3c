"""Whitening against numpy and plain fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from plazalens.llm import whitening
from plazalens.llm.common import table


def brute(rows, many=8):
    """The exact integers of the rows, and numpy's eigenvectors of their covariance."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    total = [sum(r[i] for r in x) for i in range(d)]
    away = [[n * r[i] - total[i] for i in range(d)] for r in x]
    deviation = [sum(a * a for a in r) for r in away]
    centred = np.array([[float(Fraction(a, n)) for a in r] for r in away])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:many]
    return n, deviation, values[order], vectors[:, order], centred, float(values.sum())


def checked(got, rows, many):
    n, deviation, values, vectors, centred, trace = brute(rows, many)
    want = centred @ vectors / np.sqrt(values)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(rows) * many
    for k in range(many):
        column = np.array([by[i, k + 1].whitened for i, _ in rows])
        sign = np.sign(column @ want[:, k])
        assert np.allclose(column, sign * want[:, k], rtol=1e-7, atol=1e-7)
        assert [by[i, k + 1].deviation for i, _ in rows] == deviation
        assert {r.n for r in got} == {n}
        assert abs(by[rows[0][0], k + 1].explained / (values[k] / trace) - 1) < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_driver_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    checked(whitening.report(table(spark, "/root/testdata/sf0.001", "embeddings")).collect(), rows, 8)


def test_bad_rows_go(spark):
    rng = random.Random(2)
    good = [(i, [rng.gauss(0, 1), rng.gauss(3, 2), rng.gauss(0, 0.3)]) for i in range(200)]
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0]), (905, [1.0, 2.0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in good + bad], "vec_id long, embedding array<double>, n int, whitened string").repartition(3)
    checked(whitening.report(docs).collect(), good, 3)
    twice = whitening.report(docs.where("vec_id < 900").union(docs.where("vec_id is null"))).collect()
    assert len(twice) == 600
    for none in (docs.limit(0), docs.where("vec_id >= 900 and vec_id < 905"), docs.where("vec_id = 3"), docs.where("vec_id = 3").union(docs.where("vec_id = 3"))):
        assert whitening.report(none).collect() == []


def test_equal_and_missing_eigenvalues(spark):
    # Eigenvalues 4, 1, 1 and 0: a double root and a rank below the dimension.
    rows = [(i, [4.0 * a, 2.0 * b, 2.0 * c, 4.0 * a]) for i, (a, b, c) in enumerate((a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1))]
    got = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-12
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[1], share[2], share[3]], [32 / 40, 4 / 40, 4 / 40])


def test_huge_entries(spark):
    rows = [(i, [10.0 ** (i % 5 * 4) * (1 + i), float(-i), 1e300 if i == 7 else 0.0]) for i in range(20)]
    got = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-4
    assert {r.deviation for r in got} == {None}


@pytest.mark.parametrize("size", [1, 2, 5, 9])
def test_polynomial_and_roots(spark, size):
    rng = random.Random(size)
    base = [[rng.randrange(-50, 50) for _ in range(size)] for _ in range(size + 2)]
    matrix = [[sum(r[i] * r[j] for r in base) for j in range(size)] for i in range(size)]
    poly = whitening.characteristic(spark, matrix)
    for t in range(-2, 3):
        shifted = [[Fraction(t * (i == j) - matrix[i][j]) for j in range(size)] for i in range(size)]
        assert sum(c * t**k for k, c in enumerate(poly)) == determinant(shifted)
    roots, scale = whitening.largest_roots(poly, size)
    assert np.allclose([r / 2**scale for r in roots], np.linalg.eigvalsh(np.array(matrix, float))[::-1])


def determinant(m):
    m, out = [list(r) for r in m], Fraction(1)
    for k in range(len(m)):
        pivot = next((i for i in range(k, len(m)) if m[i][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            m[k], m[pivot], out = m[pivot], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return out


def test_multiple_roots_are_counted():
    # (t - 3)^2 (t - 1) t
    assert whitening.largest_roots([0, -9, 15, -7, 1], 4)[0].__len__() == 3
    roots, scale = whitening.largest_roots([0, -9, 15, -7, 1], 8)
    assert [round(r / 2**scale) for r in roots] == [3, 3, 1]
