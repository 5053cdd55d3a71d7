import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import queries, whitening
from kbspark.llm.bidiagonal import bidiagonal, leading, squares


def matrices():
    chance = np.random.default_rng(3)
    turn = [np.linalg.qr(chance.normal(size=(30, 30)))[0] for _ in range(2)]
    return {
        "plain": chance.normal(size=(40, 40)), "graded": np.triu(chance.normal(size=(30, 30))) * np.logspace(0, -9, 30),
        "same": np.eye(12), "zero": np.zeros((5, 5)), "one": np.array([[3.0]]), "rank one": np.outer(np.arange(1, 8), np.arange(7)),
        "repeated": np.diag([5, 5, 5, 5, 4, 4, 1, 0, 0.0]), "apart": np.diag([1.0, 4.0, 2.0]),
        "clusters": (turn[0] * np.array([5] * 6 + [4.9999999] * 4 + [1] * 20)) @ turn[1],
        "tiny gaps": np.diag(np.abs(np.arange(-10, 11)).astype(float)) + np.diag(np.ones(20), 1)}


@pytest.mark.parametrize("name", matrices())
def test_singular_values_and_vectors(name):
    square = matrices()[name]
    wanted = np.linalg.svd(square)[1] ** 2
    largest = max(1.0, wanted[0])
    assert np.abs(squares(*bidiagonal(square)[:2]) - wanted).max() <= 1e-13 * largest
    values, vectors = leading(square, 4)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
    assert np.abs(square.T @ (square @ vectors.T) - vectors.T * values).max() < 1e-13 * largest


def test_small_values_are_accurate():
    diagonal, above = np.logspace(0, -12, 13), np.logspace(-0.5, -12.5, 12)
    found = np.sqrt(squares(diagonal, above))
    # The product of all singular values is that of the diagonal, however small they are.
    assert math.isclose(np.log(found).sum(), np.log(diagonal).sum(), rel_tol=1e-13)


def slow(rows, scale=256, components=4):
    width = max([len(v) for v in rows], default=0)
    x = np.array([[math.floor(scale * c) for c in v] + [0] * (width - len(v)) for v in rows], dtype=np.int64).reshape(-1, width)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def vectors(spark, rows):
    return spark.createDataFrame([(n, v, "x", 1) for n, v in enumerate(rows)],
                                 "vec_id long, embedding array<float>, whole_numbers string, component int").repartition(5)


def check(spark, rows, tolerance=1e-9):
    table = vectors(spark, rows)
    model, fit = whitening.fitted(table)
    out = whitening.whitened(table, model, "made")
    assert out.columns == [*table.columns, "made"]
    good = [n for n, v in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    got = {row["vec_id"]: row["made"] for row in out.collect()}
    assert sorted(got) == list(range(len(rows)))
    assert all((got[n] is not None) == (n in good) for n in got)
    n, deviations, values, explained = slow([list(np.array(rows[k], dtype=np.float32).astype(float)) for k in good])
    assert model.n == n == fit.count()
    assert [got[k]["deviation"] for k in good] == deviations.tolist()
    assert np.abs(model.values / model.trace - explained).max() < 1e-9
    made = np.array([got[k]["whitened"] for k in good])
    made *= np.sign((made * values).sum(axis=0))
    assert np.abs(made - values).max() < tolerance
    assert whitening.identity_error(fit, model) < 1e-10


def sample(seed, n=300, width=9):
    chance = random.Random(seed)
    return [[chance.gauss(0.5, 0.1 + k / 5) for k in range(width)] for _ in range(n)]


def test_against_brute_force(spark):
    rows = sample(1)
    rows += rows[:40] + [rows[0]] * 100 + [None, [1.0, None] * 3, [math.nan] * 9, [math.inf] + [0.0] * 8, [0.2, -0.0, 0.1], []]
    check(spark, rows)


def test_many_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 500)
    check(spark, sample(2, 80, 5))


def test_no_variance_and_empty_tables(spark):
    for rows, width in (([], 0), ([None], 0), ([[]], 0), ([[0.5, 0.25]], 2), ([[0.5, 0.25], [0.5, 0.5]], 2)):
        table = vectors(spark, rows)
        model, fit = whitening.fitted(table)
        made = [row["made"] for row in whitening.whitened(table, model, "made").collect()]
        assert len(model.values) == width
        assert all(m is None or len(m["whitened"]) == width for m in made)
        assert whitening.identity_error(fit, model) < 1e-9
    assert sorted(m["deviation"] for m in made) == [64 ** 2, 64 ** 2]
    assert [m["whitened"][1] for m in made] == [None, None]


def test_large_numbers_stay_exact():
    model = whitening.Whitening(3, [1 << 40, 5], 1 << 41, np.zeros(0), np.zeros((0, 2)), 0.0)
    rows = np.array([[1 << 39, 2], [0, 1]])
    assert model.deviations(rows) == [None, None]
    assert model._replace(sums=[1 << 20, 5], largest=1 << 30).deviations(rows[1:]) == [(1 << 40) + 4]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op13_whitening(spark, sf).collect()
    given = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, values, explained = slow([list(row["embedding"]) for row in given])
    by_key = {(row["vec_id"], row["component"]): row for row in rows}
    assert len(by_key) == len(rows) == 4 * len(given)
    for k in range(4):
        made = np.array([by_key[row["vec_id"], k + 1]["whitened"] for row in given])
        assert min(np.abs(made - values[:, k]).max(), np.abs(made + values[:, k]).max()) < 1e-9
        assert [by_key[row["vec_id"], k + 1]["deviation"] for row in given] == deviations.tolist()
        assert all(math.isclose(by_key[row["vec_id"], k + 1]["explained"], explained[k], rel_tol=1e-9) for row in given)
    assert {row["n"] for row in rows} == {n} and max(row["identity_error"] for row in rows) < 1e-10
