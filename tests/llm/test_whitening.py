"""Whitening against sums of Python integers, and odd tables."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.llm import whitening as W

SHAPE = "vec_id bigint, embedding array<float>, label int"


def number(c):
    return min(max(math.floor(64 * float(c)), -(2**63)), 2**63 - 1 - W.OFFSET) + W.OFFSET


@pytest.mark.parametrize("scale,rows,dims", [(0.3, 1, 3), (0.3, 64, 5), (5.0, 1000, 8), (1e6, 130, 4), (1e17, 70, 3), (0.0, 10, 2)])
def test_cross_products_are_exact(scale, rows, dims):
    rng = np.random.default_rng(rows)
    y = W.whole(rng.normal(0, 1, (rows, dims)) * scale)
    sums, products = W.cross_products(y)
    ints = [[int(v) for v in row] for row in y]
    assert [int(s) for s in sums] == [sum(r[i] for r in ints) for i in range(dims)]
    for i in range(dims):
        for j in range(dims):
            assert products[i, j] == sum(r[i] * r[j] for r in ints)


def test_whole_numbers_saturate():
    c = np.array([[1e300, -1e300, 0.0156, -0.0001, 3.0, 2.0**57 - 4096, -(2.0**57)]])
    assert W.whole(c)[0].tolist() == [number(v) - W.OFFSET for v in c[0]]


def check(rows, found, dims, components):
    """Rows of whitened() against exact arithmetic over the same vectors."""
    xs = {k: [number(c) for c in np.asarray(v, np.float32)] for k, v in rows}
    n, sums = len(rows), [sum(x[i] for x in xs.values()) for i in range(dims)]
    cov = np.array([[float(Fraction(n * sum(x[i] * x[j] for x in xs.values()) - sums[i] * sums[j], n * n)) for j in range(dims)] for i in range(dims)])
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(found) == n * min(dims, components)
    by_row = {}
    for r in found:
        x = xs[r["vec_id"]]
        exact = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
        assert r["n"] == n and int(r["deviation_exact"]) == exact and r["deviation"] == (exact if exact < 2**63 else None)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-9
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    k = min(dims, components)
    w = np.array([[by_row[i][c + 1] for c in range(k)] for i, _ in rows])
    w -= w.mean(axis=0)
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    # the projections are those of the leading eigenvectors: the space they span gives back V
    centred = np.array([[float(Fraction(n * v - s, n)) for v, s in zip(xs[i], sums, strict=True)] for i, _ in rows])
    directions = centred.T @ w / n / np.sqrt(values[:k])
    assert np.abs(cov @ directions - directions * values[:k]).max() < 1e-8 * values[0]


@pytest.mark.parametrize("dims,components,scale", [(6, 32, 1.0), (40, 32, 0.3), (5, 3, 3e5)])
def test_whitened_equals_exact_arithmetic(spark, dims, components, scale):
    rng = np.random.default_rng(dims)
    mix = rng.normal(0, 1, (dims, dims))
    vectors = (rng.normal(0, 1, (300, dims)) @ mix * scale).astype(np.float32)
    rows = [(i, [float(v) for v in vectors[i % 250]]) for i in range(300)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SHAPE).repartition(7)
    check(rows, W.whitened(df, components).collect(), dims, components)


def test_odd_embeddings(spark):
    """Nulls, bad entries, other lengths, repeated and null ids, clashing columns, empty tables."""
    rng = random.Random(1)
    good = [(i, [rng.gauss(0, 1) for _ in range(4)], 1) for i in range(40)]
    odd = [
        (100, None, 1),
        (101, [], 1),
        (102, [1.0, None, 2.0, 3.0], 1),
        (103, [1.0, float("nan"), 2.0, 3.0], 1),
        (104, [1.0, float("-inf"), 2.0, 3.0], 1),
        (105, [1.0, 2.0], 1),
        (106, [1.0] * 5, 1),
    ]
    df = spark.createDataFrame(good + odd, SHAPE).repartition(3)
    for name in ["n", "component", "vector", "dims", "rows", "i", "j", "high", "low", "at", "whitened"]:
        df = df.withColumn(name, F.lit("x"))
    check([r[:2] for r in good], W.whitened(df).collect(), 4, 32)
    again = spark.createDataFrame([(None, [1.0, 2.0], 0), (None, [2.0, 1.0], 0), (3, [2.0, 1.0], 0), (3, [2.0, 1.0], 0)], SHAPE)
    assert sorted((r["vec_id"] or 0, r["component"]) for r in W.whitened(again).collect()) == [(0, 1), (0, 1), (0, 2), (0, 2), (3, 1), (3, 1), (3, 2), (3, 2)]
    for rows in ([], [(1, None, 0)]):
        empty = W.whitened(spark.createDataFrame(rows, SHAPE))
        assert empty.collect() == [] and empty.columns == W.whitened(again).columns


def test_components_without_variance(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(9)], SHAPE)
    for r in W.whitened(same).collect():
        assert (r["whitened"], r["explained"], r["identity_error"], r["deviation"], r["n"]) == (None, None, 0.0, 0, 9)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)], SHAPE)
    found = W.whitened(line).collect()
    assert {r["component"] for r in found if r["whitened"] is not None} == {1}
    assert {round(r["explained"], 9) for r in found} == {1.0, 0.0}
    assert all(r["identity_error"] < 1e-12 for r in found)


def test_large_numbers(spark):
    """Entries near and beyond a long, where deviations take more than a long."""
    rows = [(1, [1e30, 2.0]), (2, [-1e30, 3.0]), (3, [5.0, 4.0]), (4, [1e12, 9.0])]
    xs = {k: [number(c) for c in np.asarray(v, np.float32)] for k, v in rows}
    sums = [sum(x[i] for x in xs.values()) for i in range(2)]
    for r in W.whitened(spark.createDataFrame([(*r, 0) for r in rows], SHAPE)).collect():
        exact = sum((4 * v - s) ** 2 for v, s in zip(xs[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (exact if exact < 2**63 else None)
        assert r["deviation_exact"] == (exact if exact < 2**124 and exact < 10**38 else None)
    wide = [(i, [1000.0 * i, 1.0]) for i in range(50)]
    for r in W.whitened(spark.createDataFrame([(*r, 0) for r in wide], SHAPE)).collect():
        x = 64 * 1000 * r["vec_id"]
        assert r["deviation"] == (50 * x - 64 * 1000 * 49 * 25) ** 2
