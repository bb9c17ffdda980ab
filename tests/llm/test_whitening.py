"""Embedding whitening against numpy's own eigen-solve and exact whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetra.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors, k=8):
    """Per usable vector its deviation and its whitened values up to sign; the shares explained."""
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(axis=0)
    apart = (n * x - total).astype(float) / n
    values, axes = np.linalg.eigh(apart.T @ apart / n)
    order = np.argsort(-values)[:k]
    deviation = [int(sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True))) for row in x]
    return deviation, apart @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def wide(rows, n, k):
    """Result rows as {vec_id: (deviation, [whitened])} and the explained shares."""
    got = {}
    for r in rows:
        assert r["n"] == n
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    return {i: (c[1]["deviation"], [c[j]["whitened"] for j in range(1, k + 1)]) for i, c in got.items()}, [next(iter(got.values()))[j]["explained"] for j in range(1, k + 1)]


@pytest.mark.parametrize(("dim", "n", "scale"), [(12, 500, 1.0), (5, 60, 1.0), (3, 40, 1e9)])
def test_whitened_values(spark, dim, n, scale):
    rng = np.random.default_rng(dim)
    vectors = rng.normal(size=(n, dim)) * np.linspace(3, 1, dim) * scale + rng.normal(size=dim) * scale
    bad = [(None, None), (-1, []), (-2, [1.0] * (dim + 1)), (-3, [None, *[1.0] * (dim - 1)]), (-4, [float("nan")] * dim), (-5, [float("inf"), *[0.0] * (dim - 1)]), (-6, [1e300] * dim)]
    rows = [*[(i, v.tolist()) for i, v in enumerate(vectors)], *bad]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "n", "part", "component")}).repartition(40)
    found = whitening.whiten(table).collect()
    k = min(8, dim)
    deviation, white, explained = brute(vectors.tolist())
    got, shares = wide(found, n, k)
    assert sorted(got) == list(range(n)) and len(found) == n * k
    np.testing.assert_allclose(shares, explained, rtol=1e-9)
    fits = [d if d < 1 << 63 else None for d in deviation]
    assert [got[i][0] for i in range(n)] == fits and (scale == 1.0) == (None not in fits)
    mine = np.array([got[i][1] for i in range(n)])
    signs = np.sign((mine * white).sum(axis=0))
    np.testing.assert_allclose(mine * signs, white, rtol=1e-7, atol=1e-8)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-9


def test_no_spread(spark):
    """Equal rows, a single row, a flat direction, nothing at all."""
    for vectors in ([[1.0, 2.0]] * 4, [[1.0, 2.0]]):
        rows = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).collect()
        assert len(rows) == 2 * len(vectors) and all((r["whitened"], r["explained"], r["identity_error"], r["deviation"]) == (None, None, None, 0) for r in rows)
    flat = [(None if i % 3 else 7, [float(i), 0.5, -2.0 * i]) for i in range(30)]
    rows = whitening.whiten(spark.createDataFrame(flat, SCHEMA).repartition(7)).collect()
    assert len(rows) == 90 and all((r["whitened"] is None) == (r["component"] > 1) for r in rows)
    assert all(abs(r["identity_error"]) < 1e-9 for r in rows) and {round(r["explained"], 9) for r in rows} == {1.0, 0.0}
    for none in ([], [(1, None), (2, []), (3, [float("nan")])]):
        assert whitening.whiten(spark.createDataFrame(none, SCHEMA)).collect() == []


def test_merged_states_are_the_state_of_all():
    rng = np.random.default_rng(0)
    x = rng.integers(-600, 600, size=(999, 6)) + 100000
    state = whitening.Welford(6)
    for part in np.split(x, [0, 1, 200, 640]):
        other = whitening.Welford(6)
        if len(part):
            other.bounds(part)
        for v in part.astype(float):
            other.update(v)
        state.merge(other)
    assert state.n == 999 and state.total == x.sum(axis=0).tolist() and state.low.tolist() == x.min(axis=0).tolist()
    np.testing.assert_allclose(state.spread / 999, np.cov(x.T, bias=True), rtol=1e-10)


@pytest.mark.parametrize("kind", ["full", "rank", "diagonal", "zero", "equal"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigen(kind, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(3 * n, n)) if kind != "rank" else rng.normal(size=(3 * n, 1)) @ rng.normal(size=(1, n))
    a = {"zero": np.zeros((n, n)), "equal": np.eye(n) * 5}.get(kind, x.T @ x)
    a = np.diag(np.diag(a)) if kind == "diagonal" else a
    values, axes = whitening.eigen(a)
    np.testing.assert_allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.trace(a)))
    np.testing.assert_allclose(axes.T @ axes, np.eye(n), atol=1e-13)
    np.testing.assert_allclose(a @ axes, axes * values, atol=1e-12 * max(1, np.trace(a)))
