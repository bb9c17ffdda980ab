"""Embedding whitening: Welford updates in the tasks, merged by the parallel formula, and a symmetric QR eigen-solve.

A partition's iterator keeps count, mean and the sum of centred products, and takes vectors in one at a time as rank-one
updates. States of partitions are merged in a tree of fixed fan-in, so that neither a task nor the driver holds more than
``FAN_IN`` of them; the last one is the driver's: the square of the vectors' length in numbers. The covariance is made
tridiagonal by Householder reflections and diagonal by implicit QR steps with Wilkinson shifts.

Vectors enter as whole numbers, floor(scale * c) + offset, whose sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import hypot, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetra.llm.shared import written

#: What a component of a vector becomes: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100000
#: A component beyond this, scaled, is no number that a double tells from its neighbours; its row takes no part.
LARGEST = float(1 << 52)
#: States that a task merges at once.
FAN_IN = 16
#: An eigenvalue below this share of the trace is none: its component has no whitened value.
NEGLIGIBLE = 1e-10
STATE = "part int, n long, mean binary, spread binary, low binary, high binary, digits array<string>"


def usable(vector: Column, dim: int) -> Column:
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < LARGEST)), F.lit(False))


def common_length(rows: DataFrame) -> int | None:
    """The length of most vectors, the smaller of equally common ones."""
    found = rows.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return found["dim"] if found else None


def integers(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(-1, dim) + OFFSET


class Welford:
    """Count, mean and centred products of vectors seen so far; ``total``, ``low`` and ``high`` are exact."""

    def __init__(self, dim: int) -> None:
        self.n, self.mean, self.spread = 0, np.zeros(dim), np.zeros((dim, dim))
        self.total = [0] * dim
        self.low, self.high = np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)

    def update(self, x: np.ndarray) -> None:
        """Takes in one vector: a rank-one update."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.spread += before[:, None] * (x - self.mean)

    def bounds(self, batch: np.ndarray) -> None:
        """Exact sums and extremes of whole vectors."""
        small = np.abs(batch).max(initial=0) < (1 << 62) // max(1, len(batch))
        sums = batch.sum(axis=0) if small else batch.astype(object).sum(axis=0)
        self.total = [a + int(b) for a, b in zip(self.total, sums, strict=True)]
        self.low, self.high = np.minimum(self.low, batch.min(axis=0)), np.maximum(self.high, batch.max(axis=0))

    def merge(self, other: Welford) -> None:
        """The parallel formula: the spreads, and the product of the means' difference."""
        n = self.n + other.n
        if not n:
            return
        apart = other.mean - self.mean
        self.spread += other.spread + np.outer(apart, apart) * (self.n / n * other.n)
        self.mean += apart * (other.n / n)
        self.n = n
        self.total = [a + b for a, b in zip(self.total, other.total, strict=True)]
        self.low, self.high = np.minimum(self.low, other.low), np.maximum(self.high, other.high)

    def row(self, part: int) -> tuple:
        return (part, self.n, self.mean.tobytes(), self.spread.tobytes(), self.low.tobytes(), self.high.tobytes(), [str(t) for t in self.total])

    @staticmethod
    def of(row: dict) -> Welford:
        mean = np.frombuffer(row["mean"])
        state = Welford(len(mean))
        state.n, state.mean, state.spread = row["n"], mean.copy(), np.frombuffer(row["spread"]).reshape(len(mean), -1).copy()
        state.low, state.high, state.total = np.frombuffer(row["low"], np.int64), np.frombuffer(row["high"], np.int64), [int(t) for t in row["digits"]]
        return state


def _state_table(rows: list[tuple]) -> dict[str, pa.Array]:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()))
    return {c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(("part", "n", "mean", "spread", "low", "high", "digits"), kinds, strict=True))}


def _states(rows: DataFrame, dim: int, vectors) -> DataFrame:
    """A state for each partition; ``vectors(batch)`` gives whole vectors, or vectors of doubles without exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Welford(dim)
        for batch in batches:
            x = vectors(batch)
            if len(x) and x.dtype == np.int64:
                state.bounds(x)
            for v in x.astype(np.float64):
                state.update(v)
        if state.n:
            yield pa.RecordBatch.from_pydict(_state_table([state.row(TaskContext.get().partitionId())]))

    return rows.mapInArrow(run, STATE)


def merged(states: DataFrame) -> Welford | None:
    """All partitions' states as one, merged in a tree in the order of the partitions."""

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        state = Welford.of(rows[0])
        for row in rows[1:]:
            state.merge(Welford.of(row))
        return pa.table(_state_table([state.row(rows[0]["part"] // FAN_IN)]))

    states = written(states)
    while (most := states.agg(F.max("part")).first()[0]) is not None and most > 0:
        states = written(states.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(join, STATE))
    found = states.collect()
    return Welford.of(found[0].asDict()) if found else None


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal q of a symmetric matrix a = q t q', by Householder reflections."""
    a, n = a.astype(np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix.

    Implicit QR steps on the tridiagonal form: rotations chase the bulge of a Wilkinson shift down the lowest block that
    has not split; off-diagonal entries next to nothing beside their neighbours are set to zero.
    """
    d, e, q = tridiagonal(a)
    q = q.T.copy()  # rows are turned, as they lie together
    end = len(d) - 1
    floor = np.finfo(float).eps * np.abs(d).max(initial=0) * 1e-3
    while end > 0:
        small = np.abs(e[:end]) <= np.finfo(float).eps * (np.abs(d[:end]) + np.abs(d[1 : end + 1])) + floor * np.finfo(float).eps
        e[:end][small] = 0.0
        if small[end - 1]:
            end -= 1
            continue
        split = np.flatnonzero(small)
        start = int(split[-1]) + 1 if len(split) else 0
        half, b = (d[end - 1] - d[end]) / 2, e[end - 1]
        shift = d[end] - b * b / (half + (1 if half >= 0 else -1) * hypot(half, b))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):
            r = hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            p, w, o = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * o + s * s * w, s * s * p - 2 * c * s * o + c * c * w
            e[k] = c * s * (w - p) + (c * c - s * s) * o
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


class Whitening:
    """Mean, components and scales fitted on all usable vectors."""

    def __init__(self, state: Welford, components: int) -> None:
        self.n, self.dim, self.total = state.n, len(state.mean), state.total
        covariance = state.spread / state.n
        covariance = (covariance + covariance.T) / 2
        values, vectors = eigen(covariance)
        trace = float(np.trace(covariance))
        self.k = min(components, self.dim)
        self.values, self.axes = values[: self.k], vectors[:, : self.k]
        self.explained = [float(v) / trace if trace > 0 else None for v in self.values]
        self.scales = [sqrt(v) if trace > 0 and v > NEGLIGIBLE * trace else None for v in self.values]
        # n * x - S stays a whole number: how large it can be decides whether 64 bits hold it and its squares' sum.
        reach = max(max(self.n * int(h) - s, s - self.n * int(w)) for w, h, s in zip(state.low, state.high, self.total, strict=True))
        largest = max(self.n * max(abs(int(w)), abs(int(h))) for w, h in zip(state.low, state.high, strict=True))
        self.plain = largest < 1 << 62 and max(map(abs, self.total)) < 1 << 62 and reach * reach * self.dim < 1 << 63

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null where that is beyond 64 bits."""
        if self.plain:
            apart = self.n * x - np.array(self.total, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        found = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.total, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in found]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values, a column for each component that has a scale, else not a number."""
        mean = np.array([s // self.n for s in self.total])  # whole part first, so that nothing is lost beside large means
        rest = np.array([(s % self.n) / self.n for s in self.total])
        out = ((x - mean) - rest) @ self.axes
        for k, scale in enumerate(self.scales):
            out[:, k] = out[:, k] / scale if scale else np.nan
        return out


def whiten(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, of another length than most, with null or non-finite components or ones beyond
    2^52 / 1024 take no part. Ids may be null or repeat: each row is whitened, and fitted on. There are as many components as
    dimensions at most. Where the fit leaves no spread along a component (equal rows, a single row), ``whitened`` is null,
    and ``explained``, too, without any spread; such components are left out of ``identity_error``, which is null if all are.
    Components of equal eigenvalues are any of their span. ``deviation`` beyond 64 bits is null. An empty table gives no rows;
    other columns are not read.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dim = common_length(rows)
    rows = rows.where(usable(F.col("v"), dim)) if dim else rows.limit(0)
    state = merged(_states(rows.select("v"), dim, lambda batch: integers(batch.column(0), dim))) if dim else None
    if state is None:
        return rows.sparkSession.createDataFrame([], out)
    fit = Whitening(state, components)
    scaled = [k for k, scale in enumerate(fit.scales) if scale]
    error = None
    if scaled:
        white = merged(_states(rows.select("v"), len(scaled), lambda batch: fit.project(integers(batch.column(0), dim))[:, scaled]))
        error = float(np.abs(white.spread / white.n - np.eye(len(scaled))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), dim)
            m, k = len(x), fit.k
            white = fit.project(x).ravel()
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, fit.n)),
                    "deviation": pa.array(fit.deviations(x), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(white, mask=np.isnan(white)),
                    "explained": pa.array(fit.explained * m, pa.float64()),
                    "identity_error": pa.array([error] * (m * k), pa.float64()),
                }
            )

    return rows.mapInArrow(run, out)
