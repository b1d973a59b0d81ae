"""Whitening of embeddings: leading components by FEAST contour integration.

The covariance has dim x dim entries whatever the number of rows. Inertia counts (how
many eigenvalues lie above a shift) cut its spectrum into intervals with a few
eigenvalues each. For every interval a quadrature along a circle around it, of solves
with complex shifts, projects a block of vectors onto the eigenvectors inside;
Rayleigh-Ritz extracts them and their number is checked against the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType, DoubleType, IntegerType, LongType, StructField, StructType,
)

from .common import map_batches, written
from .vectors import finite, parts, total, usual_length

SCALE, SHIFT = 64, 1_000_000  # fixed values of the contract
COMPONENTS = 16
# Beyond this a component times SCALE is no exact integer any more.
LARGEST = float(1 << 52)
EPS = float(np.finfo(float).eps)
# Eigenvalues closer than this part of the norm are one group: their vectors are any basis of it.
CLOSE = 1e-10


@dataclass(frozen=True)
class Contour:
    """`nodes` of the half circle, `block` eigenvalues an interval, refinements until `tolerance`."""

    nodes: int = 8
    block: int = 8
    rounds: int = 60
    tolerance: float = 8 * EPS  # of the norm, for every dimension


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and lower diagonal of a tridiagonal matrix similar to the symmetric `v`."""
    a, n = v.copy(), len(v)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        x[0] += np.copysign(size, x[0])
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x /= norm
        inner = a[k + 1 :, k + 1 :]
        p = inner @ x
        w = p - (x @ p) * x
        inner -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def negligible(v: np.ndarray) -> float:
    """Eigenvalues up to here are rounding: there is nothing to whiten."""
    return len(v) * EPS * float(np.trace(v))


def inertia(diagonal: np.ndarray, lower: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: the positive pivots of the factored T - shift."""
    least = EPS * max(np.abs(diagonal).max(), np.abs(lower).max(initial=0.0)) * EPS + np.finfo(float).tiny
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(np.int64)
    for d, e in zip(diagonal[1:], lower, strict=True):
        pivot = d - shifts - e * e / np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot > 0
    return count


def intervals(v: np.ndarray, wanted: int, block: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) from the top down, until `wanted` eigenvalues are covered.

    Each holds at most `block` eigenvalues, unless closer ones cannot be told apart, and
    ends in a gap that is wide for its width: the contour stays clear of all others.
    Eigenvalues within rounding of zero are not counted.
    """
    diagonal, lower = tridiagonal(v)
    above = lambda x: inertia(diagonal, lower, np.atleast_1d(x))
    reach = float(np.abs(v).sum(axis=1).max())
    close = CLOSE * reach
    wanted = min(wanted, int(above(negligible(v))[0]))
    # Bisection for all ranks at once: the r-th eigenvalue lies between under[r] and over[r].
    ranks = np.arange(min(len(v), wanted + block + 1))
    under, over = np.full(len(ranks), -reach - close), np.full(len(ranks), reach + close)
    for _ in range(64):
        middle = (under + over) / 2
        beyond = above(middle) <= ranks
        over, under = np.where(beyond, middle, over), np.where(beyond, under, middle)
    found, done, high = [], 0, reach + 2 * close
    while done < wanted:
        last = np.arange(done, min(done + block, len(under)))  # the interval's smallest eigenvalue
        after = np.append(over, under[-1] - (over[done] - under[-1]) - reach)[last + 1]  # the next one
        gaps = under[last] - after
        fit = gaps / (over[done] - after + close)
        good = np.flatnonzero((fit > 0.1) & (gaps > close))
        at = int(good[-1]) if len(good) else int(np.argmax(np.where(gaps > close, fit, 0)))
        low, gap = (under[last[at]] + after[at]) / 2, gaps[at]
        if gaps.max() <= close:  # one tight group: take all of it
            low, gap = under[last[-1]] - close, close
            while above(low)[0] != above(low - close)[0]:
                low -= close
        count = int(above(low)[0])
        found.append((float(low), float(min(high, over[done] + gap / 2)), count - done))
        done, high = count, low
    return found


def feast(v: np.ndarray, low: float, high: float, count: int, how: Contour = Contour()) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues of the symmetric `v` between the bounds, falling, and their unit vectors.

    Raises if another number is found: eigenpairs are missing or counted twice.
    """
    n, scale = len(v), float(np.abs(v).sum(axis=1).max()) or 1.0
    middle, radius = (low + high) / 2, max((high - low) / 2, 4 * EPS * scale)
    # Gauss-Legendre points on the upper half circle; the lower half is its conjugate.
    points, weights = np.polynomial.legendre.leggauss(how.nodes)
    angles = np.pi * (points + 1) / 2
    shifts = middle + radius * np.exp(1j * angles)
    size = min(n, max(2 * count, count + how.block))
    basis = np.random.default_rng(0).standard_normal((n, size))
    identity = np.eye(n)
    best = np.inf
    for _ in range(how.rounds):
        projected = np.zeros_like(basis)
        for shift, angle, weight in zip(shifts, angles, weights, strict=True):
            solved = np.linalg.solve(shift * identity - v, basis.astype(complex))
            projected += weight / 2 * np.real(radius * np.exp(1j * angle) * solved)
        q, _ = np.linalg.qr(projected)
        values, vectors = np.linalg.eigh(q.T @ v @ q)
        basis = q @ vectors
        residuals = np.linalg.norm(v @ basis - basis * values, axis=0)
        # Values of no eigenvalue can fall inside by chance; they have large residuals.
        true = (values > low) & (values <= high) & (residuals <= how.tolerance * n * scale)
        if true.sum() == count:
            worst = residuals[true].max(initial=0.0)
            if worst > best / 2:
                break
            best, e, picked = worst, values[true], basis[:, true]
    if np.isinf(best):
        raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, contour integration finds {true.sum()}")
    return e[::-1].copy(), picked[:, ::-1].copy()


def components(
    spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS, how: Contour = Contour()
) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a covariance, falling, and their unit vectors as columns.

    Every interval is a task of its own. Eigenvalues within rounding of zero are left
    out. Each vector's largest entry is positive.
    """
    cuts, n, flat = intervals(v, wanted, how.block) if v.any() else [], len(v), v.tobytes()
    if not cuts:
        return np.zeros(0), np.zeros((n, 0))
    schema = StructType(
        [StructField("high", DoubleType()), StructField("values", BinaryType()), StructField("vectors", BinaryType())]
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.frombuffer(flat).reshape(n, n)
        for batch in batches:
            for row in batch.to_pylist():
                e, q = feast(matrix, row["low"], row["high"], row["count"], how)
                columns = [pa.array([row["high"]]), pa.array([e.tobytes()]), pa.array([q.tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts), "low")
    found = sorted(map_batches(rows, solve, schema).collect(), key=lambda r: -r["high"])
    e = np.concatenate([np.frombuffer(bytes(r["values"])) for r in found])
    q = np.hstack([np.frombuffer(bytes(r["vectors"])).reshape(n, -1) for r in found])
    kept = (np.arange(len(e)) < wanted) & (e > negligible(v))
    e, q = e[kept], q[:, kept]
    return e, q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)


def _fitting(vector: Column) -> Column:
    largest = F.lit(LARGEST / SCALE)
    return finite(vector) & F.forall(vector, lambda c: F.abs(c.cast("double")) < largest)


def quantised(rows: DataFrame, dim: int, vector_column: str) -> DataFrame:
    """`id` and `x`: floor(64 c) of every component, little-endian, in as few bytes as the row needs."""
    schema = StructType([rows.schema["id"], StructField("x", BinaryType())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, dim):
            vectors = batch.column(vector_column)
            flat = np.asarray(vectors.flatten().cast(pa.float64()))
            x = np.floor(SCALE * flat.reshape(-1, dim)).astype("<i8")
            most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
            packed = [
                r.astype("<i2").tobytes() if m < 1 << 15 else r.astype("<i4").tobytes() if m < 1 << 31 else r.tobytes()
                for r, m in zip(x, most.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=schema.names)

    return map_batches(rows, make, schema)


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The integers of `quantised`, a row a vector."""
    out = np.empty((len(column), dim), dtype=np.int64)
    widths = np.asarray(pc.binary_length(column)) // max(1, dim)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        data = b"".join(x.as_buffer() for x in column.take(pa.array(rows)))
        out[rows] = np.frombuffer(data, dtype=f"<i{width}").reshape(-1, dim)
    return out


@dataclass(frozen=True)
class Fit:
    """`n` vectors with the exact `sums` of their integers (without SHIFT), eigenvalues and components."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly: as 64-bit integers, or Python's where those are too small."""
        most = max(1, int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0) // self.n + 1)
        if 2 * most * self.n < 1 << 62:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self._centred(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The exact sums of squares of n*x - S; null beyond a long."""
        d = self._centred(x)
        if d.dtype != object and d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 1 << 62:
            return pa.array((d * d).sum(axis=1))
        found = [int(s) for s in (d.astype(object) ** 2).sum(axis=1)]
        return pa.array([s if s < 1 << 63 else None for s in found], pa.int64())

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, dim: int, wanted: int = COMPONENTS, how: Contour = Contour()) -> tuple[Fit, float]:
    """The components of the different vectors `x`, and the largest error of their whitened covariance."""
    once = written(vectors.select("x").distinct(), "different_vectors")
    n = once.count()
    if not n:
        return Fit(0, [], 0.0, np.zeros(0), np.zeros((dim, 0))), 0.0

    def halves(batch: pa.RecordBatch) -> np.ndarray:
        # In two parts of 26 bits: their sums fit 64 bits over 2^37 vectors.
        x = _unpacked(batch.column("x"), dim)
        return np.stack([(x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)])

    high, low = total(once, halves, np.zeros((2, dim), dtype=np.int64), dim)
    sums = [(int(h) << 26) + int(w) for h, w in zip(high, low, strict=True)]
    plain = Fit(n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)))

    def products(batch: pa.RecordBatch) -> np.ndarray:
        d = plain.centred(_unpacked(batch.column("x"), dim))
        return d.T @ d

    v = total(once, products, np.zeros((dim, dim)), dim) / n
    v = (v + v.T) / 2
    e, q = components(vectors.sparkSession, v, wanted, how)
    found = Fit(n, sums, float(np.trace(v)), e, q)
    k = len(e)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = found.whitened(_unpacked(batch.column("x"), dim))
        return np.vstack([w.T @ w, w.sum(axis=0)])

    if not k:
        return found, 0.0
    both = total(once, moments, np.zeros((k + 1, k)), dim) / n
    # The whitened vectors are centred already; their mean is rounding.
    error = np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max()
    return found, float(error)


def whiten(
    rows: DataFrame,
    *,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    wanted: int = COMPONENTS,
    how: Contour = Contour(),
) -> DataFrame:
    """Every usable row's projection on each of the `wanted` largest components.

    Columns: the id, `component` (from 1), `n`, `deviation`, `whitened`, `explained`,
    `identity_error`. A vector's components c count as x = floor(64 c) + 1000000. The
    covariance is that of the different x, each once, however many rows share it.

    Left out are rows whose vector is null, has null or non-finite components or any of
    2^46 and more, or another length than most vectors have (of two lengths that are
    equally frequent the larger stays). Components without variance are left out, so
    there are fewer than `wanted` where the vectors have lower rank, and no rows where
    all are equal or the table is empty. `deviation` is null where it exceeds a long.
    Null and repeated ids are rows like any other; other columns are not read.

    What leaves the executors are sums of dim x dim numbers.
    """
    source = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).where(_fitting(F.col("vector")))
    dim = usual_length(source, "vector")
    packed = quantised(source.where(F.size("vector") == dim), dim, "vector")
    found, error = fit(packed, dim, wanted, how)
    k = len(found.values)
    schema = StructType(
        [
            StructField(id_column, rows.schema[id_column].dataType),
            StructField("component", IntegerType()),
            StructField("n", LongType()),
            StructField("deviation", LongType()),
            StructField("whitened", DoubleType()),
            StructField("explained", DoubleType()),
            StructField("identity_error", DoubleType()),
        ]
    )

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = found.values / found.trace if k else found.values
        for batch in parts(batches, max(dim, 8 * k)):
            if not batch.num_rows or not k:
                continue
            x = _unpacked(batch.column("x"), dim)
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, found.n)),
                    found.deviations(x).take(each),
                    pa.array(found.whitened(x).ravel()),
                    pa.array(np.tile(share, size)),
                    pa.array(np.full(size * k, error)),
                ],
                names=schema.names,
            )

    return map_batches(packed, project, schema)
