"""Whitening of embeddings by principal components.

Entries are rounded to whole numbers, so that counts and sums are exact; each different vector counts once in the fit.

1. Every task sums the products of its centred vectors; the partial matrices are added up by rows of the matrix, so
   that no task holds more than one block of it besides its own.
2. The covariance, one number per pair of dimensions whatever the number of rows, goes to the driver. There
   Householder reflections bring it to tridiagonal form, bisection on Sturm counts finds the leading eigenvalues, and
   inverse iteration their vectors, orthogonalised anew within clusters of eigenvalues.
3. The components, at most ``COMPONENTS`` vectors, go to the tasks, which project every row. A pass over the fitted
   vectors measures how far the covariance of the result is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webgauge.session import materialize

COMPONENTS = 16
SCALE, SHIFT = 64.0, 1_000_000
#: Entries beyond this are no longer whole numbers that a double holds exactly.
LARGEST = float(1 << 53)
#: Eigenvalues below this share of the largest are rounding errors of zero.
LEAST = 1e-13
#: Neighbouring eigenvalues nearer than this share of the norm form a cluster.
CLUSTER = 1e-3
ROWS_AT_ONCE = 2048
WIDTHS = (1, 2, 4, 8)


def pack(x: np.ndarray) -> bytes:
    """The shortest bytes of a vector of whole numbers; equal vectors have equal bytes."""
    off = x - SHIFT
    for width in WIDTHS:
        if width == 8 or (off.min(initial=0) >= -(1 << (8 * width - 1)) and off.max(initial=0) < 1 << (8 * width - 1)):
            return bytes([width]) + off.astype(f"<i{width}").tobytes()
    raise AssertionError


def unpack(raw: list[bytes]) -> np.ndarray:
    """Rows of the whole numbers, all of one length."""
    return np.stack([np.frombuffer(r, dtype=f"<i{r[0]}", offset=1).astype(np.int64) for r in raw]) + SHIFT


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed whole numbers of each usable vector; the other rows go."""
    for batch in batches:
        vectors, kept, out, size = batch.column("vector"), [], [], []
        entries = np.floor(SCALE * vectors.values.to_numpy(zero_copy_only=False))  # null entries become NaN
        usable = np.abs(entries) < LARGEST
        ends, there = vectors.offsets.to_numpy(), vectors.is_valid().to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(there).tolist():
            own = slice(ends[k], ends[k + 1])
            if usable[own].all():
                kept.append(k)
                out.append(pack(entries[own].astype(np.int64) + SHIFT))
                size.append(len(entries[own]))
        ids = batch.column("vec_id").take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()), pa.array(size, pa.int32())], ["vec_id", "x", "size"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            yield batch, unpack(batch.column("x").to_pylist())


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, total, n): the sums of this task's vectors. Totals are exact beyond 64 bits too."""
    total, n = None, 0
    for batch, x in _pieces(batches):
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        total = (high, low) if total is None else (total[0] + high, total[1] + low)
        n += len(x)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total[0]), dtype=np.int32)), pa.array(total[0]), pa.array(total[1]), pa.array(np.full(len(total[0]), n))], ["dimension", "high", "low", "n"])


@dataclass(frozen=True)
class Centre:
    """The exact mean S / n of the fitted vectors, as whole part and rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64))

    def off(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once more than the nearest double at most."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each row, exact; null where it does not fit into a long."""
        apart = x - self.whole
        largest = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        if largest * largest * max(1, x.shape[1]) < 1 << 63:
            return ((apart * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = [sum((a * self.n - r) ** 2 for a, r in zip(row, self.rest.tolist())) for row in apart.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def _products(batches: Iterator[pa.RecordBatch], project: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(dimension, row): rows of the sum of the products of this task's projected vectors."""
    total = None
    for _, x in _pieces(batches):
        y = project(x)
        total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], ["dimension", "row"])


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of each dimension that this task holds."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("dimension").to_pylist(), batch.column("row").to_pylist()):
            row = np.frombuffer(raw)
            total[k] = total[k] + row if k in total else row
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], ["dimension", "row"])


def second_moments(fitted: DataFrame, n: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean product matrix of the projected vectors: one number per pair of dimensions."""
    partial = fitted.select("x").mapInArrow(lambda b: _products(b, project), "dimension int, row binary")
    added = partial.repartition("dimension").mapInArrow(_add_rows, "dimension int, row binary")
    rows = sorted((r["dimension"], np.frombuffer(r["row"])) for r in added.toLocalIterator())
    return np.stack([r for _, r in rows]) / n


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors that bring a symmetric matrix to that form.

    The k-th reflection acts on the dimensions after k.
    """
    a, reflections = matrix.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        norm = np.sqrt(v @ v)
        v[0] += norm if v[0] >= 0 else -norm
        length = np.sqrt(v @ v)
        v = v / length if length > 0 else v
        reflections.append(v)
        # (I - 2vv') A (I - 2vv') on the rest, as an update of rank two.
        inner = a[k + 1 :, k + 1 :]
        p = inner @ v
        w = p - (v @ p) * v
        inner -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def reflect_back(vectors: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Columns in the coordinates of the tridiagonal matrix, in those of the matrix itself."""
    out = vectors.copy()
    for k in reversed(range(len(reflections))):
        v = reflections[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of the numbers ``at``: negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diagonal[k] - at - off[k - 1] ** 2 / q
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection as far as doubles go."""
    radius = np.zeros(len(diagonal))
    radius[1:] += np.abs(off)
    radius[:-1] += np.abs(off)
    margin = 1e-12 * (np.abs(diagonal) + radius).max() + np.finfo(float).tiny
    wanted = len(diagonal) - 1 - np.arange(count)  # places among the rising eigenvalues
    low, high = np.full(count, (diagonal - radius).min() - margin), np.full(count, (diagonal + radius).max() + margin)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = count_below(diagonal, off, middle) > wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) y = right by elimination with row exchanges; vanishing pivots become ``least``."""
    n = len(diagonal)
    a, b, c = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    y = right.astype(float).copy()
    for k in range(n - 1):
        under = off[k]
        if abs(under) > abs(a[k]):
            factor, upper = a[k] / under, b[k]
            a[k], b[k], c[k] = under, a[k + 1], b[k + 1]
            a[k + 1], b[k + 1] = upper - factor * b[k], -factor * c[k]
            y[k], y[k + 1] = y[k + 1], y[k] - factor * y[k + 1]
        else:
            if abs(a[k]) < least:
                a[k] = least
            factor = under / a[k]
            a[k + 1] -= factor * b[k]
            y[k + 1] -= factor * y[k]
    if abs(a[-1]) < least:
        a[-1] = least
    y[-1] /= a[-1]
    if n > 1:
        y[-2] = (y[-2] - b[n - 2] * y[-1]) / a[n - 2]
    for k in range(n - 3, -1, -1):
        y[k] = (y[k] - b[k] * y[k + 1] - c[k] * y[k + 2]) / a[k]
    return y


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of falling eigenvalues by inverse iteration.

    Vectors of a cluster of eigenvalues are made orthogonal to those before them after every step.
    """
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    rng = np.random.default_rng(0)
    out, first, shift = np.zeros((len(diagonal), len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        shift = min(value, shift - 4 * eps * norm) if k > first else value  # equal values get shifts of their own
        y = rng.normal(size=len(diagonal))
        for _ in range(5):
            y = _solve_shifted(diagonal, off, shift, y / np.sqrt(y @ y), eps * norm)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
        out[:, k] = y / np.sqrt(y @ y)
    return out


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit vectors as columns; none for zero ones."""
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, min(count, len(matrix)))
    values = values[values > LEAST * max(values[0], 0.0)]
    return values, reflect_back(tridiagonal_vectors(diagonal, off, values), reflections)


def _whiten(batches: Iterator[pa.RecordBatch], centre: Centre, loads: np.ndarray, explained: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    k = len(explained)
    for batch, x in _pieces(batches):
        rows = len(x)
        take = pa.array(np.repeat(np.arange(rows), k))
        columns = [
            batch.column("vec_id").take(take),
            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
            pa.array(np.full(rows * k, centre.n)),
            pa.array(centre.deviations(x), pa.int64()).take(take),
            pa.array((centre.off(x) @ loads).ravel()),
            pa.array(np.tile(explained, rows)),
            pa.array(np.full(rows * k, error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten_vectors(vectors: DataFrame, *, vec: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Up to ``components`` rows per usable vector: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    An entry c becomes x = floor(64 c) + 1,000,000. The fit is over each different vector of whole numbers once: n of
    them with the sums S. ``whitened`` is x - S/n on the component, over the root of its eigenvalue; ``explained`` the
    eigenvalue's share of the trace; ``deviation`` the exact sum of (n x - S)^2, null beyond 64 bits;
    ``identity_error`` the largest entry, by size, of the covariance of the whitened fit minus the identity.

    Vectors that are null, or hold null, non-finite or entries of 2^53 / 64 or more, give no rows; nor do empty ones.
    The dimension is that of most vectors (the larger one of equally many); vectors of another length give no rows.
    Components without variance are left out, so a fit of one vector, or of none, gives an empty result. Repeated
    rows and null ids are rows like others. Other columns are not used, so their names do not matter.
    """
    source = vectors.select(F.col(vec).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    id_field = source.schema["vec_id"]
    rounded = materialize(source.mapInArrow(_round, T.StructType([id_field, T.StructField("x", T.BinaryType()), T.StructField("size", T.IntegerType())])))
    out = T.StructType([
        id_field, T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    none = vectors.sparkSession.createDataFrame([], out)
    usual = rounded.where("size > 0").groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return none
    rows = rounded.where(F.col("size") == usual["size"]).select("vec_id", "x")
    fitted = materialize(rows.select("x").distinct())
    partial = fitted.mapInArrow(_sums, "dimension int, high long, low long, n long").groupBy("dimension")
    sums = sorted(partial.agg(F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)")), F.sum("n")).collect())
    n = sums[0][3]
    centre = Centre.of(n, [int(high) * (1 << 32) + int(low) for _, high, low, _ in sums])
    covariance = second_moments(fitted, n, centre.off)
    values, vectors_ = leading_components(covariance, components)
    if not len(values):
        return none
    loads = vectors_ / np.sqrt(values)
    error = float(np.abs(second_moments(fitted, n, lambda x: centre.off(x) @ loads) - np.eye(len(values))).max())
    explained = values / np.trace(covariance)
    return rows.mapInArrow(lambda b: _whiten(b, centre, loads, explained, error), out)
