"""Whitening of embeddings: principal components from covariances by polarisation, exact up to the eigenvectors.

Entries become whole numbers, so sums are exact whatever the order of tasks. A first pass counts rows and sums each dimension. A second
takes, for every dimension and for the sum of every two dimensions, the squares of the centred values, and adds them up. The covariance
of two dimensions is half of what the variance of their sum has beyond the sum of their variances. Only these d * (d + 1) / 2 sums reach
the driver, where `eigh` gives the components; rows are projected where they lie.

Tasks centre on the whole number next to the mean, which keeps squares small; the rest r of n * x - S = n * y - r is put right at the
end, in whole numbers of any length: the sum of squares of n * y - r is n * n * sum(y * y) - n * r * r, as the y sum up to r.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How entries become whole numbers: x = floor(FACTOR * c) + SHIFT.
FACTOR, SHIFT = 64, 1_000_000
#: Products of an entry and FACTOR are held at this size; entries beyond it are no embedding's.
LARGEST = 1 << 45
COMPONENTS = 32
ROWS = 2048
#: Eigenvalues up to this share of the largest are rounding: no variance.
ROUNDING = 1e-13


def sound(value: Column) -> Column:
    """Neither NULL nor with a NULL or a number that is not finite."""
    return F.coalesce(F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """(row, dimension) whole numbers of a list column."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(FACTOR * entries), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)


def _exact(values: np.ndarray, bound: int) -> np.ndarray:
    """Values for arithmetic that reaches `bound` at most: 64 bits where that is enough, else whole numbers of any length."""
    return values if bound < 1 << 62 else values.astype(object)


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))


def _decimals(values: list) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows, and the exact sum of x in every dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in _slices(batches):
            n += batch.num_rows
            total = total + _whole(batch.column(0), dims).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), _decimals(total)], ["i", "n", "s"])

    out = (rows.select("v").mapInArrow(add, "i long, n long, s decimal(38,0)")
           .groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect())
    return out[0].n, [int(r.s) for r in out]


def polarised(y: np.ndarray) -> list[np.ndarray]:
    """For every dimension i the sums over rows of (y_i + y_j) ** 2 for j = i (of y_i ** 2 there) and all j after it."""
    y = _exact(y, 4 * _largest(y) ** 2 * max(1, len(y)))
    out = []
    for i in range(y.shape[1]):
        pair = y[:, i:] + y[:, i:i + 1]
        pair[:, 0] = y[:, i]
        out.append((pair * pair).sum(0))
    return out


def _covariances(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x, divisor n, from exact sums."""
    dims = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(dims - i, object) for i in range(dims)]
        for batch in _slices(batches):
            for i, more in enumerate(polarised(_whole(batch.column(0), dims) - np.array(middle, np.int64))):
                total[i] = total[i] + more
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), _decimals(np.concatenate(total))], ["i", "j", "s"])

    squares = {(r.i, r.j): int(r.s) for r in rows.select("v").mapInArrow(add, "i long, j long, s decimal(38,0)")
               .groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    # of n * x - S and of sums of two of them, in whole numbers
    own = [n * n * squares[i, i] - n * rest[i] ** 2 for i in range(dims)]
    out = np.zeros((dims, dims))
    for i in range(dims):
        out[i, i] = own[i] / n ** 3
        for j in range(i + 1, dims):
            both = n * n * squares[i, j] - n * (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n ** 3)
    return out


def _identity_error(rows: DataFrame, project) -> float | None:
    """Largest entry of the covariance of the whitened rows minus the identity, as measured on the rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _slices(batches):
            w = project(batch.column(0))[0]
            w = np.concatenate([np.ones((len(w), 1)), w], axis=1)
            total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], ["i", "j", "s"])

    sums = rows.select("v").mapInArrow(add, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    size = 1 + max(r.i for r in sums)
    if size == 1:
        return None
    held = np.zeros((size, size))
    for r in sums:
        held[r.i, r.j] = r.s
    mean = held[0, 1:] / held[0, 0]
    return float(np.abs(held[1:, 1:] / held[0, 0] - np.outer(mean, mean) - np.eye(size - 1)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component, numbered from 1 by
    falling eigenvalue; a component's largest entry is positive.

    Left out are vectors that are NULL, empty, hold NULL or a number that is not finite, or have not the most frequent length (of
    equally frequent ones the largest). Every row counts, also if it repeats another or has a NULL id. A component without variance
    has NULL as whitened; identity_error is over the others, and NULL if there is none. deviation is NULL where it is beyond 64
    bits. Entries whose 64-fold is beyond 2 ** 45 are held there. Further columns are not looked at. No rows give no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(value).alias("v")).where(sound(F.col("v")) & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = sizes[0].dims
    rows = rows.where(F.size("v") == dims)
    n, sums = _sums(rows, dims)
    values, axes = np.linalg.eigh(_covariances(rows, n, sums))
    order = np.argsort(-values, kind="stable")
    trace = float(values.sum())
    values, axes = np.maximum(values[order], 0.0)[:components], axes[:, order][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    alive = values > ROUNDING * max(values.max(), 1e-300)
    scaled = axes[:, alive] / np.sqrt(values[alive])
    explained = values / trace if trace > 0 else np.zeros(len(values))
    # x - S / n = (n * y - r) / n, with n * y - r a whole number
    middle = np.array([s // n for s in sums], np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]

    def project(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(whitened values, exact centred whole numbers) of vectors."""
        y = _whole(column, dims) - middle
        y = _exact(y, (n * (_largest(y) + 1)) ** 2 * dims)
        z = n * y - np.array(rest, y.dtype)
        return (z / n).astype(np.float64) @ scaled, z

    error = _identity_error(rows, project)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            white, z = project(batch.column("v"))
            count, width = len(z), len(values)
            held = np.zeros((count, width))
            held[:, alive] = white
            far = [int(d) if d < 1 << 63 else None for d in (z * z).sum(1).tolist()]
            at = np.repeat(np.arange(count), width)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(at)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                pa.array(np.full(count * width, n)), pa.array(far, pa.int64()).take(pa.array(at)),
                pa.array(held.reshape(-1), mask=np.tile(~alive, count)), pa.array(np.tile(explained, count)),
                pa.array([error], pa.float64()).take(pa.array(np.zeros(count * width, np.int64)))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(emit, schema)
