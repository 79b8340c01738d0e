"""Embedding whitening: leading components of the covariance, scaled to unit variance.

Sums, centred products and projections are made in tasks over the distinct
vectors. The driver holds one matrix of dimensions x dimensions, reduces it to
tridiagonal form by Householder reflections, finds the leading eigenvalues by
bisection on Sturm counts and their vectors by inverse iteration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..cluster import scratch_path

COMPONENTS = 4
SCALE = 256
#: Eigenvalues closer than this share of the largest form a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
LONG = 1 << 63


@dataclass
class Model:
    """What the distinct vectors gave: their number, exact sums, leading eigenvalues and unit eigenvectors (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it exceeds a long.

        Arithmetic modulo 2^64 is exact below 2^63; a float tells which rows
        are, and rows near the limit are done in whole Python numbers.
        """
        rough = (((x - self.mean) * self.n) ** 2).sum(axis=1)
        t = x.astype(np.uint64) * np.uint64(self.n % (1 << 64)) - np.array([s % (1 << 64) for s in self.sums], dtype=np.uint64)
        out = (t * t).sum(axis=1, dtype=np.uint64).tolist()
        for i in np.flatnonzero(~(rough < 0.99 * LONG)).tolist():
            exact = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums))
            out[i] = exact if exact < LONG else None
        return out


def usable(vector: Column) -> Column:
    """A vector with entries, none of them null, non-finite, or too large for a long after scaling."""
    fine = F.forall(vector, lambda c: F.coalesce(c.cast("double").between(-(2.0 ** 62) / SCALE, 2.0 ** 62 / SCALE), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def grid(lists: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE x entry) as a matrix of longs."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dims)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in 16-bit numbers where all fit; equal rows give equal bytes."""
    small = (np.abs(x) < 1 << 15).all(axis=1)
    narrow = x.astype("<i2")
    return [narrow[i].tobytes() if s else x[i].astype("<i8").tobytes() for i, s in enumerate(small.tolist())]


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    return np.array([np.frombuffer(r, "<i2" if len(r) == 2 * dims else "<i8") for r in rows], dtype=np.int64).reshape(-1, dims)


def distinct_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """dims, packed: every scaled vector once. Combined inside the tasks before the shuffle, so copies of one vector do not pile up."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lengths = batch.column(0), batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                rows = pack(grid(lists.filter(pa.array(lengths == d)), d))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["dims", "packed"])

    rows = vectors.where(usable(F.col(column))).select(F.col(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(scale, "dims int, packed binary").distinct()


def _per_task(fitted: DataFrame, dims: int, schema: str, start, add, end) -> DataFrame:
    """One result of ``end`` per task, from a state that takes matrices of up to 4,096 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for first in range(0, batch.num_rows, 4_096):
                state = add(state, unpack(batch.column(0).slice(first, 4_096).to_pylist(), dims))
        yield end(state)

    return fitted.select("packed").mapInArrow(run, schema)


def exact_sums(fitted: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of every dimension, in whole numbers."""

    def add(state, x):
        safe = len(x) == 0 or float(np.abs(x).max()) * len(x) < 2.0 ** 62
        sums = x.sum(axis=0).tolist() if safe else [sum(c) for c in x.T.tolist()]
        return [state[0] + len(x), *(a + b for a, b in zip(state[1:], sums))]

    def end(state):
        return pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([Decimal(s) for s in state], pa.decimal128(38, 0))], names=["i", "s"])

    rows = _per_task(fitted, dims, "i int, s decimal(38,0)", lambda: [0] * (dims + 1), add, end).groupBy("i").agg(F.sum("s").alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), [by.get(i, 0) for i in range(dims)]


def summed_rows(fitted: DataFrame, dims: int, width: int, matrix) -> np.ndarray:
    """Sum over all vectors of ``matrix(x)`` (width x width): summed in each task, then row by row in Spark."""

    def end(state):
        return pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([r.tobytes() for r in state], pa.binary())], names=["i", "row"])

    def gather(part: pa.Table) -> pa.Table:
        rows = np.sum([np.frombuffer(r, "<f8") for r in part["row"].to_pylist()], axis=0)
        return pa.table({"i": part["i"][:1], "row": pa.array([rows.tobytes()], pa.binary())})

    parts = _per_task(fitted, dims, "i int, row binary", lambda: np.zeros((width, width)), lambda s, x: s + matrix(x), end)
    rows = parts.groupBy("i").applyInArrow(gather, "i int, row binary").collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r["i"]] = np.frombuffer(r["row"], "<f8")
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflectors that bring a symmetric matrix to tridiagonal form."""
    a, reflectors = a.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        reflectors.append(v)
        a[k + 1:, k:] -= 2 * np.outer(v, v @ a[k + 1:, k:])
        a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below each value of ``at``."""
    tiny = np.finfo(float).tiny ** 0.5 * max(1.0, float(np.abs(e).max(initial=0)))
    q = d[0] - at
    below = (q < 0).astype(np.int64)
    for i in range(1, len(d)):
        q = d[i] - at - e[i - 1] ** 2 / np.where(np.abs(q) < tiny, np.where(q < 0, -tiny, tiny), q)
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, take: int) -> np.ndarray:
    """The ``take`` largest eigenvalues, falling, each by bisection between Gershgorin bounds."""
    reach = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = np.full(take, (d - reach).min()), np.full(take, (d + reach).max() + np.finfo(float).tiny)
    rank = len(d) - 1 - np.arange(take)
    for _ in range(200):
        middle = low + (high - low) / 2
        inside = (middle > low) & (middle < high)
        if not inside.any():
            break
        left = count_below(d, e, middle) > rank
        high, low = np.where(inside & left, middle, high), np.where(inside & ~left, middle, low)
    return low + (high - low) / 2


def solve(d: np.ndarray, e: np.ndarray, at: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - at I) y = b by elimination with row exchanges; pivots of 0 become ``tiny``."""
    n = len(d)
    u, v, w, y = (d - at).tolist(), [*e.tolist(), 0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        below, follow = float(e[i]), v[i + 1]
        if abs(below) > abs(u[i]):
            u[i], below = below, u[i]
            v[i], u[i + 1] = u[i + 1], v[i]
            w[i], v[i + 1] = follow, 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        u[i] = u[i] or tiny
        f = below / u[i]
        u[i + 1] -= f * v[i]
        v[i + 1] -= f * w[i]
        y[i + 1] -= f * y[i]
    out = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        out[i] = (y[i] - v[i] * out[i + 1] - w[i] * out[i + 2]) / (u[i] or tiny)
    return np.array(out[:n])


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; inside a cluster each is kept orthogonal to those before it."""
    n, r = len(d), np.random.default_rng(0)
    norm = float(np.abs(d).max(initial=0) + 2 * np.abs(e).max(initial=0)) or 1.0
    tiny = np.finfo(float).eps * norm
    out = np.zeros((n, len(values)))
    first, used = 0, np.inf
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > CLUSTER * values[0]:
            first = k
        used = min(value, used - 4 * tiny) if k > first else value  # equal values are moved apart
        y = r.standard_normal(n)
        for _ in range(5):
            y = solve(d, e, used, y / np.linalg.norm(y), tiny)
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
        out[:, k] = y / np.linalg.norm(y)
    return out


def leading(a: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``take`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Values that are 0 up to rounding are left out. The largest entry of a vector is positive.
    """
    d, e, reflectors = tridiagonal(a)
    values = leading_values(d, e, min(take, len(a)))
    values = values[values > max(len(a) * np.finfo(float).eps * max(values.max(initial=0), 0), 0)]
    vectors = leading_vectors(d, e, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[Model, DataFrame]:
    """The model, and the distinct vectors it was fitted on as a stored table (packed).

    Vectors that are null or empty, hold null or non-finite entries, or an entry
    beyond 2^62 / 256 take no part. Where lengths differ, the length with most
    distinct vectors counts (ties: the smaller) and the others take no part.
    Without vectors, or when all are equal, the model has no components. The
    driver holds dimensions^2 numbers; that, not the rows, bounds it.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "whitening")
    distinct_vectors(vectors, column).write.parquet(path)
    stored = spark.read.parquet(path)
    top = stored.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    if top is None:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), stored
    dims = top["dims"]
    fitted = stored.where(F.col("dims") == dims)
    n, sums = exact_sums(fitted, dims)
    mean = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = summed_rows(fitted, dims, dims, products) / n
    covariance = (covariance + covariance.T) / 2
    values, columns = leading(covariance, components)
    return Model(n, sums, values, columns, float(np.trace(covariance))), fitted


def identity_error(fitted: DataFrame, model: Model) -> float:
    """Largest entry, without sign, of the covariance of the whitened distinct vectors minus the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0

    def products(x: np.ndarray) -> np.ndarray:
        y = np.column_stack([model.project(x), np.ones(len(x))])
        return y.T @ y

    total = summed_rows(fitted, model.dims, k + 1, products) / model.n
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Model, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, deviation, whitened (array, one entry per component) for every row whose vector fits the model.

    Other columns are ignored. Rows with vectors that take no part in ``fit`` are
    dropped; null ids and repeated rows stay. ``deviation`` is null where the
    exact number is too large for a long. The model that tasks get has a few
    numbers per dimension.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, deviation bigint, whitened array<double>"
    if not model.n:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    sent = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4_096):
                x = grid(batch.column(1).slice(first, 4_096), sent.value.dims)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, 4_096), pa.array(sent.value.deviation(x), pa.int64()),
                                                  pa.array(list(sent.value.project(x)), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    rows = vectors.where(usable(F.col(column)) & (F.size(column) == model.dims)).select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(apply, schema).withColumnRenamed("id", id_column)
