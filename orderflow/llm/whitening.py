"""Embedding whitening: Welford's rank-one updates in partition iterators, merged in a tree, then a symmetric QR eigen-solve.

Each partition streams through its vectors and holds a count, a mean and a matrix of centred products. Partitions are
merged by the parallel update formula, FAN of them to a task in each round, so that one such row is left.
Vectors are whole numbers (fixed-point), so that sums and distances are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Partial results that a task merges.
FAN = 16
#: Components with a smaller share of the variance than this have none but rounding, and are left out.
NOTHING = 1e-13
#: Fixed-point numbers stay below this, so that differences of two fit a long.
MOST = 2**62
SCALE, ORIGIN, COMPONENTS = 64, 1_000_000, 16

_PARTIAL = "n long, sums array<long>, mean array<double>, products array<double>"


class Moments:
    """Count, exact sums, mean and matrix of centred products of the vectors seen so far."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, [0] * dim
        self.mean, self.products = np.zeros(dim), np.zeros((dim, dim))

    def update(self, x: np.ndarray) -> None:
        """Welford: one vector moves the mean by delta / n and adds a matrix of rank one."""
        self.n += 1
        delta = x - self.mean
        self.mean += delta / self.n
        self.products += np.multiply.outer(delta, x - self.mean)

    def merge(self, n: int, sums: list[int], mean: np.ndarray, products: np.ndarray) -> None:
        """Adds the moments of other vectors: their products, and those of the two means."""
        if n:
            delta, both = mean - self.mean, self.n + n
            self.products += products + np.multiply.outer(delta, delta) * (self.n / both * n)
            self.mean += delta * (n / both)
            self.n, self.sums = both, [a + b for a, b in zip(self.sums, sums)]

    def row(self) -> pa.RecordBatch:
        columns = [pa.array([self.n]), pa.array([self.sums], pa.list_(pa.int64())), pa.array([self.mean.tolist()]), pa.array([self.products.ravel().tolist()])]
        return pa.RecordBatch.from_arrays(columns, ["n", "sums", "mean", "products"])


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def moments(vectors: DataFrame, column: str, dim: int, scratch: Scratch, origin: int = 0) -> Moments:
    """Moments of ``column`` (arrays of ``dim`` numbers), counted from ``origin``: the mean and the sums are those of the difference.

    ``origin`` near the values keeps the doubles small; it changes no covariance.
    """

    def stream(batches):
        held = Moments(dim)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            if x.dtype == np.int64:
                x = x - origin
                held.sums = [a + int(b) for a, b in zip(held.sums, x.sum(axis=0, dtype=object if len(x) and np.abs(x).max() > 2**40 else np.int64))]
            for one in x.astype(np.float64):
                held.update(one)
        yield held.row()

    def meet(batches):
        held = Moments(dim)
        for batch in batches:
            for n, sums, mean, products in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist(), _matrix(batch.column("mean"), dim), _matrix(batch.column("products"), dim * dim)):
                held.merge(n, sums, mean, products.reshape(dim, dim))
        yield held.row()

    rows = scratch.write(vectors.select(column).mapInArrow(stream, _PARTIAL), "partial").where("n > 0")
    left = rows.count()
    while left > 1:
        left = -(-left // FAN)
        rows = rows.repartition(left).mapInArrow(meet, _PARTIAL)
    out = Moments(dim)
    for r in rows.where("n > 0").collect():  # one row
        out.merge(r["n"], list(r["sums"]), np.array(r["mean"]), np.array(r["products"]).reshape(dim, dim))
    return out


# the eigen-solve


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, second diagonal and Q of Q T Q' = ``a`` (symmetric), by Householder reflections."""
    a, n = a.astype(np.float64), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not np.any(v[1:]):
            continue
        top = -np.copysign(size, v[0])
        v[0] -= top
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = top
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by the symmetric QR algorithm.

    QR steps with Wilkinson's shift chase a bulge down the tridiagonal form; an entry of the second diagonal that is nothing
    against its neighbours splits the matrix.
    """
    d, e, q = tridiagonal(a)
    q = np.ascontiguousarray(q.T)  # a rotation changes two rows
    eps, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        e[:hi][np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a0, b0, c0 = d[k], e[k], d[k + 1]
            d[k] = c * c * a0 + 2 * c * s * b0 + s * s * c0
            d[k + 1] = s * s * a0 - 2 * c * s * b0 + c * c * c0
            e[k] = c * s * (c0 - a0) + (c * c - s * s) * b0
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


# the operator


@dataclass(frozen=True)
class Whitening:
    """What turns a vector x into whitened ones: (x - mean) @ directions, for each component that has variance."""

    n: int
    origin: int
    sums: list[int]  # of the differences from origin
    values: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers; the mean's whole part is subtracted as a whole number."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(w)) / self.n for s, w in zip(self.sums, whole)])
        return ((x - self.origin - whole).astype(np.float64) - rest) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - sums)^2, exact; null beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * int(w) for s, w in zip(self.sums, whole)]
        off = x - self.origin - whole
        far = int(np.abs(off).max()) + 1 if off.size else 0
        kind = np.int64 if (far * self.n) ** 2 * max(1, off.shape[1]) < 2**63 else object
        d = off.astype(kind) * self.n - np.array(rest, kind)
        return [int(v) if int(v) < 2**63 else None for v in (d * d).sum(axis=1)]


def fit(distinct: DataFrame, column: str, dim: int, scratch: Scratch, k: int = COMPONENTS, origin: int = 0) -> Whitening | None:
    """From each row's vector once: the ``k`` components of greatest variance, fewer if no more have any; None without rows."""
    seen = moments(distinct, column, dim, scratch, origin)
    if not seen.n:
        return None
    covariance = (seen.products + seen.products.T) / (2 * seen.n)
    values, vectors = eigen(covariance)
    total = float(np.trace(covariance))
    k = int((values[:k] > NOTHING * max(total, 1e-300)).sum())
    return Whitening(seen.n, origin, seen.sums, values[:k], values[:k] / (total or 1.0), vectors[:, :k])


def apply(rows: DataFrame, column: str, dim: int, model: Whitening) -> DataFrame:
    """``rows`` with ``deviation`` long and ``whitened`` array<double>."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(column), dim)
            white = model.whiten(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.deviation(x), pa.int64()), lists], [*batch.schema.names, "deviation", "whitened"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, deviation long, whitened array<double>")


def fixed_point(vector: Column, scale: int = SCALE, origin: int = ORIGIN) -> Column:
    """floor(scale * c) + origin of each entry, in doubles; null for vectors that are null, empty or hold null, non-finite or too large entries."""
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + origin)
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * scale) >= float(MOST - origin)))
    return F.when(F.coalesce(~bad, F.lit(False)) & (F.size(vector) > 0), scaled)


def whitened(vectors: DataFrame, scratch: Scratch, k: int = COMPONENTS, scale: int = SCALE, origin: int = ORIGIN) -> DataFrame:
    """A row for each vector of ``vectors`` (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors become whole numbers x = floor(scale * c) + origin. The covariance is that of the n distinct ones. Component 1 has the
    greatest variance. deviation is n^2 times the squared distance from the mean, exact (null beyond a long); explained a component's share of all
    variance; identity_error the largest entry of the whitened vectors' own covariance minus the identity.

    Vectors that are null, empty or hold null or non-finite entries take no part, nor do those with entries of 2^62 / scale or more, or of another length
    than the most frequent one (of equally frequent ones the longest). Null and repeated ids: each row is a row of its own.
    Repeated vectors count once in the fit and are all returned. Dimensions without variance make no component, so one
    distinct vector, or an empty table, gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), fixed_point(F.col("embedding"), scale, origin).alias("x")).where("x is not null")
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common["dim"]
    rows = rows.where(F.size("x") == dim)
    distinct = scratch.write(rows.select("x").dropDuplicates(), "distinct")
    model = fit(distinct, "x", dim, scratch, k, origin)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    check = moments(apply(distinct, "x", dim, model).select("whitened"), "whitened", len(model.values), scratch)
    error = float(np.abs(check.products / check.n - np.eye(len(model.values))).max())
    explained = F.array(*(F.lit(float(v)) for v in model.explained))
    out = apply(rows, "x", dim, model).select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("i", "v"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op12"))
