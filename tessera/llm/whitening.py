"""Whitening of embeddings by their leading principal components.

Sums and the centred covariance are partial sums of the tasks, added by dimension and by pair of dimensions; so what
reaches the driver is bounded by the square of the dimensions, whatever the number of vectors. There the covariance is
made tridiagonal by Householder reflections, its leading eigenvalues are found by bisection on Sturm counts, and their
vectors by inverse iteration, those of close eigenvalues made orthogonal to each other. The components, eight vectors,
go to the tasks as a constant, and each task projects its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
#: Entries are whole numbers of at most this size; larger ones count as this.
LARGEST = 1 << 50
#: Sums are made of two parts, so that none overflows.
LOW_BITS = 25
MAX_DIMENSIONS = 4096
#: Eigenvalues that are a smaller share of the trace are rounding errors of zero.
ZERO = 1e-12
LIMIT = 1 << 62


# ---------------------------------------------------------------- eigenvectors of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and reflectors: each reflector u acts on what follows its column as I - 2 u u'."""
    a, n, reflectors = matrix.copy(), len(matrix), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        if not x[1:].any():
            reflectors.append(None)
            continue
        x /= (top := np.abs(x).max())
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        x[0] -= alpha
        u = x / np.linalg.norm(x)
        p = 2 * a[k + 1 :, k + 1 :] @ u
        q = p - (u @ p) * u
        a[k + 1 :, k + 1 :] -= np.outer(u, q) + np.outer(q, u)
        a[k + 1, k] = alpha * top
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are less than each of ``x``: sign changes of the Sturm sequence."""
    least = np.finfo(float).tiny * max(1.0, float((e * e).max(initial=0.0)))
    q = d[0] - x
    n = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < least, -least, q)
        q = d[k] - x - e[k - 1] * e[k - 1] / q
        n += q < 0
    return n


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each by bisection until its bounds are neighbouring numbers."""
    n = len(d)
    around = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    low, high = np.full(k, (d - around).min()), np.full(k, (d + around).max())
    margin = np.finfo(float).eps * max(abs(low[0]), abs(high[0])) * n
    low, high = low - margin, high + margin
    least = np.arange(n - 1, n - 1 - k, -1)  # so many are less than the eigenvalue, if all differ
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = count_below(d, e, middle) <= least
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def solve(d: np.ndarray, e: np.ndarray, x: float, b: np.ndarray, least: float) -> np.ndarray:
    """The tridiagonal system (T - x) z = b by elimination with row exchanges; pivots of zero become ``least``."""
    n = len(d)
    rows = [[float(d[0] - x), float(e[0]) if n > 1 else 0.0, 0.0, float(b[0])]]
    for k in range(1, n):
        low = [float(e[k - 1]), float(d[k] - x), float(e[k]) if k < n - 1 else 0.0, float(b[k])]
        top = rows[-1]
        if abs(low[0]) > abs(top[0]):
            rows[-1], low, top = low, [top[0], top[1], top[2], top[3]], low
        f = low[0] / (top[0] if top[0] else least)
        rows.append([low[1] - f * top[1], low[2] - f * top[2], 0.0, low[3] - f * top[3]])
    z = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        p, q, r, c = rows[k]
        z[k] = (c - q * z[k + 1] - r * z[k + 2]) / (p if abs(p) > least else least)
    return z[:n]


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors, one a row, by inverse iteration from fixed starts. Equal values are moved apart by a rounding
    error, and vectors of values nearer than a thousandth of the matrix are made orthogonal in every round."""
    n = len(d)
    size = max(float(np.abs(d).max()), float(np.abs(e).max(initial=0.0)), np.finfo(float).tiny)
    eps = np.finfo(float).eps * size
    out, at = np.zeros((len(values), n)), np.inf
    for j, value in enumerate(values):
        at = min(float(value), at - 10 * eps)
        cluster = out[:j][np.abs(values[:j] - value) <= 1e-3 * size]
        z = np.random.default_rng(j).normal(size=n)
        for _ in range(rounds):
            z = solve(d, e, at, z / np.linalg.norm(z), eps / n)
            z /= np.abs(z).max()
            for _ in range(2):
                for c in cluster:
                    z -= (c @ z) * c
        out[j] = z / np.linalg.norm(z)
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors, one a row, the largest entry positive."""
    size = float(np.abs(matrix).max(initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((0, len(matrix)))
    d, e, reflectors = tridiagonal(matrix / size)
    values = leading_eigenvalues(d, e, min(k, len(d)))
    vectors = eigenvectors(d, e, values)
    for j in range(len(reflectors) - 1, -1, -1):
        if (u := reflectors[j]) is not None:
            vectors[:, j + 1 :] -= 2 * np.outer(vectors[:, j + 1 :] @ u, u)
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return values * size, vectors


# ---------------------------------------------------------------- on tables


def finite(vector: str) -> Column:
    """Whether a vector is there, has entries, and all of them are finite."""
    infinite = F.lit(float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == infinite)), F.lit(False))


def whole_numbers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    c = batch["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(SCALE * c) + SHIFT, -float(LARGEST), float(LARGEST)).astype(np.int64)


def sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = whole_numbers(batch, dims)
            n += len(x)
            high += (x >> LOW_BITS).sum(0)
            low += (x & ((1 << LOW_BITS) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    found = rows.select("embedding").mapInArrow(partial, "i int, n long, high long, low long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()  # one row a dimension
    total = {r["i"]: (r["high"] << LOW_BITS) + r["low"] for r in found}
    return (found[0]["n"] if found else 0), [total[i] for i in sorted(total)]


def covariance(rows: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """The covariance of the vectors, centred before they are multiplied; divisor n."""
    dims = len(mean)
    i, j = np.triu_indices(dims)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, seen = np.zeros((dims, dims)), False
        for batch in batches:
            y = whole_numbers(batch, dims) - mean
            scatter += y.T @ y
            seen = seen or len(y) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(scatter[i, j])], names=["i", "j", "v"])

    out = np.zeros((dims, dims))
    for r in rows.select("embedding").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # at most dims^2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """The sum over dimensions of (n x - total)^2 of each row, exact; null where it has more than 38 digits."""
    most = max(max(abs(n * int(a) - t), abs(n * int(b) - t)) for a, b, t in zip(x.min(0), x.max(0), total, strict=True))
    if most * most * len(total) < LIMIT and max(map(abs, total)) < LIMIT and n * int(np.abs(x).max()) < LIMIT:
        z = x * n - np.array(total, np.int64)
        return pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
    z = x.astype(object) * n - np.array(total, object)
    return pa.array([Decimal(v) if v < 10**38 else None for v in (z * z).sum(1)], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)`` for every vector of
    ``vectors(vec_id, embedding)`` and component, numbered from 1.

    An entry c counts as x = floor(1024 c) + 100000, cut to 2^50 either way. All vectors are the fit list, repeated ones
    as often as they occur. Left out are vectors that are null or empty or hold null or non-finite entries, and those
    whose length isn't the commonest one (of equally common ones the largest). ``deviation`` is null where it passes 64
    bits, ``deviation_exact`` where it passes 38 digits. There are fewer components if there are fewer dimensions or
    eigenvalues above zero; equal vectors, or one alone, have none, and so no rows. An empty table gives no rows; a
    null vec_id stays; other columns are ignored.
    """
    given = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(finite("embedding"))
    id_type = dict(vectors.dtypes)["vec_id"]
    lengths = given.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims = lengths[0]["d"] if lengths else 1
    if dims > MAX_DIMENSIONS:
        raise ValueError(f"vectors of more than {MAX_DIMENSIONS} dimensions: {dims}")
    rows = given.where(F.size("embedding") == dims)
    n, total = sums(rows, dims) if lengths else (0, [0])
    mean = np.array([t / n for t in total]) if n else np.zeros(dims)
    v = covariance(rows, n, mean) if n else np.zeros((1, 1))
    values, axes = leading_components(v, components)
    trace = float(np.trace(v))
    many = int((values > ZERO * trace).sum())
    values = values[:many]
    projection = axes[:many] / np.sqrt(values)[:, None]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) and many:
                x = whole_numbers(batch, dims)
                w = (x - mean) @ projection.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, many, dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], deviations(x, n, total), lists], names=["vec_id", "deviation_exact", "w"])

    done = stored(rows.mapInArrow(project, f"vec_id {id_type}, deviation_exact decimal(38,0), w array<double>"))
    error = identity_error(done, many)
    share = F.array(*[F.lit(float(x)) for x in values / trace]) if many else F.array().cast("array<double>")
    wide = F.col("deviation_exact")
    out = done.select("vec_id", "deviation_exact", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.when(wide < F.lit(Decimal(1 << 63)), wide).cast("long").alias("deviation"),
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_exact",
    )


def identity_error(done: DataFrame, many: int) -> float:
    """The largest absolute entry of the covariance of ``done(w)`` minus the identity."""
    if not many:
        return 0.0
    at = [F.get("w", F.lit(k)) for k in range(many)]
    mean = done.agg(*[F.avg(a) for a in at]).first()
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    c = done.agg(*[F.avg((at[i] - F.lit(mean[i])) * (at[j] - F.lit(mean[j]))) for i, j in pairs]).first()
    return float(max(abs(v - (i == j)) for v, (i, j) in zip(c, pairs, strict=True)))
