"""Vectors and scores as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_of(a: Column, b: Column, dim: int) -> Column:
    """``dot`` of vectors of a known dimension, written out: Spark compiles it, which it doesn't do with lambdas."""
    return reduce(lambda x, y: x + y, [F.get(a, F.lit(k)) * F.get(b, F.lit(k)) for k in range(dim)])


def dots(a: Column, b: Column) -> Column:
    """``dot`` of vectors that all have the same dimension and no nulls, to the last bit: batches go through Arrow, as Spark
    doesn't compile lambdas. It can't stand inside of a lambda itself."""

    @F.arrow_udf("double")
    def products(v: pa.Array, w: pa.Array) -> pa.Array:
        total = np.zeros(len(v))
        if len(v):
            x, y = (np.asarray(z.flatten()).reshape(len(v), -1) for z in (v, w))
            for k in range(x.shape[1]):
                total += x[:, k] * y[:, k]
        return pa.array(total)

    return products(a, b)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 if either vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def provenance_score(confidence: Column, trust: Column, age_days: Column, alpha: float = 1.0, beta: float = 0.7, gamma: float = 0.3, decay_days: float = 365.0) -> Column:
    return sigmoid(alpha * confidence + beta * trust - gamma * (1 - F.exp(-age_days / decay_days)))


def to_unit_interval(c: Column) -> Column:
    """A cosine as a number from 0 to 1."""
    return (c + 1) / 2


def safe_log(p: Column, eps: float = 1e-12) -> Column:
    return F.ln(F.greatest(p, F.lit(eps)))


def belief(pos: Column, neg: Column) -> Column:
    return pos / (pos + neg + 2)


def uncertainty(pos: Column, neg: Column) -> Column:
    return 2 / (pos + neg + 2)
