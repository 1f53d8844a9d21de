"""Scalar, array and vector functions as expressions of built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    """Stable softmax of an array."""
    top = F.array_max(xs)
    exps = F.transform(xs, lambda x: F.exp(x - top))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, y: a + y))


def one_hot(k: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.when(c == k, 1.0).otherwise(0.0))


def argmax(xs: Column) -> Column:
    """Zero-based place of the first largest element."""
    return F.array_position(xs, F.array_max(xs)) - 1


ACTIVATIONS = {
    "sign": lambda x: F.when(x >= 0, 1.0).otherwise(-1.0),
    "heaviside": lambda x: F.when(x >= 0, 1.0).otherwise(0.0),
    "rbf": lambda x: F.exp(-x * x),
    "sine": F.sin,
    "sqrt_abs": lambda x: F.sqrt(F.abs(x)),
    "unit_interval": lambda x: F.when(F.abs(x) <= 1, 1.0).otherwise(0.0),
    "square": lambda x: x * x,
    "abs": F.abs,
}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def bucketise(x: Column, bounds: Column) -> Column:
    """How many bounds lie strictly below ``x``."""
    return F.aggregate(bounds, F.lit(0), lambda n, b: n + F.when(x > b, 1).otherwise(0))


def first_seen(walk: Column) -> Column:
    """Each element replaced by the rank of its first occurrence (from 1)."""
    return F.transform(walk, lambda x: F.size(F.array_distinct(F.slice(walk, 1, F.array_position(walk, x).cast("int")))))
