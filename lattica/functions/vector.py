"""Vector arithmetic on ``array`` columns, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(v: Column) -> Column:
    """The vector over its norm, which is at least 1e-12."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def weighted_distance(a: Column, b: Column, weights: Column) -> Column:
    """Square root of the weighted sum of squared differences."""
    squares = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), weights, lambda d, w: w * d)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def usable(v: Column) -> Column:
    """Whether a vector has elements, all of them finite."""
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
