"""Vector functions over array columns, in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def running_mean(mean: Column, n: Column, x: Column) -> Column:
    """The mean of n + 1 vectors from the mean of n."""
    return F.zip_with(mean, x, lambda m, v: (m * n + v) / (n + 1))


def unit(a: Column) -> Column:
    """a divided by its length; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def cosine_or_null(a: Column, b: Column) -> Column:
    """Null for null vectors, other lengths, zero vectors and results that are no number."""
    product = norm(a) * norm(b)
    found = F.when((F.size(a) == F.size(b)) & (product > 0), dot(a, b) / product)
    return F.when(~F.isnan(found), found)


def cosine_with_eps(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)
