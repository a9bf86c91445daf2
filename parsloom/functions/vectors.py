"""Arithmetic on vectors held as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, null where a vector is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector over its norm; a (nearly) zero vector stays."""
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: (x / n).cast("float"))).otherwise(a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
