"""Functions on columns of numeric arrays; sums run from left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalized(a: Column) -> Column:
    n = norm(a)
    n = F.when(n == 0, 1.0).otherwise(n)
    return F.transform(a, lambda x: x.cast("double") / n)


def literal(a: Column) -> Column:
    """Text form with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def not_zero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)
