"""Vector columns (arrays of numbers), computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def clamped(x: Column) -> Column:
    """x within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def is_vector(v: Column, dimension: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))
