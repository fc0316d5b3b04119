"""Vectors as arrays: products, norms, cosines. Null vectors give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column, floor: float = 1e-12) -> Column:
    """Of length 1; the length is bound once, as an expression inside a lambda is evaluated for every element."""
    length = F.greatest(norm(a), F.lit(floor))
    return F.get(F.transform(F.array(length), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, cut to [-1, 1]."""
    d = dot(a, b)
    return F.when(d > 1, F.lit(1.0)).when(d < -1, F.lit(-1.0)).otherwise(d)
