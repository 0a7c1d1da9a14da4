"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine similarity; 0 if either norm is at most `zero`."""
    na, nb = norm(a), norm(b)
    return F.when((na <= zero) | (nb <= zero), 0.0).otherwise(dot(a, b) / (na * nb))
