"""Vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """The vector over its length; zero vectors stay."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))
