"""Vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL when a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def round_nested(values: Column, places: int = 8, depth: int = 0) -> Column:
    """Round a number, or the numbers in arrays ``depth`` levels deep."""
    if depth == 0:
        return F.round(values, places)
    return F.transform(values, lambda v: round_nested(v, places, depth - 1))
