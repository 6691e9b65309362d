"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    length = norm(left) * norm(right)
    return F.when(length > 0, dot(left, right) / length)


def similarity_score(cos: Column) -> Column:
    """The store's score scale: 0 for opposite, 1 for equal directions."""
    return (F.lit(1.0) + cos) / F.lit(2.0)
