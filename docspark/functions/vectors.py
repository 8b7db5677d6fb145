"""Vector arithmetic on array columns, summed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalized(a: Column, dim: int | None = None, kind: str = "float") -> Column:
    """To unit length, after cutting to the leading ``dim`` elements; a zero vector stays zero. ``kind``: of the elements."""
    a = F.slice(a, 1, dim) if dim else a
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)).cast(kind))


def cosine_from_distance(distance: Column) -> Column:
    """Similarity of unit vectors from their squared distance."""
    return F.lit(1.0) - distance / 2
