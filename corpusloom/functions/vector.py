"""Similarity of vectors as column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    """Null elements where a vector is zero."""
    # the norm is taken once, not for each element
    return F.element_at(F.transform(F.array(F.nullif(norm(a), F.lit(0.0))), lambda n: F.transform(a, lambda x: x.cast("double") / n)), 1)


def max_sim(query: Column, page: Column) -> Column:
    """Late interaction: for each query vector its best page vector by inner product, summed."""
    best = F.transform(query, lambda q: F.array_max(F.transform(page, lambda p: dot(q, p))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def slices(a: Column, parts: int, size: int) -> Column:
    """A vector cut into parts of equal size, as a matrix."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(a, i * size + 1, size))
