"""Vector functions as columns over array<float>; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty, all zero or of another length."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where the similarity isn't defined."""
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, 1 - dot(a, b) / (norm(a) * norm(b))).otherwise(1.0)


def usable(a: Column, dim: int) -> Column:
    """Holds ``dim`` finite numbers, not all zero."""
    wrong = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(a) == dim) & ~wrong & F.exists(a, lambda x: x != 0), F.lit(False))


def mean(a: str, dim: int) -> Column:
    """Aggregate: the element-wise mean, one pass with partial aggregation."""
    return F.array(*[F.avg(F.col(a)[i].cast("double")) for i in range(dim)])
