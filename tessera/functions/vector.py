"""Vector functions as Column expressions over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero, null where either is null or their lengths differ (SC17)."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size > 0, F.try_divide(dot(a, b), size)).otherwise(F.when(size == 0, 0.0)))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays (SC18)."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def clamp(c: Column) -> Column:
    """Between 0 and 1; null, not-a-number and the infinities give 0 (SC23)."""
    return F.when(F.isnan(c) | c.isNull() | (F.abs(c) == float("inf")), 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def recency(at: Column, as_of: Column, half_life_days: float) -> Column:
    """``2^-(age / half life)``, the age in days (SC19)."""
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(at)) / F.lit(86400.0)
    return F.exp(F.lit(-0.6931471805599453) * days / half_life_days)
