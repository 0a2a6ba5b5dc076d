"""Null-aware arithmetic as expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """MTH-04: null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def row_sum(cols: list[Column]) -> Column:
    """MTH-05: nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])


def row_mean(cols: list[Column]) -> Column:
    """MTH-05: mean of what is not null; null if all are."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, row_sum(cols) / n)


def all_null(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNull() for c in cols])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def day_difference(start: Column, now: Column) -> Column:
    """MTH-08: minutes from start to now on a 24-hour clock, wrapped at 12 hours either way, not below 0."""
    d = now - start
    wrapped = F.when(d < -43200, d + 86400).when(d > 43200, d - 86400).otherwise(d)
    return F.greatest(wrapped, F.lit(0)) / 60.0


def cyclic_gap(a: Column, b: Column) -> Column:
    """Seconds between two times of day, the short way round."""
    d = F.abs(a - b)
    return F.least(d, F.abs(86400 - d))
