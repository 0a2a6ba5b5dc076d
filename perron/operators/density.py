"""Planned traffic: distinct trains per hour on a line and still to pass each hub; congestion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CONGESTION


def line_density(df: DataFrame) -> DataFrame:
    """JOI-11 by (date, hour, line): distinct trains, a null train counted once."""
    n = F.count_distinct("train") + F.max(F.col("train").isNull().cast("int"))
    return df.groupBy("date", "hour", "line").agg(n.alias("nb_trains"))


def hub_density(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """JOI-11 by (date, hour) for all hubs at once: the rows are reduced to trains before they are counted, so several
    distinct counts need no expansion."""
    once = df.groupBy("date", "hour", "train").agg(*[F.max(c.cast("int")).alias(k) for k, c in flags.items()])
    return once.groupBy("date", "hour").agg(*[F.sum(F.coalesce(k, F.lit(0))).alias(f"densite_{k}") for k in flags])


def congestion(counts: dict[str, Column]) -> Column:
    """Weighted ratios to capacity; not capped."""
    return reduce(lambda a, b: a + b, [F.coalesce(counts[k], F.lit(0)) * (weight / capacity) for k, (capacity, weight) in CONGESTION.items()])
