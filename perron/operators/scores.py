"""Composite scores as expressions over feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import row_sum

THRESHOLD = 10.0


def lag_moments(df: DataFrame) -> DataFrame:
    """Mean and population deviation of max(0, lag) over the valid lags of 1 to 7 days, made once for all scores."""
    valid = {n: F.col(f"lag_missing_j{n}") == 0 for n in range(1, 8)}
    late = {n: F.when(valid[n], F.greatest(F.col(f"retard_j_{n}"), F.lit(0.0))) for n in range(1, 8)}
    n = row_sum([v.cast("double") for v in valid.values()])
    with_n = df.withColumns({"_n": n, "_m": F.coalesce(F.try_divide(row_sum(list(late.values())), n), F.lit(0.0))})
    spread = row_sum([(c - F.col("_m")) * (c - F.col("_m")) for c in late.values()])
    return with_n.withColumn("_sd", F.sqrt(F.coalesce(F.try_divide(spread, F.col("_n")), F.lit(0.0))))


def reliability() -> Column:
    damp = F.when(F.col("_n") >= 3, F.least(F.lit(0.2), F.col("_sd") / THRESHOLD)).otherwise(0.0)
    return F.when(F.col("_n") == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), 1.0 - F.col("_m") / THRESHOLD) - damp))


def risk(mean_delay: Column, congestion: Column, active: Column, level: Column, extreme: Column, peak: Column) -> Column:
    works = F.when(active == 1, (level + 1) / 4.0).otherwise(0.0)
    return F.least(F.lit(1.0), mean_delay / THRESHOLD) * 0.35 + congestion * 0.25 + works * 0.2 + extreme * 0.1 + peak * 0.05


def stress(density_mean: Column, works: Column, extreme: Column, rain: Column, wind: Column, peak: Column) -> Column:
    weather = F.when(extreme == 1, 1.0).when(rain > 5, 0.5).when(wind > 50, 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), density_mean / 50.0) * 0.4 + F.least(F.lit(1.0), works / 3.0) * 0.3 + weather * 0.2 + peak * 0.1


def complexity(stops: Column, km: Column, hubs: Column, links: Column, position: Column) -> Column:
    one = F.lit(1.0)
    shape = (1.0 - F.abs(0.5 - position) * 2.0) * 0.5
    return (F.least(one, stops / 25.0) + F.least(one, km / 100.0) + F.least(one, hubs / 3.0) + F.least(one, links / 10.0) + shape) / 4.5
