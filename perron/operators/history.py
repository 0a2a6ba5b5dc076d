"""Leakage-free history: calendar lags and rolling means that end the day before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LAGS
from ..functions.numeric import all_null, clip, row_mean


def delay_minutes(seconds):
    return clip(seconds / 60.0, -60.0, 240.0)


def target_minutes(seconds):
    """Delay in minutes between -20 and 240."""
    return clip(seconds / 60.0, -20.0, 240.0)


def daily_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Daily mean, sample deviation and share below 6 minutes; a null delay counts as 0 here."""
    x = F.coalesce("delay_min", F.lit(0.0))
    return df.groupBy(*keys, "d").agg(F.avg(x).alias("day_mean"), F.stddev_samp(x).alias("day_std"), F.avg((x < 6).cast("double")).alias("day_ok"))


def rolling(df: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-05..07, JOI-19: means of daily values over [d-7, d) and [d-30, d), both frames in one pass.

    Rows are reduced to days first, so a window holds one row for each day of a key.
    """
    daily = daily_stats(df, keys).withColumn("day", F.unix_date("d"))
    w = Window.partitionBy(*keys).orderBy("day")
    week, month = w.rangeBetween(-7, -1), w.rangeBetween(-30, -1)
    return daily.select(*keys, "d", F.avg("day_mean").over(week).alias("mean_7"), F.avg("day_std").over(week).alias("std_7"), F.avg("day_ok").over(week).alias("ok_7"), F.avg("day_mean").over(month).alias("mean_30"))


def lags(df: DataFrame, key: str = "hist_group_id", days: list[int] = LAGS) -> DataFrame:
    """JOI-17: mean delay of the same key n calendar days before, for all n by one exchange.

    The daily means (nulls skipped) are exploded by the lags on the history side and met by their own days.
    """
    daily = df.where(F.col(key).isNotNull()).groupBy(key, "d").agg(F.avg("delay_min").alias("m"))
    ahead = daily.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.date_add("d", n).alias("to")) for n in [0, *days]])).alias("l"), "m")
    by = ahead.groupBy(key, F.col("l.to").alias("d")).agg(F.count_if(F.col("l.n") == 0).alias("_here"), *[F.max(F.when(F.col("l.n") == n, F.col("m"))).alias(f"retard_j_{n}") for n in days])
    return by.where("_here > 0").drop("_here")


def lag_features(df: DataFrame, days: list[int] = LAGS) -> DataFrame:
    """Weekday mean before filling, missing flags, filled lags."""
    week = [F.col(f"retard_j_{n}") for n in (7, 14, 21)]
    flags = {f"lag_missing_j{n}": F.col(f"retard_j_{n}").isNull().cast("int") for n in days}
    flags |= {"lag_missing_semaine": all_null(week).cast("int"), "retard_moyen_meme_jour_semaine": row_mean(week)}
    return df.withColumns(flags).withColumns({f"retard_j_{n}": F.coalesce(f"retard_j_{n}", F.lit(0.0)) for n in days})
