"""Preparation and evaluation of series: split, scale, fill, windows, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .rows import head, last_values, sorted_codes


def split_label(t: Column, train_end: str, val_end: str, *, whole_days: bool = False) -> Column:
    """SPL-01: the bound is midnight at the start of the end day, unless ``whole_days``."""
    x = t.cast("date") if whole_days else t
    kind = "date" if whole_days else "timestamp_ntz"
    return F.when(x <= F.lit(train_end).cast(kind), "train").when(x <= F.lit(val_end).cast(kind), "val").otherwise("test")


def scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """SCL-01, AGG-12: mean and sample deviation of all columns in one pass; no deviation counts as 1."""
    row = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in by.items()})


def window_counts(df: DataFrame, key: str, length: int, stride: int = 1) -> DataFrame:
    """AGG-18: training windows that each series gives."""
    n = F.col("n")
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("windows", F.when(n >= length, F.floor((n - length) / stride) + 1).otherwise(0).cast("long"))


def long_series(df: DataFrame, key: str, least: int) -> DataFrame:
    """SER-03: rows of series with at least ``least`` rows."""
    kept = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    return df.join(kept, key, "left_semi")


def complete_days(df: DataFrame, key: str, day: str, columns: list[str], how: str = "evaluation") -> DataFrame:
    """JOI-24, WIN-09: every day from a series' first to its last, with gaps filled.

    ``evaluation``: backward within the series, then 0. ``training``: forward, then backward within the series, then the
    mean of the day over all series, then 0.
    """
    span = df.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = span.select(key, F.explode(F.sequence("a", "b")).alias(day))
    w = Window.partitionBy(key).orderBy(day)
    forward = lambda c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = lambda c: F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    whole = days.join(df, [key, day], "left")
    if how == "evaluation":
        return whole.select(key, day, *[F.coalesce(backward(c), F.lit(0.0)).alias(c) for c in columns])
    filled = whole.select(key, day, *[F.coalesce(forward(c), backward(c)).alias(c) for c in columns])
    means = filled.groupBy(day).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return filled.join(means, day, "left").select(key, day, *[F.coalesce(c, f"_{c}", F.lit(0.0)).alias(c) for c in columns])


def clean(df: DataFrame, key: str, day: str, target: str, real: list[str], categorical: list[str], ordinal: Column) -> DataFrame:
    """SER-01: numbers out of text, rows without key, day or target gone, gaps 0, of rows with equal key and day the one
    with the largest ``ordinal``. Categories below 0 are 0."""
    number = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    typed = df.select(
        F.col(key), number(day).cast("int").alias(day), number(target).cast("float").alias(target), *[F.coalesce(number(c), F.lit(0.0)).cast("float").alias(c) for c in real],
        *[F.greatest(F.coalesce(number(c), F.lit(-1.0)), F.lit(0.0)).cast("float").alias(c) for c in categorical], ordinal.alias("_ordinal"),
    )
    rest = [target, *real, *categorical]
    kept = typed.where(F.col(key).isNotNull() & F.col(day).isNotNull() & F.col(target).isNotNull())
    return kept.groupBy(key, day).agg(F.max_by(F.struct(*rest), "_ordinal").alias("s")).select(key, day, *[F.col(f"s.{c}").alias(c) for c in rest])


def series_ids(df: DataFrame, key: str) -> DataFrame:
    """SER-02: (key, unique_id), ids in sorted order from 0; the dictionary to keep with a model."""
    return sorted_codes(df, key).select(F.col("value").alias(key), F.col("code").cast("int").alias("unique_id"))


def with_ids(df: DataFrame, ids: DataFrame, key: str, day: str, target: str) -> DataFrame:
    """JOI-25: rows as (unique_id, ds, y, ...); rows whose key the dictionary lacks go."""
    return df.join(ids, key).withColumnsRenamed({day: "ds", target: "y"}).drop(key)


def matched(predictions: DataFrame, actual: DataFrame, context: DataFrame, model: str, horizon: int) -> DataFrame:
    """JOI-22/23, WIN-08: the first ``horizon`` actual rows of each series with the prediction for their day and the
    last value of the context; rows without a prediction go."""
    first = head(actual.select("unique_id", "ds", "y"), ["unique_id"], [F.col("ds")], horizon)
    both = first.join(predictions.select("unique_id", "ds", F.col(model).alias("pred")), ["unique_id", "ds"])
    return both.join(last_values(context.withColumnRenamed("y", "naive"), "unique_id", "ds", ["naive"]), "unique_id", "left")


def quality_decision(val: dict, test: dict, ratio: float = 0.99) -> tuple[bool, list[str]]:
    """EVL-04: whether a model is bad, and why, from the metrics of validation and test (mae, naive_mae, n)."""
    worse = lambda m: m.get("mae") is not None and m.get("naive_mae") is not None and m["mae"] >= ratio * m["naive_mae"]
    reasons = []
    if val.get("mae") is None or not val.get("n"):
        reasons.append("val_predictions_non_finite_or_missing")
    elif worse(val):
        reasons.append("val_not_better_than_naive")
    if test.get("n") and worse(test):
        reasons.append("test_after_val_not_better_than_naive")
    return bool(reasons), reasons


def step_budget(series: int, windows: int, *, epochs: int | None, max_steps: int = 1, batch: int = 1, devices: int = 1, windows_batch: int | None = None, by: str = "series") -> dict[str, float]:
    """SER-04: training steps of the wanted epochs, counted over series or over windows."""
    per = lambda n, size: -(-n // (max(1, size) * max(1, devices)))
    of_series, of_windows = per(series, batch), per(windows, windows_batch or batch)
    steps = max(1, of_windows if by == "windows" else of_series) * epochs if epochs and epochs > 0 else max_steps
    return {"steps_by_series": of_series, "steps_by_windows": of_windows, "max_steps": steps, "epochs_by_series": steps / of_series if of_series else 0.0, "epochs_by_windows": steps / of_windows if of_windows else 0.0}


def metrics(df: DataFrame, y: str = "y", p: str = "pred", naive: str = "naive") -> DataFrame:
    """AGG-17, EVL-01: MAE, RMSE, naive MAE on its own mask, improvement in percent, n."""
    ok = finite(F.col(y)) & finite(F.col(p))
    n_ok = finite(F.col(y)) & finite(F.col(naive))
    e = F.when(ok, F.col(p) - F.col(y))
    m = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(n_ok, F.abs(F.col(naive) - F.col(y)))).alias("naive_mae"), F.count_if(ok).alias("n"))
    return m.withColumn("improvement", F.try_divide((F.col("naive_mae") - F.col("mae")) * 100.0, F.col("naive_mae")))


def split_gaps(a: DataFrame, b: DataFrame, key: str, day: str) -> DataFrame:
    """EVL-03: series in both splits, those whose days adjoin, and the mean gap."""
    ends = a.groupBy(key).agg(F.max(day).alias("last")).join(b.groupBy(key).agg(F.min(day).alias("first")), key)
    gap = F.col("first") - F.col("last")
    return ends.agg(F.count("*").alias("series"), F.count_if(gap == 1).alias("adjoining"), F.avg(gap).alias("mean_gap"))
