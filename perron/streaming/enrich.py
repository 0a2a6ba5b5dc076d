"""STR-01: stateless enrichment of a stream, and statistics kept over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import enrich


def enrich_stream(rows: DataFrame, grid: DataFrame, on: list[str]) -> DataFrame:
    """Stream-static left join with a resolved weather grid; works the same on a batch."""
    return rows.join(grid, on, "left")


def enrich_files(stream: DataFrame, mapping: DataFrame, weather: DataFrame, path: str, checkpoint: str):
    """STR-01: raw rows as a stream with the 18 weather columns; each micro-batch becomes CSV files in the order of its
    input. Returns the started query, which ends when what is there is written; a repeated batch replaces its files."""

    def each(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("_ordinal", F.monotonically_increasing_id())
        ordered = enrich(numbered, mapping, weather).orderBy("_ordinal").drop("_ordinal")
        ordered.write.mode("overwrite").option("header", True).csv(f"{path}/batch-{number:06d}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """STR-03: count, mean and population variance of each key, for complete mode."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))


def windowed_delays(rows: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Hourly mean delays with a watermark, for append mode."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean_delay"))
