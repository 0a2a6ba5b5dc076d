"""Sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame


def parquet(df: DataFrame, path: str, *, rows_per_file: int | None = None, group_bytes: int | None = None, partition_by: tuple[str, ...] = (), level: int = 8) -> None:
    """SNK-01/02: zstd Parquet with column statistics; row groups are bounded by bytes (``group_bytes``), files by rows."""
    w = df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    if group_bytes:
        w = w.option("parquet.block.size", group_bytes)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def stream_parquet(df: DataFrame, path: str, checkpoint: str, *, level: int = 8):
    """SNK-01, STR-02: a started streaming query that appends zstd Parquet; it ends when what is there is written."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return w.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).outputMode("append").trigger(availableNow=True).start()


def csv(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """SNK-03: with a header; ``order`` restores the order of the input by its ordinal (ranges of it become files)."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def json_object(df: DataFrame, path: str, key: str, limit: int = 100_000) -> None:
    """SNK-04: rows as one JSON object by ``key``, for artifacts of at most ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    body = {str(r[key]): {k: v for k, v in r.asDict(True).items() if k != key} for r in rows}
    with open(path, "w") as f:
        json.dump(body, f, ensure_ascii=False, indent=2, sort_keys=True, default=str)
