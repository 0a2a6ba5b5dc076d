"""Vectors that take part in a search, and arrays to and from Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_column: str, vector_column: str, *, zero: bool) -> DataFrame:
    """(id, x array<double>): vectors without null or non-finite components; all-zero ones only if ``zero``.

    Rows with a null id or a null or empty vector take no part. An id that repeats counts once, with its smallest vector in array
    order.
    """
    x = F.col(vector_column).cast("array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    if not zero:
        rows = rows.where(F.exists("x", lambda v: v != 0))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def matrix(column: pa.Array, width: int, dtype=float) -> np.ndarray:
    """A list column as rows of ``width`` numbers; shorter lists are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), dtype)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def lists(owner_sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(owner_sizes)].astype(np.int32)), pa.array(values))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000, ordered: bool = True) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that end where the key changes; a larger group comes whole.

    Rows of a key are neighbours, in ascending order of the key unless not ``ordered``.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1], side="left")) if ordered else int(np.max(np.flatnonzero(k != k[-1]), initial=-1)) + 1
        if last == 0 and (len(held) == 1 or held[-2].column(key)[-1].as_py() == k[0]):
            continue
        done = [*held[:-1], b.slice(0, last)]
        yield pa.Table.from_batches([x for x in done if x.num_rows])
        held, size = [b.slice(last)], b.num_rows - last
    if held:
        yield pa.Table.from_batches(held)
