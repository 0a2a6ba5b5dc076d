"""Row operators: pick, keep, dedup, union, encode, fill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_existing(df: DataFrame, wanted: list[str], always: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-02/03: those of ``wanted`` that exist and are not excluded; ``always`` are kept."""
    names = [c for c in dict.fromkeys([*always, *wanted]) if c in df.columns and (c in always or c not in exclude)]
    return df.select(*names)


def split_by_prefix(names: list[str], static: tuple[str, ...], hist: tuple[str, ...], future: tuple[str, ...], explicit: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """PRJ-06: groups of columns: those of ``explicit`` where it names any of a group, else by prefix in this order; what
    fits none is historical."""
    out: dict[str, list[str]] = {"static": [], "hist": [], "future": []}
    given = {k: v for k, v in (explicit or {}).items() if v}
    placed = {c for v in given.values() for c in v}
    for n in names:
        if n in placed:
            kind = next(k for k, v in given.items() if n in v)
        else:
            kind = next((k for k, p in (("static", static), ("hist", hist), ("future", future)) if n.startswith(p)), "hist")
        out[kind].append(n)
    return out


def feature_lists(names: list[str], keys: tuple[str, ...], drop: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """PRJ-05: exogenous columns are neither keys nor dropped; those that end in _idx are categorical."""
    exogenous = [n for n in names if n not in keys and n not in drop]
    return {"read": [*keys, *exogenous], "exogenous": exogenous, "categorical": [n for n in exogenous if n.endswith("_idx")], "real": [n for n in exogenous if not n.endswith("_idx")]}


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DST-03, WIN-10/11: the first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def head(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """WIN-08: the first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def last_values(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """AGG-13: the last value of each column that is not null, as one partial aggregate; null where a key has none."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def top_ids(df: DataFrame, key: str, k: int) -> DataFrame:
    """AGG-14, TOP-01: the most frequent ids."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def sorted_codes(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(value, code): the distinct values that are not null, numbered in sorted order from 0.

    Values fall into ranges between about ``buckets`` bounds, taken from a hash sample of a few thousand values; they are
    ranked within their range, and the driver sees one count a range, so no task sorts all values.
    """
    values = df.select(F.col(column).alias("value")).where(F.col(column).isNotNull()).distinct()
    n = values.count()
    picked = values.where(F.pmod(F.xxhash64("value"), F.lit(max(1, n // 4096))) == 0) if n > 4096 else values.limit(0)
    found = sorted(r.value for r in picked.collect())
    bounds = found[:: max(1, len(found) // buckets)][1:]
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("value"))) if bounds else F.lit(0)
    dealt = values.withColumn("_part", part)
    counts = {r["_part"]: r.n for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts = [sum(counts.get(j, 0) for j in range(i)) for i in range(len(bounds) + 1)]
    start = F.get(F.array(*[F.lit(s) for s in starts]), F.col("_part"))
    return dealt.select("value", (start + F.row_number().over(Window.partitionBy("_part").orderBy("value")) - 1).cast("long").alias("code"))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """ENC-01: (value, code) with codes in sorted order."""
    return sorted_codes(df, column).withColumn("code", F.col("code").cast("double"))


def encode_labels(df: DataFrame, column: str, codes: DataFrame, limit: int = 100_000) -> DataFrame:
    """``<column>_idx``; values without a code, and nulls, are 0.0. Dictionaries up to ``limit`` are broadcast."""
    side = codes.select(F.col("value").alias(column), F.col("code").alias("_code"))
    small = codes.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(side) if small else side, column, "left").withColumn(f"{column}_idx", F.coalesce("_code", F.lit(0.0))).drop("_code")


def coordinates_by_name(stations: DataFrame, names: list[str], norm) -> DataFrame:
    """SET-01: (name, lat, lon) of all name columns of a station table, normalised by ``norm``; of several stations with
    one name the earlier name column counts, then the smallest coordinates."""
    parts = [stations.select(norm(F.col(n)).alias("name"), "lat", "lon").where("name is not null and name <> ''") for n in names]
    return union_with_priority(parts, ["name"])


def patched(table: DataFrame, patches: dict[str, tuple[float, float]]) -> DataFrame:
    """SET-02, JOI-12: (name, lat, lon) with the coordinates of ``patches`` instead, patches without a row added."""
    rows = [(n, float(a), float(b)) for n, (a, b) in patches.items()]
    over = table.sparkSession.createDataFrame(rows, "name string, lat double, lon double")
    return union_with_priority([over, table.select("name", "lat", "lon")], ["name"])


def keep_last(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """SET-04, WIN-11: union of contexts; of rows with equal keys that of the later part stays, within a part the largest."""
    return union_with_priority(parts[::-1], keys, largest=True)


def fill_continuous(df: DataFrame, skip: tuple[str, ...] = (), value: float = 0.0) -> DataFrame:
    """IMP-01: nulls and NaN of all float and double columns but ``skip`` become ``value``."""
    names = [n for n, t in df.dtypes if t in ("float", "double") and n not in skip]
    return df.withColumns({n: F.coalesce(F.nanvl(F.col(n), F.lit(None).cast("double")), F.lit(value)).cast(dict(df.dtypes)[n]) for n in names})


def drop_and_fill(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """FLT-07: rows whose target is null or NaN go; other nulls and NaN are 0."""
    return fill_continuous(df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select(target, *columns), skip=(target,))


def counters(**conditions: Column) -> list[Column]:
    """AGG-19: the rows and how many of them fulfil each condition, for ``DataFrame.observe`` or ``agg``."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()]]


def top_features(gains: DataFrame, k: int = 15) -> DataFrame:
    """TOP-02: the features of the largest gain, ties by name."""
    return gains.orderBy(F.desc("gain"), "feature").limit(k)


def first_present(df: DataFrame, candidates: list[str]) -> Column:
    """The first non-empty one of those columns that exist, trimmed."""
    found = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in candidates if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def union_with_priority(parts: list[DataFrame], keys: list[str], largest: bool = False) -> DataFrame:
    """SET-01/02/04: union of parts with equal keys resolved for the earlier part, within it for the smallest rest (or the
    ``largest``)."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in parts[0].columns if c not in keys]
    best = (F.max_by(F.struct(*rest), F.struct((-F.col("_part")).alias("_part"), *rest)) if largest else F.min_by(F.struct(*rest), F.struct("_part", *rest))).alias("s")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])
