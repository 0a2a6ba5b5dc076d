"""Readers for the tables of the delay domain."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import clock_seconds
from ..functions.text import lenient_float
from ..operators.rows import first_present


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """SRC-01: the first of ``paths`` that exists."""
    for i, p in enumerate(paths):
        try:
            return spark.read.parquet(p)
        except AnalysisException:
            if i == len(paths) - 1:
                raise
    raise ValueError("no path")


def delimiter(spark: SparkSession, path: str) -> str:
    """SRC-04: ``;`` if the first non-blank line has strictly more of them than of ``,``."""
    line = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    head = line[0].value if line else ""
    return ";" if head.count(";") > head.count(",") else ","


def csv(spark: SparkSession, path: str, sep: str | None = None, schema: str | None = None) -> DataFrame:
    """SRC-02/03/04: text columns (or ``schema``), trimmed; bad values become null. ``sep`` None: detected."""
    reader = spark.read.options(header=True, sep=sep or delimiter(spark, path), mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def last_write_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """SRC-05: union of files in order; of rows with equal keys the last one stays."""
    tagged = [p.withColumns({"_file": F.lit(i), "_row": F.monotonically_increasing_id()}) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in parts[0].columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct("_file", "_row")).alias("s")
    return rows.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


#: Candidate names of weather columns; the first present, non-empty one counts.
SYNOP = {
    "station": ["code", "station_id", "id", "station"],
    "timestamp": ["timestamp", "time", "datetime"],
    "temperature": ["temp", "temperature"],
    "precipitations": ["precip_quantity", "precip"],
    "vent_vitesse": ["wind_speed"],
    "vent_pointe": ["wind_peak_speed"],
    "humidite": ["humidity_relative", "humidity"],
    "nebulosite": ["cloudiness"],
    "pression": ["pressure"],
}


def synop(df: DataFrame) -> DataFrame:
    """FLT-06: typed observations; rows without a station or a readable time are skipped (``skipped`` counts them)."""
    text = {k: first_present(df, v) for k, v in SYNOP.items()}
    numbers = {k: lenient_float(c).alias(k) for k, c in text.items() if k not in ("station", "timestamp")}
    out = df.select(text["station"].alias("station"), F.to_date(F.substring(text["timestamp"], 1, 10).try_cast("date")).alias("date"), F.substring(text["timestamp"], 12, 2).try_cast("int").alias("hour"), *numbers.values())
    return out.where("station is not null and date is not null and hour is not null")


def skipped(df: DataFrame) -> Column:
    """FLT-06: how many rows ``synop`` skips, for ``agg`` or ``observe``."""
    text = {k: first_present(df, v) for k, v in SYNOP.items()}
    day, hour = F.substring(text["timestamp"], 1, 10).try_cast("date"), F.substring(text["timestamp"], 12, 2).try_cast("int")
    return F.count_if(text["station"].isNull() | day.isNull() | hour.isNull()).alias("skipped")


def progress(spark: SparkSession, path: str) -> dict[str, int | float | bool | None]:
    """TXT-15: how far a training log came: the last progress line, else the largest epoch; whether it ended by itself."""
    lines = spark.read.text(path).select(F.explode(F.split("value", "\r")).alias("line"))
    numbered = lines.select("line", F.monotonically_increasing_id().alias("at"))
    shape = r"Epoch\s+(\d+):\s+(\d+)%\|.*?\|\s*(\d+)/(\d+)\s*\["
    part = [F.regexp_extract("line", shape, i).try_cast("long").alias(n) for i, n in enumerate(("epoch", "percent", "done", "of"), 1)]
    last = F.max(F.when(F.col("line").rlike(shape), F.struct("at", *part))).alias("last")
    epoch = F.max(F.regexp_extract("line", r"Epoch\s+(\d+):", 1).try_cast("long")).alias("epoch")
    stopped = F.bool_or(F.lower("line").rlike("early stopping|did not improve|signaling.*stop")).alias("stopped")
    r = numbered.agg(last, epoch, stopped, F.bool_or(F.contains("line", F.lit("==== training done ===="))).alias("ended")).first()
    ends = {"early_stop": bool(r.stopped), "ended": bool(r.ended)}
    if r.last is None:
        return {"epoch": r.epoch, "percent": None, "done": None, "of": None, "epochs": None if r.epoch is None else r.epoch + 1.0, "steps": None} | ends
    x = r.last
    return {"epoch": x.epoch, "percent": x.percent, "done": x.done, "of": x.of, "epochs": x.epoch + (x.done / x.of if x.of else 0.0), "steps": x.epoch * x.of + x.done} | ends


def json_map(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """SRC-07: entries of one JSON object as rows; a missing file gives none."""
    schema = f"{key} string, value {value_schema}"
    try:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", f"map<string, {value_schema}>")).alias(key, "value")).select(key, "value")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def stream_csv(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """SRC-06: files of a folder as a stream, a bounded number for each trigger."""
    return spark.readStream.schema(schema).options(header=True, maxFilesPerTrigger=files_per_trigger).csv(folder)


def timetable(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SRC-08: stops (stop_id, stop_name, stop_lat, stop_lon) and stop times (trip_id, stop_sequence, stop_id,
    arrival_s, departure_s, dwell_s) of a folder with stops.txt and stop_times.txt."""
    stops = csv(spark, f"{folder}/stops.txt", ",").select("stop_id", "stop_name", F.col("stop_lat").try_cast("double").alias("stop_lat"), F.col("stop_lon").try_cast("double").alias("stop_lon"))
    times = csv(spark, f"{folder}/stop_times.txt", ",").select("trip_id", F.col("stop_sequence").try_cast("int").alias("stop_sequence"), "stop_id", clock_seconds(F.col("arrival_time")).alias("arrival_s"), clock_seconds(F.col("departure_time")).alias("departure_s"))
    return stops, times.withColumn("dwell_s", F.col("departure_s") - F.col("arrival_s"))


def tail(df: DataFrame, order: str, n: int, *, trim: bool = True, ranges: int = 1000) -> DataFrame:
    """SRC-09: the last n rows by the numeric column ``order``; without ``trim`` all rows from the last range of values on
    that reaches n.

    A histogram over ``ranges`` equal ranges (one pass over one column) gives the value from which n rows are left, so only
    those are read in full and sorted; the condition reaches the scan.
    """
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    if ends.a is None:
        return df.limit(0)
    step = max((float(ends.b) - float(ends.a)) / ranges, 1e-12)
    counts = df.groupBy(F.floor((F.col(order) - F.lit(ends.a)) / step).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("k")).collect()
    held, first = 0, 0
    for r in counts:
        if r.k is None or held >= n:
            break
        held, first = held + r.n, r.k
    kept = df.where(F.col(order) >= F.lit(float(ends.a) + first * step - step * 1e-6))
    return kept.orderBy(F.desc(order), *[c for c in df.columns if c != order]).limit(n) if trim else kept


def missing(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """SRC-11: wanted columns that the schema of ``path`` lacks; no rows are read."""
    names = set(spark.read.parquet(path).columns)
    return [c for c in wanted if c not in names]


def merged_config(base: dict, over: dict) -> dict:
    """SRC-12: ``over`` laid over ``base``, dictionaries merged at every depth."""
    return base | {k: merged_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def config(path: str, base: dict | None = None) -> dict:
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return merged_config(base or {}, json.loads(text))
    import yaml

    return merged_config(base or {}, yaml.safe_load(text) or {})
