"""Works on lines: days of activity, daily impact, nearest site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.text import works_level, works_type


def daily(works: DataFrame) -> DataFrame:
    """DAT-08, JOI-13: works (line, start, end, impact) as rows for each active day; a reversed range has none.

    The expansion turns interval containment into an equi-join.
    """
    ok = works.where("start <= end").withColumn("kind", works_type(F.col("impact")))
    days = F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY")))
    return ok.withColumn("level", works_level(F.col("kind"))).withColumn("date", days)


def daily_impact(days: DataFrame) -> DataFrame:
    """Per line and day: number, largest level and the kind that has it."""
    return days.groupBy("line", "date").agg(F.count("*").alias("nb"), F.max("level").alias("level"), F.max_by("kind", F.struct("level", "kind")).alias("kind"))


def nearest_site(stops: DataFrame, days: DataFrame) -> DataFrame:
    """JOI-14: least distance of each (line, date, stop) to a work on the line that day; distinct stops join once."""
    once = stops.select("line", "date", "stop_id", "lat", "lon").distinct()
    sites = days.select("line", "date", F.col("lat").alias("w_lat"), F.col("lon").alias("w_lon")).where("w_lat is not null and w_lon is not null")
    km = haversine(F.col("lat"), F.col("lon"), F.col("w_lat"), F.col("w_lon"))
    return once.join(sites, ["line", "date"]).groupBy("line", "date", "stop_id").agg(F.min(km).alias("km"))


def impact_features(rows: DataFrame, days: DataFrame) -> DataFrame:
    out = rows.join(daily_impact(days), ["line", "date"], "left")
    return out.withColumns({"nb": F.coalesce("nb", F.lit(0)), "level": F.coalesce("level", F.lit(-1)), "kind": F.coalesce("kind", F.lit("none"))}).withColumn("active", (F.col("nb") > 0).cast("int"))
