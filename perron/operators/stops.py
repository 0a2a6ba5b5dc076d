"""Stops of the timetable and their coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import COORDINATE_PATCHES
from ..functions.text import station_form_1, station_form_2
from .rows import patched


def located(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """JOI-04: (stop_id, stop_name, stop_lat, stop_lon): the coordinates of the station of that name (form 1) where it
    is known, else those of the timetable. ``stations`` is (name, lat, lon) as ``rows.coordinates_by_name`` gives it."""
    named = stops.withColumn("name", station_form_1(F.col("stop_name")))
    both = named.join(stations.select("name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "name", "left")
    return both.select("stop_id", F.col("name").alias("stop_name"), F.coalesce("_lat", "stop_lat").alias("stop_lat"), F.coalesce("_lon", "stop_lon").alias("stop_lon"))


def at_stops(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """JOI-05: stop times with the name and place of their stop; unknown stops keep their row."""
    return stop_times.join(stops, "stop_id", "left")


def patch_coordinates(df: DataFrame, stations: DataFrame, name: str = "station") -> DataFrame:
    """JOI-12: rows with lat and lon by their name in form 2; fixed patches go before the station table."""
    table = patched(stations, COORDINATE_PATCHES).select(F.col("name").alias("_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    both = df.withColumn("_name", station_form_2(F.col(name))).join(table, "_name", "left")
    return both.withColumns({"lat": F.col("_lat"), "lon": F.col("_lon")}).drop("_name", "_lat", "_lon")
