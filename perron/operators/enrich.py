"""UDF-05: rows of raw punctuality text with the weather at departure and arrival, 18 columns more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import flexible_date, flexible_seconds, utc_hour_number
from .rows import counters, first_present
from .weather import resolve_grid

# Candidate columns in order of priority.
DEPARTURE_ID = ["gare_depart", "depart_station_id", "origin_station_id", "PTCAR_NO", "PTCAR ID"]
ARRIVAL_ID = ["gare_arrivee", "arrival_station_id", "destination_station_id", "PTCAR_NO", "PTCAR ID"]
DATES = {
    "depart": ["REAL_DATE_DEP", "PLANNED_DATE_DEP", "DATDEP", "REAL_DATE_ARR", "PLANNED_DATE_ARR"],
    "arrival": ["REAL_DATE_ARR", "PLANNED_DATE_ARR", "REAL_DATE_DEP", "PLANNED_DATE_DEP", "DATDEP"],
}
TIMES = {
    "depart": ["REAL_TIME_DEP", "PLANNED_TIME_DEP", "REAL_TIME_ARR", "PLANNED_TIME_ARR"],
    "arrival": ["REAL_TIME_ARR", "PLANNED_TIME_ARR", "REAL_TIME_DEP", "PLANNED_TIME_DEP"],
}
VALUES = ["temp", "precip", "wind_speed", "humidity", "pressure"]
SIDES = ("depart", "arrival")
# The added columns in order.
OUTPUT = [
    *[f"{v}_depart" for v in VALUES], *[f"{v}_arrivee" for v in VALUES], *[f"{s}_station_meteo" for s in SIDES],
    *[f"{s}_station_distance_km" for s in SIDES], *[f"{s}_no_station" for s in SIDES], *[f"{s}_weather_offset_hours" for s in SIDES],
]


def moment(df: DataFrame, side: str) -> Column:
    """DAT-15: local time of departure or arrival; null without a readable date, midnight without a readable time."""
    day, clock = flexible_date(first_present(df, DATES[side])), flexible_seconds(first_present(df, TIMES[side]))
    return F.timestamp_add("SECOND", F.coalesce(clock, F.lit(0)), day.cast("timestamp_ntz"))


def hour_weather(observed: DataFrame, stations: DataFrame, first_hour: int, last_hour: int) -> DataFrame:
    """(station, h, offset, source, weather): the resolved grid with the values that it points to. ``observed`` is
    (station, h, temp, precip, wind_speed, humidity, pressure); the grid has a row for the null station as well."""
    grid = resolve_grid(observed.select("station", "h"), stations, first_hour, last_hour)
    values = observed.select(F.col("station").alias("source"), F.col("h").alias("_at"), F.struct(*VALUES).alias("weather"))
    return grid.withColumn("_at", F.col("h") + F.col("offset")).join(values, ["source", "_at"], "left").drop("_at")


def keyed(df: DataFrame, zone: str = "Europe/Brussels") -> DataFrame:
    """Rows with the place and UTC hour number of both sides; the arrival falls back to the departure."""
    place = {"depart": first_present(df, DEPARTURE_ID)}
    place["arrival"] = F.coalesce(first_present(df, ARRIVAL_ID), place["depart"])
    at = {"depart": moment(df, "depart")}
    at["arrival"] = F.coalesce(moment(df, "arrival"), at["depart"])
    return df.withColumns({f"_{s}_place": place[s] for s in SIDES} | {f"_{s}_h": utc_hour_number(at[s], zone) for s in SIDES})


def enrich(df: DataFrame, mapping: DataFrame, weather: DataFrame) -> DataFrame:
    """``df`` with the 18 columns of ``OUTPUT``.

    ``mapping`` is (place_id, station_id, distance_km, no_station), ``weather`` the table of ``hour_weather``. A place
    without a mapping takes the weather that any station has for the hour. Each side is two equi-joins whose right sides
    grow with places and with station hours, not with rows, so they are broadcast where the session allows it.
    """
    out = keyed(df)
    places = mapping.select("place_id", F.struct("station_id", "distance_km", "no_station").alias("info"))
    hours = weather.select(F.coalesce("station", F.lit("")).alias("station"), "h", F.struct("offset", "weather").alias("found"))
    for s in SIDES:
        out = out.join(places.withColumnsRenamed({"place_id": f"_{s}_place", "info": f"_{s}"}), f"_{s}_place", "left")
        out = out.withColumn(f"_{s}_station", F.coalesce(F.col(f"_{s}.station_id"), F.lit("")))
        out = out.join(hours.withColumnsRenamed({"station": f"_{s}_station", "h": f"_{s}_h", "found": f"_{s}_found"}), [f"_{s}_station", f"_{s}_h"], "left")
    names = {"depart": "depart", "arrival": "arrivee"}
    added = {f"{v}_{names[s]}": F.col(f"_{s}_found.weather.{v}") for s in SIDES for v in VALUES}
    for s in SIDES:
        added[f"{s}_station_meteo"] = F.col(f"_{s}.station_id")
        added[f"{s}_station_distance_km"] = F.col(f"_{s}.distance_km")
        added[f"{s}_no_station"] = F.when(F.col(f"_{s}").isNull(), True).otherwise(F.coalesce(F.col(f"_{s}.no_station"), F.lit(False)))
        added[f"{s}_weather_offset_hours"] = F.when(F.col(f"_{s}_found.weather").isNotNull(), F.col(f"_{s}_found.offset"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in OUTPUT], *[added[c].alias(c) for c in OUTPUT])


def enrichment_counters() -> list[Column]:
    """AGG-19: rows, sides without a station, sides without weather."""
    side = lambda c: F.col(c).isNull()
    both = counters(depart_missing_station=F.col("depart_no_station"), arrival_missing_station=F.col("arrival_no_station"))
    missing = F.sum(side("depart_weather_offset_hours").cast("long") + side("arrival_weather_offset_hours").cast("long"))
    return [*both, F.coalesce(missing, F.lit(0)).alias("missing_weather")]
