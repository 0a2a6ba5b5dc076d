"""Weather: nearest station, hour expansion, daily features, and the resolved (station, hour) grid."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import ALL_TIERS, DEFAULT_STATION, OWN_TIERS, REACH_HOURS, WEATHER_DEFAULTS
from ..functions.geo import haversine_atan2
from .kdtree import Tree

#: Stations in one tree, and places that one task looks up in it.
STATION_SLICE = 200_000
PLACE_SLICE = 50_000
HOURLY_FROM = 169


def _nearby(_, places: pa.Table, stations: pa.Table) -> pa.Table:
    """Places with the stations that may be nearest to them."""
    degrees = lambda t, *names: [t.column(c).to_numpy() for c in names]
    place, station = Tree(*degrees(stations, "s_lat", "s_lon")).nearest(*degrees(places, "lat", "lon")) if stations.num_rows and places.num_rows else ([], [])
    one, other = places.select(["lat", "lon"]).take(pa.array(place, pa.int64())), stations.select(["s_lat", "s_lon", "first"]).take(pa.array(station, pa.int64()))
    return pa.table([*one.columns, *other.columns], [*one.column_names, *other.column_names])


def nearest_station(places: DataFrame, stations: DataFrame, max_km: float = 50.0, slice_size: int = STATION_SLICE, place_slice: int = PLACE_SLICE) -> DataFrame:
    """JOI-21: (place_id, station_id, distance_km, no_station); the first station (by ordinal) wins ties.

    Distinct places look distinct stations up in k-d trees of about ``slice_size`` stations, so no pairs are made; what may
    be nearest is measured exactly. Of several trees, each place meets every one. Coordinates that are null or not finite
    take no part: such a place has nulls, as all have where no station is left. Without any station there are no rows.
    """
    degrees = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    finite = lambda c: F.abs(c) < float("inf")
    there = stations.select("ordinal", "station_id", *degrees("s_lat", "s_lon"))
    where = there.where(finite("s_lat") & finite("s_lon")).groupBy("s_lat", "s_lon").agg(F.min(F.struct("ordinal", "station_id")).alias("first"))
    own = places.select("place_id", *degrees("lat", "lon"))
    once = own.where(finite("lat") & finite("lon")).select("lat", "lon").distinct()

    n = where.count()
    trees, shares = max(1, -(-n // slice_size)), max(1, -(-once.count() // place_slice))
    dealt = lambda parts, *names: F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")
    left = once.select("lat", "lon", dealt(shares, "lat", "lon").alias("share"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    right = where.select("s_lat", "s_lon", "first", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), dealt(trees, "s_lat", "s_lon").alias("tree"))
    kind = StructType([*once.schema.fields, *where.schema.fields])
    near = left.groupBy("share", "tree").cogroup(right.groupBy("share", "tree")).applyInArrow(_nearby, kind)

    far = F.struct(haversine_atan2(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")).alias("km"), "first.ordinal", "first.station_id")
    found = near.groupBy("lat", "lon").agg(F.min(far).alias("b"))
    best = own.join(found, ["lat", "lon"], "left").groupBy("place_id").agg(F.min("b").alias("b"))
    if not n and stations.isEmpty():
        best = best.where(F.lit(False))
    return best.select("place_id", F.col("b.station_id").alias("station_id"), F.round("b.km", 3).alias("distance_km"), (F.col("b.km") > max_km).alias("no_station"))


def expand_hours(observations: DataFrame, columns: list[str]) -> DataFrame:
    """SET-03, AGG-08: each observation stands for hours up to 3 away, modulo 24 on its own date; the nearest one fills
    an hour, the earlier of two as near. One scan instead of seven."""
    shifts = F.array(*[F.struct(F.lit(abs(d)).alias("delta"), F.lit(0 if d >= 0 else 1).alias("side"), F.lit(d).alias("shift")) for d in range(-3, 4)])
    each = observations.withColumn("s", F.explode(shifts)).withColumn("at", F.pmod(F.col("hour") + F.col("s.shift"), F.lit(24)))
    pick = F.min_by(F.struct(*columns), F.struct("s.delta", "s.side", "hour")).alias("p")
    return each.groupBy("station", "date", F.col("at")).agg(pick).select("station", "date", F.col("at").alias("hour"), *[F.col(f"p.{c}").alias(c) for c in columns])


def is_extreme(peak: Column, wind: Column, rain: Column, t: Column, cloud: Column, humidity: Column) -> Column:
    return ((peak > 25.0) | (wind > 20.0) | (rain > 10.0) | (t < -5.0) | (t > 35.0) | ((cloud >= 8.0) & (humidity >= 95.0))).cast("int")


def resolved_hours(keys: DataFrame, hourly: DataFrame, default: str = DEFAULT_STATION) -> DataFrame:
    """JOI-15/16 once for each (station, date, hour) in ``keys``: own station if temperature and cloud are known there,
    else the default station for all values, else constants; ``before`` is the temperature of the day before.

    Each observation stands for its own day and for the next one, at its own station and, if it is of the default
    station, for all others; so the four lookups are one aggregate and one join on the hours that rows ask for.
    """
    names = list(WEATHER_DEFAULTS)
    days = F.explode(F.array(F.struct(F.lit(0).alias("back"), F.col("date").alias("day")), F.struct(F.lit(1).alias("back"), F.date_add("date", 1).alias("day")))).alias("x")
    seen = hourly.select("station", F.col("hour").cast("int").alias("hour"), *names, days)
    of = lambda back, c: F.max(F.when(F.col("x.back") == back, F.col(c)))
    one = seen.groupBy("station", F.col("x.day").alias("date"), "hour").agg(*[of(0, n).alias(n) for n in names], of(1, "temperature").alias("before"))
    other = one.where(F.col("station") == default).select("date", "hour", F.struct(*names, "before").alias("d"))
    both = keys.join(one, ["station", "date", "hour"], "left").join(other, ["date", "hour"], "left")
    own = F.col("temperature").isNotNull() & F.col("nebulosite").isNotNull()
    value = [F.coalesce(F.when(own, F.col(n)).otherwise(F.col(f"d.{n}")), F.lit(v)).alias(n) for n, v in WEATHER_DEFAULTS.items()]
    return both.select("station", "date", "hour", *value, F.coalesce("before", "d.before", F.lit(WEATHER_DEFAULTS["temperature"])).alias("before"))


def weather_features(rows: DataFrame, hourly: DataFrame, default: str = DEFAULT_STATION) -> DataFrame:
    """JOI-15/16: the weather of each row (station, date, hour; a null station is the default one), by one join to the
    resolved hours."""
    own = rows.withColumns({"station": F.coalesce("station", F.lit(default)), "hour": F.col("hour").cast("int")})
    hours = resolved_hours(own.select("station", "date", "hour").distinct(), hourly, default)
    out = own.join(hours, ["station", "date", "hour"], "left")
    value = {n: F.coalesce(F.col(n), F.lit(v)) for n, v in WEATHER_DEFAULTS.items()}
    flag = is_extreme(value["vent_pointe"], value["vent_vitesse"], value["precipitations"], value["temperature"], value["nebulosite"], value["humidite"])
    return out.select(
        *[F.col(c) for c in rows.columns], F.round(value["temperature"], 1).alias("meteo_temperature"), F.round(value["precipitations"], 1).alias("meteo_precipitations"),
        F.round(value["vent_vitesse"], 1).alias("meteo_vent_vitesse"), F.round(value["nebulosite"], 0).alias("meteo_nebulosite"), flag.alias("meteo_conditions_extremes"),
        F.round(F.coalesce("before", F.lit(WEATHER_DEFAULTS["temperature"])), 1).alias("meteo_observee_j_1"),
    )


def _offsets(tiers: list[int]) -> Column:
    steps = [0, *[s for t in tiers for s in (-t, t)]]
    return F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("offset")) for i, s in enumerate(steps)])


def resolve_grid(observed: DataFrame, stations: DataFrame, first_hour: int, last_hour: int) -> DataFrame:
    """JOI-20: for every (station, hour number) the offset and station of the observation that stands for it.

    ``observed`` is (station, h), ``stations`` (station, ordinal). Offsets are exploded on the observations, so the cost
    grows with stations and hours, not with the rows that look weather up. Returns station, h, offset, source; rows with
    a null station say what stands for a place that has no weather station of its own.
    """
    hours = stations.select("station", F.explode(F.sequence(F.lit(first_hour), F.lit(last_hour))).alias("h"))

    def tiers(t: list[int]) -> DataFrame:
        each = observed.withColumn("o", F.explode(_offsets(t))).select("station", (F.col("h") - F.col("o.offset")).alias("h"), F.col("o.rank").alias("rank"), F.col("o.offset").alias("offset"))
        return each.groupBy("station", "h").agg(F.min_by("offset", "rank").alias("tier"))

    seen = observed.select("station", "h", F.col("h").alias("at"))
    w = Window.partitionBy("station").orderBy("h")
    base = hours.join(seen, ["station", "h"], "left").withColumns(
        {
            "past": F.max("at").over(w.rangeBetween(-REACH_HOURS, -1)),
            "next": F.min("at").over(w.rangeBetween(1, REACH_HOURS)),
            "far_past": F.max("at").over(w.rangeBetween(-REACH_HOURS, -HOURLY_FROM)),
            "far_next": F.min("at").over(w.rangeBetween(HOURLY_FROM, REACH_HOURS)),
        }
    )
    own = base.join(tiers(OWN_TIERS), ["station", "h"], "left").join(tiers(ALL_TIERS).withColumnRenamed("tier", "wide"), ["station", "h"], "left")
    nearer = lambda back, ahead: F.when(back.isNull() | (ahead <= -back), ahead).otherwise(back)
    near = nearer(F.col("past") - F.col("h"), F.col("next") - F.col("h"))
    # among all stations, hours are only tried one by one from HOURLY_FROM on
    hourly = nearer(F.col("far_past") - F.col("h"), F.col("far_next") - F.col("h"))
    own = own.join(stations, "station").withColumn("own", F.coalesce("tier", near))
    some = own.groupBy("h").agg(
        F.min(F.when(F.col("wide").isNotNull(), F.struct(F.abs("wide").alias("d"), "ordinal", F.col("wide").alias("offset"), "station"))).alias("by_tier"),
        F.min(F.when(F.coalesce("wide", hourly).isNotNull(), F.struct("ordinal", F.when(F.col("wide").isNull(), F.struct(F.abs(hourly).alias("d"), "ordinal", hourly.alias("offset"), "station")).alias("x")))).alias("first"),
    )
    best = F.least(F.col("by_tier"), F.col("first.x"))
    anywhere = some.select("h", best.alias("any"))
    out = own.join(anywhere, "h", "left")
    found = out.select("station", "h", F.coalesce("own", "any.offset").alias("offset"), F.when(F.col("own").isNotNull(), F.col("station")).otherwise(F.col("any.station")).alias("source"))
    return found.unionByName(anywhere.select(F.lit(None).cast("string").alias("station"), "h", F.col("any.offset").alias("offset"), F.col("any.station").alias("source")))
