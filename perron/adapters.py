"""Driver test tables as tables of the delay domain, in Spark and as SQL common table expressions of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.history import delay_minutes

NAMES = ["SCHAARBEEK", "BRUSSEL-ZUID", "BRUXELLES-NORD", "ANTWERPEN-CENTRAAL", "GENT-SINT-PIETERS", "LIEGE-GUILLEMINS", "CHARLEROI-CENTRAL", "LEUVEN", "OOSTENDE", "BRUGGE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def punctuality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    delay = F.when(F.col("event_id") % 17 != 0, F.col("value") - 120)
    return e.select(
        "event_id", F.col("user_id").alias("train"), F.col("event_type").alias("line"), F.concat(F.lit("STATION "), (F.col("user_id") % 40).cast("string")).alias("station"),
        F.col("ts").alias("datetime"), F.col("ts").cast("date").alias("d"), F.hour("ts").alias("hour"), delay.alias("delay_s"), delay_minutes(delay).alias("delay_min"),
    )


PUNCTUALITY = """p0 AS (SELECT event_id, user_id AS train, event_type AS line, 'STATION ' || (user_id % 40) AS station, ts AS datetime, CAST(ts AS DATE) AS d,
  CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN event_id % 17 <> 0 THEN value - 120 END AS delay_s FROM events),
p AS (SELECT *, CASE WHEN delay_s IS NOT NULL THEN least(greatest(delay_s / 60.0, -60.0), 240.0) END AS delay_min FROM p0)"""


def coordinates(stop):
    return (F.lit(49.5) + (stop % 200) / 100.0).alias("lat"), (F.lit(2.5) + (stop * 7 % 390) / 100.0).alias("lon")


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence")).agg(F.min("l_suppkey").alias("stop_id"))
    t, s = F.col("trip_id"), F.col("stop_sequence")
    names = F.array(*map(F.lit, NAMES))
    return li.select(
        "trip_id", "stop_sequence", "stop_id", F.get(names, (F.col("stop_id") % 10).cast("int")).alias("stop_name"), *coordinates(F.col("stop_id")),
        (s * 1800 + (t * 37 + s * s * 911) % 14400).alias("departure_s"), ((t + s) % 3 * 30).alias("dwell_s"),
    )


STOP_TIMES = f"""s0 AS (SELECT l_orderkey AS trip_id, l_linenumber AS stop_sequence, min(l_suppkey) AS stop_id FROM lineitem GROUP BY 1, 2),
st AS (SELECT *, list_extract({NAMES!r}, CAST(stop_id % 10 AS INTEGER) + 1) AS stop_name, 49.5 + (stop_id % 200) / 100.0 AS lat, 2.5 + (stop_id * 7 % 390) / 100.0 AS lon,
  stop_sequence * 1800 + (trip_id * 37 + stop_sequence * stop_sequence * 911) % 14400 AS departure_s, (trip_id + stop_sequence) % 3 * 30 AS dwell_s FROM s0),
s1 AS (SELECT *, CASE WHEN abs(departure_s - lag(departure_s) OVER (PARTITION BY trip_id ORDER BY stop_sequence)) > 7200 THEN 1 ELSE 0 END AS jump FROM st),
s2 AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY trip_id ORDER BY stop_sequence ROWS UNBOUNDED PRECEDING) AS INTEGER) AS sub_trip_idx FROM s1),
s3 AS (SELECT *, trip_id || '_sub' || sub_trip_idx AS real_trip_id FROM s2),
s4 AS (SELECT *, CASE WHEN dwell_s > 0 OR stop_sequence = min(stop_sequence) OVER (PARTITION BY real_trip_id) OR stop_sequence = max(stop_sequence) OVER (PARTITION BY real_trip_id) THEN 1 ELSE 0 END AS is_real_stop,
  CAST(dense_rank() OVER (PARTITION BY real_trip_id ORDER BY stop_sequence) AS INTEGER) AS local_sequence,
  lag(lat) OVER (PARTITION BY real_trip_id ORDER BY stop_sequence) AS plat, lag(lon) OVER (PARTITION BY real_trip_id ORDER BY stop_sequence) AS plon FROM s3)"""


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(asin(sqrt({x})) * 12742.0)"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    texts = F.array(*map(F.lit, ["Total closure", "voie unique", "Vitesse reduite", "", "autre"]))
    return o.select(
        F.col("o_orderpriority").alias("line"), F.col("o_orderdate").cast("date").alias("start"), F.date_add(F.col("o_orderdate").cast("date"), (k % 14).cast("int")).alias("end"),
        F.get(texts, (k % 5).cast("int")).alias("impact"), *coordinates(k % 97),
    )


WORKS = """w AS (SELECT o_orderpriority AS line, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 14 AS INTEGER) AS e,
  list_extract(['total_closure', 'single_track', 'speed_reduction', 'none', 'other'], CAST(o_orderkey % 5 AS INTEGER) + 1) AS kind,
  list_extract([3, 2, 1, 0, 0], CAST(o_orderkey % 5 AS INTEGER) + 1) AS level,
  49.5 + (o_orderkey % 97 % 200) / 100.0 AS lat, 2.5 + (o_orderkey % 97 * 7 % 390) / 100.0 AS lon FROM orders),
wd AS (SELECT line, kind, level, lat, lon, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date FROM w)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, date, hour, temperature, ...) with gaps."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 27).cast("string").alias("station"), F.col("ts").cast("date").alias("date"), F.hour("ts").alias("hour"), "value", "event_id")
    v = F.avg("value") + 0.0013737  # off the ties of rounding
    o = e.groupBy("station", "date", "hour").agg(v.alias("v"), F.min("event_id").alias("k"))
    return o.select(
        "station", "date", "hour", (F.col("v") / 10 - 5).alias("temperature"), (F.col("v") % 13).alias("precipitations"), (F.col("v") % 23).alias("vent_vitesse"),
        (F.col("v") % 31).alias("vent_pointe"), (F.col("v") % 100).alias("humidite"), F.when(F.col("k") % 5 != 0, F.col("v") % 9).alias("nebulosite"),
    )


OBSERVATIONS = """o0 AS (SELECT CAST(user_id % 27 AS VARCHAR) AS station, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, avg(value) + 0.0013737 AS v, min(event_id) AS k FROM events GROUP BY 1, 2, 3),
o AS (SELECT station, date, hour, v / 10 - 5 AS temperature, v % 13 AS precipitations, v % 23 AS vent_vitesse, v % 31 AS vent_pointe, v % 100 AS humidite, CASE WHEN k % 5 <> 0 THEN v % 9 END AS nebulosite FROM o0)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared daily series: group_id, time_idx, target."""
    p = punctuality(spark, sf_dir)
    return p.groupBy(F.col("train").cast("string").alias("group_id"), F.unix_date("d").cast("long").alias("time_idx")).agg(F.round(F.avg(F.coalesce("delay_min", F.lit(0.0))), 6).alias("target"))


SERIES = f"""{PUNCTUALITY}, sr AS (SELECT CAST(train AS VARCHAR) AS group_id, CAST(date_diff('day', DATE '1970-01-01', d) AS BIGINT) AS time_idx, round(avg(coalesce(delay_min, 0.0)), 6) AS target FROM p GROUP BY 1, 2)"""


def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuality rows whose trains and stations are those of ``stop_times``."""
    e = table(spark, sf_dir, "events")
    name = F.get(F.array(*map(F.lit, NAMES)), ((F.col("user_id") + F.col("event_id")) % 10).cast("int"))
    return e.select(
        "event_id", F.col("user_id").alias("train"), F.when(F.col("event_id") % 2 == 0, "1-URGENT").otherwise(F.col("event_type")).alias("line"), name.alias("station"),
        F.col("ts").alias("datetime"), F.when(F.col("event_id") % 17 != 0, F.col("value") - 120).alias("delay_s"),
    )


JOURNEYS = f"""p0 AS (SELECT event_id, user_id AS train, CASE WHEN event_id % 2 = 0 THEN '1-URGENT' ELSE event_type END AS line, list_extract({NAMES!r}, CAST((user_id + event_id) % 10 AS INTEGER) + 1) AS station,
  ts AS datetime, CAST(ts AS DATE) AS d, CAST(hour(ts) AS INTEGER) AS hour, CASE WHEN event_id % 17 <> 0 THEN value - 120 END AS delay_s FROM events),
p AS (SELECT *, CASE WHEN delay_s IS NOT NULL THEN least(greatest(delay_s / 60.0, -60.0), 240.0) END AS delay_min FROM p0)"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they come in files: all text, dates and times in several shapes, some columns empty."""
    e, k, t = table(spark, sf_dir, "events"), F.col("event_id"), F.col("ts").cast("timestamp_ntz")
    later = F.timestamp_add("HOUR", F.lit(3), t)
    shown = lambda f, x=t: F.date_format(x, f)
    return e.select(
        k, F.concat(F.lit(" "), (F.col("user_id") % 70).cast("string")).alias("PTCAR_NO"), F.when(k % 3 == 0, (F.col("user_id") % 71).cast("string")).otherwise("").alias("gare_arrivee"),
        F.when(k % 4 == 0, shown("yyyy-MM-dd")).when(k % 4 == 1, shown("yyyyMMdd")).when(k % 4 == 2, F.upper(shown("ddMMMyyyy"))).otherwise(" ").alias("DATDEP"),
        F.when(k % 4 == 3, F.when(k % 29 == 0, "soon").otherwise(shown("yyyy-MM-dd"))).alias("PLANNED_DATE_DEP"),
        F.when(k % 5 == 0, shown("HH:mm:ss")).when(k % 5 == 1, shown("HHmm")).when(k % 5 == 2, shown("HH")).when(k % 5 == 3, "9:05").alias("REAL_TIME_DEP"), shown("HH:mm").alias("PLANNED_TIME_DEP"),
        F.when(k % 2 == 0, shown("yyyyMMdd", later)).alias("REAL_DATE_ARR"), F.when(k % 2 == 0, shown("HHmmss", later)).alias("REAL_TIME_ARR"),
    )


def _local(t: str, clock: str) -> str:
    return f"CAST(CAST({t} AS DATE) AS TIMESTAMP) + {clock}"


_CLOCK = """CASE event_id % 5 WHEN 0 THEN to_seconds(epoch(date_trunc('second', ts) - CAST(CAST(ts AS DATE) AS TIMESTAMP))) WHEN 2 THEN to_hours(hour(ts)) WHEN 3 THEN to_hours(0) ELSE to_minutes(hour(ts) * 60 + minute(ts)) END"""
RAW_ROWS = f"""rr0 AS (SELECT event_id, CAST(user_id % 70 AS VARCHAR) AS dp, CASE WHEN event_id % 3 = 0 THEN CAST(user_id % 71 AS VARCHAR) ELSE CAST(user_id % 70 AS VARCHAR) END AS ap,
  CASE WHEN event_id % 4 = 3 AND event_id % 29 = 0 THEN NULL ELSE {_local("ts", _CLOCK)} END AS dt, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) + INTERVAL 3 HOUR END AS at0, ts FROM events),
rr1 AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN at0 ELSE dt END AS at1 FROM rr0),
rr AS (SELECT event_id, dp, ap, CAST(floor(epoch(dt) / 3600) AS INTEGER) - 1 AS dh, CAST(floor(epoch(at1) / 3600) AS INTEGER) - 1 AS ah FROM rr1)"""


def hourly_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, h, temp, precip, wind_speed, humidity, pressure) of 60 stations, with the gaps that the table has."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("W"), (F.col("user_id") % 60).cast("string")).alias("station"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp_ntz").cast("timestamp")) / 3600).cast("int").alias("h"), "value")
    o = e.groupBy("station", "h").agg((F.avg("value") + 0.0013737).alias("v"))
    v = F.col("v")
    return o.select("station", "h", F.round(v / 10 - 5, 4).alias("temp"), F.round(v % 13, 4).alias("precip"), F.round(v % 23, 4).alias("wind_speed"), F.round(v % 100, 4).alias("humidity"), F.round(v % 50 + 980, 4).alias("pressure"))


def weather_stations(spark: SparkSession) -> DataFrame:
    """One of them has no observation."""
    return spark.range(61).select(F.concat(F.lit("W"), F.col("id").cast("string")).alias("station"), F.col("id").cast("int").alias("ordinal"))


def station_mapping(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(71).where(k % 13 != 0).select(k.cast("string").alias("place_id"), F.concat(F.lit("W"), (k % 61).cast("string")).alias("station_id"), F.round(k * 0.7, 3).alias("distance_km"), (k % 9 == 0).alias("no_station"))


def _tier_rank(tiers: list[int]) -> str:
    return f"CASE WHEN d = 0 THEN 0 WHEN abs(d) IN ({', '.join(map(str, tiers))}) THEN abs(d) * 2 + CASE WHEN d > 0 THEN 1 ELSE 0 END END"


def resolved_sql(own: list[int], wide: list[int], margin: int = 48) -> str:
    """The rules of the grid hour by hour: cells (null station included), offset and source."""
    return f"""hw AS (SELECT 'W' || (user_id % 60) AS station, CAST(floor(epoch(ts) / 3600) AS INTEGER) AS h, avg(value) + 0.0013737 AS v FROM events GROUP BY 1, 2), sp AS (SELECT min(h) - {margin} AS a, max(h) + {margin} AS b FROM hw),
ws AS (SELECT 'W' || i AS station, CAST(i AS INTEGER) AS ordinal FROM range(61) t(i)), cells AS (SELECT station, ordinal, CAST(unnest(generate_series(a, b)) AS INTEGER) AS h FROM ws, sp),
cand AS (SELECT c.station, c.h, o.h - c.h AS d FROM cells c JOIN hw o ON o.station = c.station AND o.h BETWEEN c.h - 720 AND c.h + 720),
rk AS (SELECT *, {_tier_rank(own)} AS a, {_tier_rank(wide)} AS b, abs(d) * 2 + CASE WHEN d < 0 THEN 1 ELSE 0 END AS c FROM cand),
per AS (SELECT station, h, coalesce(arg_min(d, a) FILTER (WHERE a IS NOT NULL), arg_min(d, c)) AS own, arg_min(d, b) FILTER (WHERE b IS NOT NULL) AS wide, arg_min(d, c) FILTER (WHERE abs(d) >= 169) AS hourly FROM rk GROUP BY 1, 2),
full_ AS (SELECT c.station, c.ordinal, c.h, own, wide, hourly FROM cells c LEFT JOIN per USING (station, h)),
anyw AS (SELECT h, min(CASE WHEN wide IS NOT NULL THEN [abs(wide), ordinal, wide] END) AS t, arg_min({{'x': CASE WHEN wide IS NULL THEN [abs(hourly), ordinal, hourly] END}}, ordinal) FILTER (WHERE coalesce(wide, hourly) IS NOT NULL) AS f FROM full_ GROUP BY h),
best AS (SELECT h, CASE WHEN t IS NULL THEN f.x WHEN f.x IS NULL THEN t WHEN t <= f.x THEN t ELSE f.x END AS x FROM anyw),
grid AS (SELECT station, h, coalesce(own, x[3]) AS "offset", CASE WHEN own IS NOT NULL THEN station ELSE 'W' || x[2] END AS source FROM full_ LEFT JOIN best USING (h) UNION ALL SELECT NULL, h, x[3], 'W' || x[2] FROM best)"""


def timetable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stops (a third without a station of that name) and stations with French, Dutch and symbolic names."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    stops = table(spark, sf_dir, "supplier").select(k.alias("stop_id"), F.concat(F.lit("gare  "), F.col("s_nationkey").cast("string"), F.when(k % 3 == 0, "x").otherwise("")).alias("stop_name"), (F.lit(50.0) + k / 1000.0).alias("stop_lat"), (F.lit(4.0) + k / 1000.0).alias("stop_lon"))
    stations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Gare "), n.cast("string")).alias("fr"), F.when(n % 2 == 0, F.concat(F.lit("Gare "), (n + 1).cast("string"))).alias("nl"), F.concat(F.lit("SYM "), n.cast("string")).alias("symbolic"),
        (F.lit(49.5) + n / 10.0).alias("lat"), (F.lit(3.0) + n / 10.0).alias("lon"),
    )
    return stops, stations


STATION_NAMES = """sn AS (SELECT 'GARE ' || n_nationkey AS name, 0 AS p, n_nationkey AS n FROM nation UNION ALL SELECT 'GARE ' || (n_nationkey + 1), 1, n_nationkey FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'SYM ' || n_nationkey, 2, n_nationkey FROM nation),
sc AS (SELECT name, 49.5 + n / 10.0 AS lat, 3.0 + n / 10.0 AS lon FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p, n) AS k FROM sn) WHERE k = 1)"""


def texted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series rows as text, with unreadable numbers, missing keys and repeated days."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k, F.when(k % 31 != 0, F.concat(F.lit("g"), (F.col("user_id") % 500).cast("string"))).alias("group_id"), F.when(k % 37 != 0, F.unix_date(F.col("ts").cast("date")).cast("string")).otherwise("?").alias("time_idx"),
        F.when(k % 41 != 0, F.round("value", 2).cast("string")).otherwise("none").alias("target"), F.when(k % 5 != 0, (k % 100).cast("string")).alias("x"), F.when(k % 7 != 0, (k % 9 - 3).cast("string")).alias("kind_idx"),
    )


TEXTED = """tx AS (SELECT event_id, 'g' || (user_id % 500) AS group_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS time_idx, CAST(round(value, 2) AS FLOAT) AS target,
  CAST(CASE WHEN event_id % 5 <> 0 THEN event_id % 100 ELSE 0 END AS FLOAT) AS x, CAST(greatest(CASE WHEN event_id % 7 <> 0 THEN event_id % 9 - 3 ELSE -1 END, 0) AS FLOAT) AS kind_idx FROM events WHERE event_id % 31 <> 0 AND event_id % 37 <> 0 AND event_id % 41 <> 0),
cl AS (SELECT * EXCLUDE (k, event_id) FROM (SELECT *, row_number() OVER (PARTITION BY group_id, time_idx ORDER BY event_id DESC) AS k FROM tx) WHERE k = 1)"""
