"""Queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import adapters as A
from .constants import ALL_TIERS, CONGESTION, COORDINATE_PATCHES, FEATURE_HUBS, HOLIDAYS, HUBS, JUNCTION, OWN_TIERS, SCHOOL_HOLIDAYS, WEATHER_DEFAULTS
from .functions import dates, geo, numeric, text
from .operators import boosting, density, enrich, history, ridge, rows, scores, stops, trips, weather, works
from .operators import series as ser
from .plans import features
from .session import scratch, written
from .sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, n=6):
    return F.round(c, n)


# --- temporal and calendar ---------------------------------------------------------------------------------------


@query(
    f"""WITH {A.PUNCTUALITY} SELECT event_id, """
    + ", ".join(
        f"CAST(round({f}(({v}) * 2.0 * pi() / {n}), 4) AS DOUBLE) + 0.0 AS {name}_{f}"
        for name, v, n in (("heure_prevue", "hour(datetime) + minute(datetime) / 60.0", 24), ("jour_semaine", "isodow(datetime) % 7", 7), ("mois", "month(datetime) - 1", 12))
        for f in ("sin", "cos")
    )
    + " FROM p"
)
def temporal_cyclic(spark, sf):
    t = dates.temporal_features(A.punctuality(spark, sf).select("event_id", "datetime"))
    return t.select("event_id", *[r(F.col(c).cast("double"), 4).alias(c) for c in t.columns if c.endswith(("_sin", "_cos"))])


_HOLIDAY = " OR ".join(f"d BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in SCHOOL_HOLIDAYS)


@query(f"""WITH {A.PUNCTUALITY} SELECT event_id, CASE WHEN isodow(datetime) >= 6 THEN 1 ELSE 0 END AS fest_weekend,
  CASE WHEN isodow(datetime) < 6 AND (hour BETWEEN 7 AND 8 OR hour BETWEEN 17 AND 18) THEN 1 ELSE 0 END AS is_heure_pointe,
  CASE WHEN hour < 6 THEN 'nuit' WHEN hour < 12 THEN 'matin' WHEN hour < 14 THEN 'midi' WHEN hour < 18 THEN 'apres_midi' WHEN hour < 22 THEN 'soir' ELSE 'fin_soiree' END AS periode_journee,
  CASE WHEN CAST(d AS VARCHAR) IN ({", ".join(repr(x) for x in HOLIDAYS)}) THEN 1 ELSE 0 END AS is_jour_ferie, CASE WHEN {_HOLIDAY} THEN 1 ELSE 0 END AS is_vacances_scolaires FROM p""")
def calendar_flags(spark, sf):
    p = A.punctuality(spark, sf)
    cal = dates.calendar(spark).withColumnRenamed("date_key", "d")
    t = F.col("datetime")
    return p.join(F.broadcast(cal), "d", "left").select(
        "event_id", dates.is_weekend(t).alias("fest_weekend"), dates.is_peak(t).alias("is_heure_pointe"), dates.day_period(t).alias("periode_journee"),
        F.coalesce("is_jour_ferie", F.lit(0)).alias("is_jour_ferie"), F.coalesce("is_vacances_scolaires", F.lit(0)).alias("is_vacances_scolaires"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS t, o_orderkey * 7 % 90061 AS s FROM orders)
SELECT k, CAST(t AS DATE) + to_seconds(s % 86400) AS datetime, CAST(isodow(t) AS INTEGER) AS dow, CAST(isodow(t) % 7 AS INTEGER) AS dow0, CAST(month(t) - 1 AS INTEGER) AS month0,
  CAST(date_diff('day', DATE '1970-01-01', CAST(t AS DATE)) AS BIGINT) AS time_idx FROM o""")
def datetime_parts(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("t"))
    dow = dates.iso_weekday(F.col("t"))
    return o.select("k", dates.at_seconds(F.col("t").cast("date"), F.col("k") * 7 % 90061 % 86400).alias("datetime"), dow.alias("dow"), (dow % 7).alias("dow0"), (F.month("t") - 1).alias("month0"), F.unix_date(F.col("t").cast("date")).cast("long").alias("time_idx"))


@query("""WITH x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, 'T_' || o_custkey || '_' AS h FROM orders), a AS (SELECT DISTINCT h || strftime(d, '%Y%m%d') AS id FROM x WHERE k % 3 = 0),
b AS (SELECT DISTINCT h || upper(strftime(d, '%d%b%Y')) AS id FROM x WHERE k % 2 = 0)
SELECT k, CASE WHEN b.id IS NOT NULL THEN b.id WHEN a.id IS NOT NULL THEN a.id ELSE h || upper(strftime(d, '%d%b%Y')) END AS trip_id
FROM x LEFT JOIN a ON a.id = h || strftime(d, '%Y%m%d') LEFT JOIN b ON b.id = h || upper(strftime(d, '%d%b%Y'))""")
def trip_id_choice(spark, sf):
    long, short = dates.trip_ids(F.col("o_custkey"), F.col("o_orderdate").cast("date"))
    x = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), long.alias("long_id"), short.alias("short_id"))
    a = x.where("k % 3 = 0").select("short_id").distinct().withColumn("in_a", F.lit(True))
    b = x.where("k % 2 = 0").select("long_id").distinct().withColumn("in_b", F.lit(True))
    both = x.join(a, "short_id", "left").join(b, "long_id", "left")
    return both.select("k", F.when(F.col("in_b"), F.col("long_id")).when(F.col("in_a"), F.col("short_id")).otherwise(F.col("long_id")).alias("trip_id"))


@query("""WITH x AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 28 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') AS c FROM orders)
SELECT k, CAST(substr(c, 1, 2) AS INTEGER) * 3600 + CAST(substr(c, 4, 2) AS INTEGER) * 60 + CAST(substr(c, 7, 2) AS INTEGER) AS seconds,
  (CAST(substr(c, 1, 2) AS INTEGER) * 3600 + CAST(substr(c, 4, 2) AS INTEGER) * 60 + CAST(substr(c, 7, 2) AS INTEGER)) % 86400 AS of_day FROM x""")
def hms_to_seconds(spark, sf):
    two = lambda c, n: F.lpad((F.col(c) % n).cast("string"), 2, "0")
    x = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws(":", two("o_orderkey", 28), two("o_orderkey", 60), two("o_custkey", 60)).alias("c"))
    s = dates.clock_seconds(F.col("c"))
    return x.select("k", s.alias("seconds"), F.pmod(s, F.lit(86400)).alias("of_day"))


@query("""WITH x AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey % 4 AS f FROM orders)
SELECT k, CASE f WHEN 3 THEN NULL ELSE d END AS parsed, CASE WHEN f = 3 THEN NULL WHEN f = 1 THEN (k % 24) * 3600 WHEN f = 2 THEN (k % 24) * 3600 + (k % 60) * 60 ELSE (k % 24) * 3600 + (k % 60) * 60 + k % 59 END AS seconds FROM x""")
def punct_date_time_formats(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    f = k % 4
    day = F.when(f == 0, F.date_format(d, "yyyy-MM-dd")).when(f == 1, F.date_format(d, "yyyyMMdd")).when(f == 2, F.upper(F.date_format(d, "ddMMMyyyy"))).otherwise("n/a")
    clock = F.when(f == 0, F.concat_ws(":", two(24), two(60), two(59))).when(f == 1, two(24)).when(f == 2, F.concat(two(24), two(60))).otherwise("9:05")
    x = A.table(spark, sf, "orders").select(k.alias("k"), day.alias("day"), clock.alias("clock"))
    return x.select("k", dates.flexible_date(F.col("day")).alias("parsed"), dates.flexible_seconds(F.col("clock")).cast("long").alias("seconds"))


@query("""SELECT event_id, strftime(date_trunc('hour', ts) - CASE WHEN ts < TIMESTAMP '2024-03-31 02:00:00' OR ts >= TIMESTAMP '2024-10-27 03:00:00' THEN INTERVAL 1 HOUR ELSE INTERVAL 2 HOUR END, '%Y-%m-%d-%H') AS hour_key FROM events""")
def utc_hour_key(spark, sf):
    return A.table(spark, sf, "events").select("event_id", dates.utc_hour_key(F.col("ts")).alias("hour_key"))


# --- text --------------------------------------------------------------------------------------------------------

_SAMPLES = ["Liège-Guillemins", "  sint-niklaas  ", "Braine-l'Alleud", "ÉCAUSSINNES\tcarrières", "Čech  Ÿ", "Hasselt (aflos) L.35", "Anvers–Sud", "FOREST-EST", "---", ""]
_NAMED = "n AS (SELECT s_suppkey AS k, list_extract([{}], CAST(s_suppkey % {} AS INTEGER) + 1) || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' ' || s_name END AS x FROM supplier)".format(
    ", ".join("'" + x.replace("'", "''") + "'" for x in _SAMPLES), len(_SAMPLES)
)


def _names(spark, sf):
    k = F.col("s_suppkey")
    head = F.get(F.array(*map(F.lit, _SAMPLES)), (k % len(_SAMPLES)).cast("int"))
    return A.table(spark, sf, "supplier").select(k.alias("k"), F.concat(head, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("s_name")))).alias("x"))


@query(f"""WITH {_NAMED} SELECT k, upper(strip_accents(trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS form_1,
  trim(regexp_replace(regexp_replace(translate(upper(x), 'ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÇÑ', 'AAAAAAEEEEIIIIOOOOOUUUUYCN'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS form_2,
  nullif(trim(regexp_replace(regexp_replace(upper(strip_accents(x)), '[^A-Z0-9\\s-]', '', 'g'), '\\s+', ' ', 'g')), '') AS form_3 FROM n""")
def station_norms(spark, sf):
    x = F.col("x")
    return _names(spark, sf).select("k", text.station_form_1(x).alias("form_1"), text.station_form_2(x).alias("form_2"), text.station_form_3(x).alias("form_3"))


@query("""SELECT o_orderkey AS k, CASE WHEN regexp_matches(x, '(?i)^IC[\\s-]') THEN 'IC' WHEN regexp_matches(x, '(?i)^S[\\s\\d]') THEN 'S' WHEN regexp_matches(x, '(?i)^L[\\s]') THEN 'L'
  WHEN regexp_matches(x, '(?i)^P$') THEN 'P' WHEN regexp_matches(x, '(?i)^CR[\\s]') THEN 'CR' ELSE 'UNKNOWN' END AS train_type,
  upper(CASE WHEN contains(trim(l), ' ') THEN regexp_replace(trim(l), ' ', '') ELSE trim(l) END) AS line
FROM (SELECT o_orderkey, list_extract(['IC 33', 'ic-1', 'S52', 'L B9', 'P', 'CR 1', 'EXTRA'], CAST(o_orderkey % 7 AS INTEGER) + 1) AS x, ' ' || o_custkey % 50 || ' a 1 ' AS l FROM orders)""")
def train_type_and_line(spark, sf):
    k = F.col("o_orderkey")
    x = F.get(F.array(*map(F.lit, ["IC 33", "ic-1", "S52", "L B9", "P", "CR 1", "EXTRA"])), (k % 7).cast("int"))
    line = F.concat(F.lit(" "), (F.col("o_custkey") % 50).cast("string"), F.lit(" a 1 "))
    return A.table(spark, sf, "orders").select(k.alias("k"), text.train_type(x).alias("train_type"), text.line_name(line).alias("line"))


@query("""SELECT event_id, coalesce(CAST(t AS VARCHAR), 'UNKNOWN') || '_' || coalesce(s, '') AS group_id, CAST(t AS VARCHAR) || '_' || s AS hist_group_id
FROM (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS t, CASE WHEN event_id % 7 <> 0 THEN event_type END AS s FROM events)""")
def group_keys(spark, sf):
    t, s = F.when(F.col("event_id") % 5 != 0, F.col("user_id")), F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return A.table(spark, sf, "events").select("event_id", text.group_id(t, s).alias("group_id"), text.strict_group_id(t, s).alias("hist_group_id"))


@query("""WITH x AS (SELECT p_partkey AS k, p_partkey % 4 AS f, p_retailprice AS v FROM part)
SELECT k, CASE WHEN f = 3 THEN NULL ELSE round(v, 2) END AS number, CASE f WHEN 0 THEN 50.0 + k % 100 / 100.0 WHEN 1 THEN 50.0 + k % 100 / 100.0 WHEN 2 THEN 4.25 END AS lat, CASE f WHEN 0 THEN 4.25 WHEN 1 THEN 4.25 WHEN 2 THEN 50.0 + k % 100 / 100.0 END AS lon FROM x""")
def lenient_float_and_point(spark, sf):
    k, f = F.col("p_partkey"), F.col("p_partkey") % 4
    v, y = F.round("p_retailprice", 2).cast("decimal(12,2)").cast("string"), (F.lit(50) + k % 100 / 100.0).cast("decimal(8,2)").cast("string")
    number = F.when(f == 0, F.replace(v, F.lit("."), F.lit(","))).when(f == 1, F.concat(v, F.lit("abc"))).when(f == 2, F.concat(F.lit("  "), v)).otherwise("abc")
    shape = F.when(f == 0, F.concat(y, F.lit(", 4.25"))).when(f == 1, F.concat(F.lit("POINT ("), y, F.lit(" 4.25)"))).when(f == 2, F.concat(F.lit('{"coordinates":[4.25, '), y, F.lit("]}"))).otherwise("none")
    x = A.table(spark, sf, "part").select(k.alias("k"), number.alias("number"), text.point(shape).alias("p"))
    return x.select("k", text.lenient_float(F.col("number")).alias("number"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


# --- trips -------------------------------------------------------------------------------------------------------


def _sub_trips(spark, sf):
    return trips.segments(trips.stop_flags(trips.sessions(A.stop_times(spark, sf))))


@query(f"WITH {A.STOP_TIMES} SELECT trip_id, stop_sequence, sub_trip_idx, real_trip_id FROM s3")
def trip_sessions(spark, sf):
    return trips.sessions(A.stop_times(spark, sf)).select("trip_id", "stop_sequence", "sub_trip_idx", "real_trip_id")


@query(f"WITH {A.STOP_TIMES} SELECT real_trip_id, stop_sequence, is_real_stop, local_sequence FROM s4")
def trip_real_stops(spark, sf):
    return trips.stop_flags(trips.sessions(A.stop_times(spark, sf))).select("real_trip_id", "stop_sequence", "is_real_stop", "local_sequence")


@query(f"""WITH {A.STOP_TIMES} SELECT real_trip_id, CAST(sum(is_real_stop) AS BIGINT) AS nb_stops, max(local_sequence) AS max_sequence, arg_min(departure_s, stop_sequence) AS start_s, arg_max(departure_s, stop_sequence) AS end_s,
  round(arg_min(lat, stop_sequence), 4) AS first_lat, round(arg_max(lon, stop_sequence), 4) AS last_lon,
  round(sum(coalesce({A.haversine_sql("plat", "plon", "lat", "lon")}, 0.0)), 5) AS path_km, max(CASE WHEN stop_name = 'SCHAARBEEK' THEN local_sequence ELSE -1 END) AS max_seq_hub_schaerbeek,
  max(CASE WHEN stop_name IN ('BRUSSEL-ZUID', 'BRUXELLES-NORD') THEN local_sequence ELSE -1 END) AS max_seq_jonction_nord_midi FROM s4 GROUP BY real_trip_id""")
def trip_summary(spark, sf):
    s = trips.trip_summary(_sub_trips(spark, sf), trips.hub_predicates(F.col("stop_name")))
    return s.select("real_trip_id", "nb_stops", "max_sequence", "start_s", "end_s", r("first_lat", 4).alias("first_lat"), r("last_lon", 4).alias("last_lon"), r("path_km", 5).alias("path_km"), "max_seq_hub_schaerbeek", "max_seq_jonction_nord_midi")


_TRIP_HUBS = {k: ", ".join(f"'{x}'" for x in v) for k, v in FEATURE_HUBS.items()}
_MAJOR = ", ".join(f"'{x}'" for x in sorted({*JUNCTION, *(x for v in HUBS.values() for x in v)}))


@query(f"""WITH {A.STOP_TIMES}, m AS (SELECT real_trip_id, max(local_sequence) AS last, {", ".join(f"max(CASE WHEN stop_name IN ({v}) THEN local_sequence ELSE -1 END) AS {k}" for k, v in _TRIP_HUBS.items())} FROM s4 GROUP BY 1)
SELECT real_trip_id, stop_sequence, round(CASE WHEN last > 1 THEN (local_sequence - 1) / CAST(last - 1 AS DOUBLE) ELSE 0.0 END, 6) AS position_dans_trajet, CASE WHEN local_sequence = last THEN 1 ELSE 0 END AS est_gare_terminus,
  {", ".join(f"CASE WHEN {k} > local_sequence THEN 1 ELSE 0 END AS traverse_{k}" for k in _TRIP_HUBS)}, CASE WHEN stop_name IN ({_MAJOR}) THEN 1 ELSE 0 END AS est_hub_majeur FROM s4 JOIN m USING (real_trip_id)""")
def trip_position_and_hubs(spark, sf):
    s = trips.position_and_hubs(_sub_trips(spark, sf))
    return s.select("real_trip_id", "stop_sequence", r("position_dans_trajet").alias("position_dans_trajet"), "est_gare_terminus", *[f"traverse_{k}" for k in FEATURE_HUBS], "est_hub_majeur")


def _match_sql(nulls: str) -> str:
    return f"""WITH {A.STOP_TIMES}, e AS (SELECT event_id, user_id % 100 + 1 AS stop_id, CAST(date_diff('second', CAST(CAST(ts AS DATE) AS TIMESTAMP), ts) AS BIGINT) AS row_s FROM events),
c AS (SELECT stop_id, CAST(real_trip_id AS VARCHAR) AS real_trip_id, stop_sequence, CASE WHEN trip_id % 11 <> 0 THEN departure_s % 86400 END AS candidate_s FROM s3),
m AS (SELECT e.event_id, e.stop_id, real_trip_id, stop_sequence, least(abs(row_s - candidate_s), abs(86400 - abs(row_s - candidate_s))) AS sched_diff FROM e LEFT JOIN c USING (stop_id))
SELECT event_id, real_trip_id, sched_diff FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sched_diff NULLS {nulls}, real_trip_id NULLS LAST, stop_sequence NULLS LAST) AS k FROM m) WHERE k = 1"""


def _match(spark, sf, strict):
    t = F.col("ts")
    e = A.table(spark, sf, "events").select("event_id", (F.col("user_id") % 100 + 1).alias("stop_id"), (F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))).cast("long").alias("row_s"))
    s = trips.sessions(A.stop_times(spark, sf))
    c = s.select("stop_id", "real_trip_id", "stop_sequence", F.when(F.col("trip_id") % 11 != 0, F.col("departure_s") % 86400).alias("candidate_s"))
    return trips.best_match(e, c, ["stop_id"], strict=strict).select("event_id", "real_trip_id", "sched_diff")


@query(_match_sql("LAST"))
def best_match_cyclic(spark, sf):
    return _match(spark, sf, False)


@query(_match_sql("FIRST"))
def best_match_cyclic_strict(spark, sf):
    return _match(spark, sf, True)


@query(f"""WITH {A.STOP_TIMES}, t AS (SELECT real_trip_id, sum(coalesce({A.haversine_sql("plat", "plon", "lat", "lon")}, 0.0)) AS path, {A.haversine_sql("arg_min(lat, stop_sequence)", "arg_min(lon, stop_sequence)", "arg_max(lat, stop_sequence)", "arg_max(lon, stop_sequence)")} AS straight,
  arg_max(departure_s, stop_sequence) - arg_min(departure_s, stop_sequence) AS s FROM s4 GROUP BY 1), u AS (SELECT *, CASE WHEN s < 0 THEN s + 86400 ELSE s END AS dur FROM t)
SELECT real_trip_id, round(least(CASE WHEN (dur > 0 AND path * 3600.0 > dur * 220.0) OR path > straight * 1.5 THEN straight ELSE path END, straight * 1.2, 220.0), 5) AS longueur_trajet_km FROM u""")
def trip_distance_sanity(spark, sf):
    s = trips.trip_summary(_sub_trips(spark, sf))
    straight = geo.haversine(*map(F.col, ("first_lat", "first_lon", "last_lat", "last_lon")))
    return s.select("real_trip_id", r(trips.sane_distance(F.col("path_km"), straight, F.col("end_s") - F.col("start_s")), 5).alias("longueur_trajet_km"))


@query(f"""WITH {A.STOP_TIMES}, t AS (SELECT real_trip_id, stop_sequence, departure_s % 86400 AS now, first_value(departure_s) OVER w % 86400 AS a, last_value(departure_s) OVER w % 86400 AS b FROM s3
  WINDOW w AS (PARTITION BY real_trip_id ORDER BY stop_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, CASE WHEN now - a < -43200 THEN now - a + 86400 WHEN now - a > 43200 THEN now - a - 86400 ELSE now - a END AS x, CASE WHEN b - now < -43200 THEN b - now + 86400 WHEN b - now > 43200 THEN b - now - 86400 ELSE b - now END AS y FROM t)
SELECT real_trip_id, stop_sequence, round(least(greatest(x, 0) / 60.0, 300.0), 4) AS depuis_depart, round(least(greatest(y, 0) / 60.0, 300.0), 4) AS jusque_arrivee FROM d""")
def theoretical_times(spark, sf):
    s = trips.theoretical_minutes(trips.sessions(A.stop_times(spark, sf)))
    return s.select("real_trip_id", "stop_sequence", r("temps_theorique_depuis_depart", 4).alias("depuis_depart"), r("temps_theorique_jusque_arrivee", 4).alias("jusque_arrivee"))


# --- density, works ----------------------------------------------------------------------------------------------


@query(f"WITH {A.PUNCTUALITY} SELECT station, CAST(count(DISTINCT x) + max(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nb_connexions FROM (SELECT station, CASE WHEN event_id % 19 <> 0 THEN line END AS x FROM p) GROUP BY station")
def station_connectivity(spark, sf):
    p = A.punctuality(spark, sf).withColumn("x", F.when(F.col("event_id") % 19 != 0, F.col("line")))
    return trips.connections(p, "station", "x")


_DENSE = f"WITH {A.PUNCTUALITY}, q AS (SELECT *, CASE WHEN event_id % 13 <> 0 THEN train END AS tr FROM p)"


def _dense(spark, sf):
    p = A.punctuality(spark, sf)
    return p.select("event_id", "line", "hour", F.col("d").alias("date"), F.when(F.col("event_id") % 13 != 0, F.col("train")).alias("train"))


def _flags():
    return {k: F.col("event_id") % (i + 2) == 0 for i, k in enumerate(CONGESTION)}


@query(_DENSE + " SELECT d AS date, hour, line, CAST(count(DISTINCT tr) + max(CASE WHEN tr IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nb_trains FROM q GROUP BY 1, 2, 3")
def line_density(spark, sf):
    return density.line_density(_dense(spark, sf))


def _hubs_sql() -> str:
    one = "CAST(count(DISTINCT CASE WHEN event_id % {m} = 0 THEN tr END) + max(CASE WHEN event_id % {m} = 0 AND tr IS NULL THEN 1 ELSE 0 END) AS BIGINT)"
    cols = {k: one.format(m=i + 2) for i, k in enumerate(CONGESTION)}
    score = " + ".join(f"densite_{k} * ({w} / {c}.0)" for k, (c, w) in CONGESTION.items())
    return _DENSE + f", h AS (SELECT d AS date, hour, {', '.join(f'{v} AS densite_{k}' for k, v in cols.items())} FROM q GROUP BY 1, 2) SELECT *, round({score}, 6) AS congestion_prevue_score FROM h"


@query(_hubs_sql())
def hub_density_and_congestion(spark, sf):
    h = density.hub_density(_dense(spark, sf), _flags())
    return h.withColumn("congestion_prevue_score", r(density.congestion({k: F.col(f"densite_{k}") for k in CONGESTION})))


@query(f"WITH {A.WORKS} SELECT line, date, count(*) AS nb, max(level) AS level, arg_max(kind, level * 100 + ascii(kind) - 97 + CASE kind WHEN 'other' THEN 1 ELSE 0 END) AS kind FROM wd GROUP BY 1, 2")
def works_daily(spark, sf):
    return works.daily_impact(works.daily(A.works(spark, sf)))


@query(f"""WITH {A.WORKS}, s AS (SELECT DISTINCT o_orderpriority AS line, CAST(o_orderdate AS DATE) AS date, o_custkey % 30 AS stop_id FROM orders), t AS (SELECT *, 49.5 + stop_id / 100.0 AS la, 2.5 + stop_id * 7 % 390 / 100.0 AS lo FROM s)
SELECT line, date, stop_id, round(min({A.haversine_sql("la", "lo", "wd.lat", "wd.lon")}), 5) AS travaux_distance_km FROM t JOIN wd USING (line, date) GROUP BY 1, 2, 3""")
def works_min_distance(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("line"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_custkey") % 30).alias("stop_id"))
    near = works.nearest_site(o.select("*", *A.coordinates(F.col("stop_id"))), works.daily(A.works(spark, sf)))
    return near.select("line", "date", "stop_id", r("km", 5).alias("travaux_distance_km"))


@query(f"""WITH {A.WORKS}, g AS (SELECT line, date, count(*) AS n, max(level) AS l FROM wd GROUP BY 1, 2), x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE o_orderpriority END AS line, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT k, coalesce(n, 0) AS travaux_nb_actifs_ligne, coalesce(l, -1) AS travaux_niveau_impact, CASE WHEN n > 0 THEN 1 ELSE 0 END AS travaux_actif_ligne FROM x LEFT JOIN g USING (line, date)""")
def works_features(spark, sf):
    x = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise(F.col("o_orderpriority")).alias("line"), F.col("o_orderdate").cast("date").alias("date"))
    out = works.impact_features(x, works.daily(A.works(spark, sf)))
    return out.select("k", F.col("nb").alias("travaux_nb_actifs_ligne"), F.col("level").alias("travaux_niveau_impact"), F.col("active").alias("travaux_actif_ligne"))


# --- weather -----------------------------------------------------------------------------------------------------

_EXPANDED = f"""{A.OBSERVATIONS}, x AS (SELECT o.*, s.d, ((hour + s.d) % 24 + 24) % 24 AS hr FROM o, (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS d) s),
h AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY station, date, hr ORDER BY abs(d), CASE WHEN d >= 0 THEN 0 ELSE 1 END, hour) AS rn FROM x) WHERE rn = 1)"""
_COLUMNS = ["temperature", "precipitations", "vent_vitesse", "vent_pointe", "humidite", "nebulosite"]


@query(f"WITH {_EXPANDED} SELECT station, date, CAST(hr AS INTEGER) AS hour, round(temperature, 3) + 0.0 AS temperature, round(nebulosite, 3) AS nebulosite FROM h")
def weather_hour_expand(spark, sf):
    h = weather.expand_hours(A.observations(spark, sf), _COLUMNS)
    return h.select("station", "date", F.col("hour").cast("int").alias("hour"), r("temperature", 3).alias("temperature"), r("nebulosite", 3).alias("nebulosite"))


def _weather_sql() -> str:
    v = {n: f"coalesce(CASE WHEN a.temperature IS NOT NULL AND a.nebulosite IS NOT NULL THEN a.{n} ELSE b.{n} END, {d})" for n, d in WEATHER_DEFAULTS.items()}
    return f"""WITH {A.PUNCTUALITY}, {_EXPANDED}, v AS (SELECT event_id, {", ".join(f"{e} AS {n}" for n, e in v.items())}, coalesce(c.temperature, e.temperature, 10.0) AS before
  FROM (SELECT event_id, d, hour, CAST(train % 33 AS VARCHAR) AS station FROM p) q LEFT JOIN h a ON a.station = q.station AND a.date = q.d AND a.hr = q.hour LEFT JOIN h b ON b.station = '3' AND b.date = q.d AND b.hr = q.hour
  LEFT JOIN h c ON c.station = q.station AND c.date = q.d - 1 AND c.hr = q.hour LEFT JOIN h e ON e.station = '3' AND e.date = q.d - 1 AND e.hr = q.hour)
SELECT event_id, round(temperature, 1) + 0.0 AS meteo_temperature, round(precipitations, 1) AS meteo_precipitations, round(vent_vitesse, 1) AS meteo_vent_vitesse,
  CASE WHEN vent_pointe > 25 OR vent_vitesse > 20 OR precipitations > 10 OR temperature < -5 OR temperature > 35 OR (nebulosite >= 8 AND humidite >= 95) THEN 1 ELSE 0 END AS meteo_conditions_extremes, round(before, 1) + 0.0 AS meteo_observee_j_1 FROM v"""


@query(_weather_sql())
def weather_features(spark, sf):
    q = A.punctuality(spark, sf).select("event_id", F.col("d").alias("date"), "hour", (F.col("train") % 33).cast("string").alias("station"))
    w = weather.weather_features(q, weather.expand_hours(A.observations(spark, sf), _COLUMNS), default="3")
    return w.select("event_id", "meteo_temperature", "meteo_precipitations", "meteo_vent_vitesse", "meteo_conditions_extremes", "meteo_observee_j_1")


_FAR = "(2 * atan2(sqrt(h), sqrt(1 - h)) * 6371.0)"


@query(f"""WITH g AS (SELECT c_custkey AS place_id, 49.5 + c_custkey % 211 / 100.0 AS lat, 2.5 + c_custkey * 3 % 390 / 100.0 AS lon FROM customer), s AS (SELECT s_suppkey AS ordinal, 'M' || s_suppkey AS station_id, 49.5 + s_suppkey * 31 % 200 / 100.0 AS la, 2.5 + s_suppkey * 53 % 390 / 100.0 AS lo FROM supplier),
k AS (SELECT *, pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2) AS h FROM g, s), m AS (SELECT *, {_FAR} AS km FROM k)
SELECT place_id, arg_min(station_id, km) AS station_id, round(min(km), 3) AS distance_km, min(km) > 50.0 AS no_station FROM m GROUP BY place_id""")
def station_mapping_nearest(spark, sf):
    k, o = F.col("c_custkey"), F.col("s_suppkey")
    g = A.table(spark, sf, "customer").select(k.alias("place_id"), (F.lit(49.5) + k % 211 / 100.0).alias("lat"), (F.lit(2.5) + k * 3 % 390 / 100.0).alias("lon"))
    s = A.table(spark, sf, "supplier").select(o.alias("ordinal"), F.concat(F.lit("M"), o.cast("string")).alias("station_id"), (F.lit(49.5) + o * 31 % 200 / 100.0).alias("s_lat"), (F.lit(2.5) + o * 53 % 390 / 100.0).alias("s_lon"))
    return weather.nearest_station(g, s)


def _weather(spark, sf):
    """Observed hours, stations, and the hours of the grid: two days more than observed at both ends."""
    seen = A.hourly_weather(spark, sf)
    span = seen.agg(F.min("h").alias("a"), F.max("h").alias("b")).first()
    return seen, A.weather_stations(spark), span.a - 48, span.b + 48


_GRID = A.resolved_sql(OWN_TIERS, ALL_TIERS)


@query(f'WITH {_GRID} SELECT station, h, "offset", source FROM grid')
def weather_grid_resolve(spark, sf):
    seen, stations, first, last = _weather(spark, sf)
    return weather.resolve_grid(seen.select("station", "h"), stations, first, last).select("station", "h", "offset", "source")


def _enriched_sql() -> str:
    value = {"temp": "v / 10 - 5", "precip": "v % 13", "wind_speed": "v % 23", "humidity": "v % 100", "pressure": "v % 50 + 980"}
    side = lambda p, n: ", ".join(f"round({p}.{c}, 4) AS {c}_{n}" for c in value)
    return f"""WITH {A.RAW_ROWS}, {_GRID}, mp AS (SELECT CAST(i AS VARCHAR) AS place, 'W' || (i % 61) AS station, round(i * 0.7, 3) AS km, i % 9 = 0 AS none FROM range(71) t(i) WHERE i % 13 <> 0),
w AS (SELECT g.station, g.h, g."offset", {", ".join(f"{e} AS {c}" for c, e in value.items())}, o.v IS NOT NULL AS found FROM grid g LEFT JOIN hw o ON o.station = g.source AND o.h = g.h + g."offset")
SELECT event_id, {side("x", "depart")}, {side("y", "arrivee")}, m.station AS depart_station_meteo, n.station AS arrival_station_meteo, m.km AS depart_station_distance_km, n.km AS arrival_station_distance_km,
  coalesce(m.none, TRUE) AS depart_no_station, coalesce(n.none, TRUE) AS arrival_no_station, CASE WHEN x.found THEN x."offset" END AS depart_weather_offset_hours, CASE WHEN y.found THEN y."offset" END AS arrival_weather_offset_hours
FROM rr LEFT JOIN mp m ON m.place = dp LEFT JOIN mp n ON n.place = ap LEFT JOIN w x ON x.station IS NOT DISTINCT FROM m.station AND x.h = dh LEFT JOIN w y ON y.station IS NOT DISTINCT FROM n.station AND y.h = ah"""


def _enriched(spark, sf):
    return enrich.enrich(A.raw_rows(spark, sf), A.station_mapping(spark), enrich.hour_weather(*_weather(spark, sf)))


@query(_enriched_sql())
def weather_enrich(spark, sf):
    """Rows of text with the weather of both sides: all 18 columns."""
    return _enriched(spark, sf).select("event_id", *enrich.OUTPUT)


@query(f"""SELECT count(*) AS rows, count(*) FILTER (WHERE depart_no_station) AS depart_missing_station, count(*) FILTER (WHERE arrival_no_station) AS arrival_missing_station,
  CAST(sum(CASE WHEN depart_weather_offset_hours IS NULL THEN 1 ELSE 0 END + CASE WHEN arrival_weather_offset_hours IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_weather FROM ({_enriched_sql()})""")
def enrichment_counters(spark, sf):
    return _enriched(spark, sf).agg(*enrich.enrichment_counters())


# --- history and scores ------------------------------------------------------------------------------------------


def _rolling_sql(keys: str) -> str:
    k = keys.split(", ")
    return f"""WITH {A.PUNCTUALITY}, g AS (SELECT {keys}, d, avg(coalesce(delay_min, 0.0)) AS m, stddev_samp(coalesce(delay_min, 0.0)) AS s, avg(CASE WHEN coalesce(delay_min, 0.0) < 6 THEN 1.0 ELSE 0.0 END) AS o FROM p GROUP BY {", ".join(map(str, range(1, len(k) + 2)))})
SELECT {keys}, d, round(avg(m) OVER a, 9) AS mean_7, round(avg(s) OVER a, 9) AS std_7, round(avg(o) OVER a, 9) AS ok_7, round(avg(m) OVER b, 9) AS mean_30 FROM g
WINDOW a AS (PARTITION BY {keys} ORDER BY d RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), b AS (PARTITION BY {keys} ORDER BY d RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"""


def _rolling(spark, sf, keys):
    return history.rolling(A.punctuality(spark, sf), keys).select(*keys, "d", *[r(c, 9).alias(c) for c in ("mean_7", "std_7", "ok_7", "mean_30")])


@query(_rolling_sql("line"))
def hist_rolling_line(spark, sf):
    return _rolling(spark, sf, ["line"])


@query(_rolling_sql("station"))
def hist_rolling_station(spark, sf):
    return _rolling(spark, sf, ["station"])


@query(_rolling_sql("station, hour"))
def hist_rolling_station_hour(spark, sf):
    return _rolling(spark, sf, ["station", "hour"])


_LAGS_OF_P = f"""g AS (SELECT train || '_' || station AS hist_group_id, d, avg(delay_min) AS m FROM p GROUP BY 1, 2),
l AS (SELECT g.hist_group_id, g.d, {", ".join(f"(SELECT x.m FROM g x WHERE x.hist_group_id = g.hist_group_id AND x.d = g.d - {n}) AS retard_j_{n}" for n in history.LAGS)} FROM g)"""

_LAGS = f"{A.PUNCTUALITY}, {_LAGS_OF_P}"


def _lags(spark, sf):
    p = A.punctuality(spark, sf)
    p = p.withColumn("hist_group_id", text.strict_group_id(F.col("train"), F.col("station")))
    return history.lag_features(history.lags(p))


@query(f"""WITH {_LAGS} SELECT hist_group_id, d, {", ".join(f"round(coalesce(retard_j_{n}, 0.0), 9) AS retard_j_{n}, CASE WHEN retard_j_{n} IS NULL THEN 1 ELSE 0 END AS lag_missing_j{n}" for n in history.LAGS)},
  CASE WHEN retard_j_7 IS NULL AND retard_j_14 IS NULL AND retard_j_21 IS NULL THEN 1 ELSE 0 END AS lag_missing_semaine, round(list_avg([x FOR x IN [retard_j_7, retard_j_14, retard_j_21] IF x IS NOT NULL]), 9) AS retard_moyen_meme_jour_semaine FROM l""")
def hist_lags(spark, sf):
    f = _lags(spark, sf)
    return f.select(*[r(c, 9).alias(c) if c.startswith("retard") else c for c in f.columns])


@query(f"""WITH {_LAGS}, v AS (SELECT hist_group_id, d, [greatest(x, 0.0) FOR x IN [{", ".join(f"retard_j_{n}" for n in range(1, 8))}] IF x IS NOT NULL] AS x FROM l), m AS (SELECT *, len(x) AS n, coalesce(list_avg(x), 0.0) AS mu FROM v),
s AS (SELECT *, coalesce(sqrt(list_avg([(y - mu) * (y - mu) FOR y IN x])), 0.0) AS sd FROM m)
SELECT hist_group_id, d, round(CASE WHEN n = 0 THEN 0.5 ELSE greatest(0.0, greatest(0.0, 1.0 - mu / 10.0) - CASE WHEN n >= 3 THEN least(0.2, sd / 10.0) ELSE 0.0 END) END, 6) AS fiabilite_train_historique,
  round(0.35 * least(1.0, mu / 10.0) + 0.25 * (n / 10.0) + 0.2 * CASE WHEN n % 2 = 1 THEN (n % 4 + 1) / 4.0 ELSE 0.0 END + 0.1 * (n % 3 // 2) + 0.05 * (n % 2), 6) AS risque_retard_score FROM s""")
def reliability_and_risk(spark, sf):
    f = scores.lag_moments(_lags(spark, sf)).withColumn("k", F.col("_n").cast("int"))
    k = F.col("k")
    risk = scores.risk(F.col("_m"), k / 10.0, k % 2, k % 4, F.floor(k % 3 / 2), k % 2)
    return f.select("hist_group_id", "d", r(scores.reliability()).alias("fiabilite_train_historique"), r(risk).alias("risque_retard_score"))


@query("""SELECT l_orderkey AS k, l_linenumber AS j, l_extendedprice AS u, round(0.4 * least(1.0, l_quantity / 50.0) + 0.3 * least(1.0, l_linenumber / 3.0) + 0.2 * CASE WHEN l_linenumber = 1 THEN 1.0 WHEN l_quantity > 5 THEN 0.5 WHEN l_quantity * 2 > 50 THEN 0.5 ELSE 0.0 END + 0.1 * (l_linenumber % 2), 6) AS stress_reseau_score,
  round((least(1.0, l_quantity / 25.0) + least(1.0, l_quantity * 2 / 100.0) + least(1.0, l_linenumber / 3.0) + least(1.0, l_linenumber / 10.0) + (1.0 - abs(0.5 - l_discount) * 2.0) * 0.5) / 4.5, 6) AS indice_complexite FROM lineitem""")
def stress_and_complexity(spark, sf):
    q, j = F.col("l_quantity"), F.col("l_linenumber")
    return A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), j.alias("j"), F.col("l_extendedprice").alias("u"), r(scores.stress(q, j, (j == 1).cast("int"), q, q * 2, j % 2)).alias("stress_reseau_score"),
        r(scores.complexity(q, q * 2, j, j, F.col("l_discount"))).alias("indice_complexite"),
    )


# --- preparation and evaluation ----------------------------------------------------------------------------------


@query("""WITH c AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderpriority <> '2-HIGH'))
SELECT o_orderkey AS k, coalesce(code, 0.0) AS priority_idx FROM orders LEFT JOIN c ON v = CASE WHEN o_orderkey % 23 <> 0 THEN o_orderpriority END""")
def label_encode(spark, sf):
    o = A.table(spark, sf, "orders")
    codes = rows.label_codes(o.where("o_orderkey % 3 <> 0 and o_orderpriority <> '2-HIGH'"), "o_orderpriority")
    x = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 23 != 0, F.col("o_orderpriority")).alias("priority"))
    return rows.encode_labels(x, "priority", codes).select("k", "priority_idx")


@query("""WITH t AS (SELECT *, CASE WHEN ts <= TIMESTAMP '2024-01-15 00:00:00' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-22 00:00:00' THEN 'val' ELSE 'test' END AS split FROM events), m AS (SELECT avg(value) AS a, stddev_samp(value) AS b FROM t WHERE split = 'train')
SELECT event_id, split, round((value - a) / b, 5) AS value_z FROM t, m""")
def split_and_zscore(spark, sf):
    t = A.table(spark, sf, "events").withColumn("split", ser.split_label(F.col("ts"), "2024-01-15", "2024-01-22"))
    out = ser.scale(t.withColumn("value_z", F.col("value")), {"value_z": ser.scaler(t.where("split = 'train'"), ["value"])["value"]})
    return out.select("event_id", "split", r("value_z", 5).alias("value_z"))


@query("SELECT event_id, user_id, CAST(ts AS DATE) AS d FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def dedup_series_day(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("ts").cast("date").alias("d"))
    return rows.keep_one(e, ["user_id", "d"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "d")


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def static_last(spark, sf):
    e = A.table(spark, sf, "events").withColumn("o", F.col("event_id"))
    return rows.last_values(e, "user_id", "o", ["event_id", "event_type"])


@query("WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM t)")
def topk_ids(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "user_id")
    return e.join(rows.top_ids(e, "user_id", 20).select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


@query(f"WITH {A.SERIES} SELECT group_id, count(*) AS n, CAST(CASE WHEN count(*) >= 10 THEN (count(*) - 10) // 2 + 1 ELSE 0 END AS BIGINT) AS windows FROM sr GROUP BY 1")
def series_windows(spark, sf):
    return ser.window_counts(A.series(spark, sf), "group_id", 10, 2)


@query(f"WITH {A.SERIES} SELECT * FROM sr WHERE group_id IN (SELECT group_id FROM sr GROUP BY 1 HAVING count(*) >= 26)")
def short_series(spark, sf):
    return ser.long_series(A.series(spark, sf), "group_id", 26)


_GAPS = f"""{A.SERIES}, e AS (SELECT group_id, min(time_idx) AS a, max(time_idx) AS b FROM sr GROUP BY 1), days AS (SELECT group_id, unnest(generate_series(a, b)) AS time_idx FROM e), x AS (SELECT group_id, time_idx, CASE WHEN time_idx % 5 <> 0 THEN target END AS target FROM days LEFT JOIN sr USING (group_id, time_idx)),
bf AS (SELECT group_id, time_idx, last_value(target IGNORE NULLS) OVER (PARTITION BY group_id ORDER BY time_idx ROWS UNBOUNDED PRECEDING) AS f, first_value(target IGNORE NULLS) OVER (PARTITION BY group_id ORDER BY time_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM x)"""


def _gaps(spark, sf):
    return A.series(spark, sf).withColumn("target", F.when(F.col("time_idx") % 5 != 0, F.col("target")))


@query(f"WITH {_GAPS} SELECT group_id, time_idx, coalesce(b, 0.0) AS target FROM bf")
def future_frame_fill(spark, sf):
    return ser.complete_days(_gaps(spark, sf), "group_id", "time_idx", ["target"])


@query(f"WITH {_GAPS}, m AS (SELECT time_idx, avg(coalesce(f, b)) AS m FROM bf GROUP BY 1) SELECT group_id, time_idx, round(coalesce(f, b, m, 0.0), 6) AS target FROM bf JOIN m USING (time_idx)")
def future_frame_fill_training(spark, sf):
    return ser.complete_days(_gaps(spark, sf), "group_id", "time_idx", ["target"], "training").withColumn("target", r("target"))


@query(f"""WITH {A.SERIES}, a AS (SELECT group_id, max(time_idx) AS l FROM sr WHERE time_idx <= 19736 GROUP BY 1), b AS (SELECT group_id, min(time_idx) AS f FROM sr WHERE time_idx > 19736 GROUP BY 1)
SELECT count(*) AS series, count(*) FILTER (WHERE f - l = 1) AS adjoining, round(avg(f - l), 6) AS mean_gap FROM a JOIN b USING (group_id)""")
def split_gap_stats(spark, sf):
    s = A.series(spark, sf)
    g = ser.split_gaps(s.where("time_idx <= 19736"), s.where("time_idx > 19736"), "group_id", "time_idx")
    return g.withColumn("mean_gap", r("mean_gap"))


_EVAL = f"""{A.SERIES}, ids AS (SELECT group_id, CAST(row_number() OVER (ORDER BY group_id) - 1 AS INTEGER) AS unique_id FROM (SELECT DISTINCT group_id FROM sr WHERE time_idx <= 19736)),
q AS (SELECT unique_id, time_idx AS ds, target AS y FROM sr JOIN ids USING (group_id)), h AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS k FROM q WHERE ds > 19736), n AS (SELECT unique_id, arg_max(y, ds) AS naive FROM q WHERE ds <= 19736 GROUP BY 1),
pr AS (SELECT unique_id, ds + 1 AS ds, y * 0.9 + 0.1 AS pred FROM q), j AS (SELECT h.unique_id, h.ds, h.y, pred, naive FROM h JOIN pr USING (unique_id, ds) LEFT JOIN n USING (unique_id) WHERE k <= 2)"""


def _evaluated(spark, sf):
    """Predictions are made from the day before, so days after a gap have none."""
    s = A.series(spark, sf)
    ids = ser.series_ids(s.where("time_idx <= 19736"), "group_id")
    q = ser.with_ids(s, ids, "group_id", "time_idx", "target")
    predicted = q.select("unique_id", (F.col("ds") + 1).alias("ds"), (F.col("y") * 0.9 + 0.1).alias("model"))
    return ser.matched(predicted, q.where("ds > 19736"), q.where("ds <= 19736"), "model", 2)


@query(f"WITH {_EVAL} SELECT unique_id, ds, y, round(pred, 6) AS pred, naive FROM j")
def eval_head_h(spark, sf):
    return _evaluated(spark, sf).select("unique_id", "ds", "y", r("pred").alias("pred"), "naive")


@query(f"""WITH {_EVAL} SELECT round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(avg(abs(naive - y)), 6) AS naive_mae, count(*) AS n, round(100.0 * (avg(abs(naive - y)) - avg(abs(pred - y))) / avg(abs(naive - y)), 4) AS improvement FROM j""")
def metrics_block(spark, sf):
    m = ser.metrics(_evaluated(spark, sf))
    return m.select(r("mae").alias("mae"), r("rmse").alias("rmse"), r("naive_mae").alias("naive_mae"), "n", r("improvement", 4).alias("improvement"))


@query("""SELECT round(avg(l_quantity * l_quantity), 3) AS m0, round(var_pop(l_quantity * l_quantity), 0) AS v0, round(avg(l_quantity * l_discount), 5) AS m1, round(var_pop(l_quantity * l_discount), 5) AS v1, round(avg(l_discount * l_discount), 7) AS m2, round(var_pop(l_discount * l_discount), 9) AS v2 FROM lineitem""")
def poly_features_stats(spark, sf):
    products = ridge.degree_two(["l_quantity", "l_discount"])
    x = A.table(spark, sf, "lineitem").select(*[p.alias(f"x{i}") for i, p in enumerate(products)])
    places = ((3, 0), (5, 5), (7, 9))
    return x.agg(*[e for i, (a, b) in enumerate(places) for e in (r(F.avg(f"x{i}"), a).alias(f"m{i}"), r(F.var_pop(f"x{i}"), b).alias(f"v{i}"))])


@query()
def ridge_fit_predict(spark, sf):
    """Lags of the daily series predict the next day; penalties chosen on the later days."""
    s = A.series(spark, sf)
    w = Window.partitionBy("group_id").orderBy("time_idx")
    names = ["x1", "x2", "x3"]
    x = s.select("group_id", "time_idx", "target", *[F.lag("target", i + 1).over(w).alias(n) for i, n in enumerate(names)]).dropna()
    train, val = x.where("time_idx <= 19730"), x.where("time_idx > 19730")
    model = ridge.fit(ser.scale(train, by := ser.scaler(train, names)), names, "target", ser.scale(val, by))
    return ser.scale(val, by).select("group_id", "time_idx", "target", model.predict().alias("pred"))


@query(f"WITH {A.SERIES} SELECT group_id FROM sr WHERE time_idx <= 19730 INTERSECT SELECT group_id FROM sr WHERE time_idx > 19740")
def shared_keys_intersect(spark, sf):
    s = A.series(spark, sf)
    return s.where("time_idx <= 19730").select("group_id").intersect(s.where("time_idx > 19740").select("group_id"))


@query("""WITH u AS (SELECT s_nationkey % 7 AS k, s_acctbal AS v, 0 AS p FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, 1 FROM customer UNION ALL SELECT n_nationkey + 20, CAST(n_regionkey AS DOUBLE), 2 FROM nation)
SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, v) AS i FROM u) WHERE i = 1""")
def name_union(spark, sf):
    s = A.table(spark, sf, "supplier").select((F.col("s_nationkey") % 7).alias("k"), F.col("s_acctbal").alias("v"))
    c = A.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))
    n = A.table(spark, sf, "nation").select((F.col("n_nationkey") + 20).alias("k"), F.col("n_regionkey").cast("double").alias("v"))
    return rows.union_with_priority([s, c, n], ["k"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_scalar(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


_CHAIN = ["position_dans_trajet", "est_gare_terminus", "traverse_hub_liege", "traverse_jonction_nord_midi", "nb_arrets_total", "longueur_trajet_km", "temps_theorique_depuis_depart", "nb_trains", "densite_hub_gent",
  "congestion_prevue_score", "nb_connexions_gare", "nb", "level", "travaux_distance_km", "meteo_temperature", "meteo_conditions_extremes", "retard_j_1", "retard_moyen_meme_jour_semaine", "ligne_mean_7", "slot_mean_30",
  "fiabilite_train_historique", "risque_retard_score", "stress_reseau_score", "indice_complexite", "target", "is_jour_ferie"]


def _chain_sql() -> str:
    hubs = list(CONGESTION)
    names = {k: ", ".join(f"'{x}'" for x in FEATURE_HUBS[k]) for k in hubs}
    tops = ", ".join(f"max(CASE WHEN stop_name IN ({v}) THEN local_sequence ELSE -1 END) AS m_{k}" for k, v in names.items())
    ahead = {k: f"CASE WHEN m_{k} > local_sequence THEN 1 ELSE 0 END" for k in hubs}
    dense = ", ".join(f"CAST(count(DISTINCT CASE WHEN {k} = 1 THEN train END) AS BIGINT) AS n_{k}" for k in hubs)
    congestion = " + ".join(f"n_{k} * ({w} / {c}.0)" for k, (c, w) in CONGESTION.items())
    weather_of = {n: f"coalesce(CASE WHEN a.temperature IS NOT NULL AND a.nebulosite IS NOT NULL THEN a.{n} ELSE b.{n} END, {d})" for n, d in WEATHER_DEFAULTS.items()}
    rolled = lambda keys, days, tag: f"(SELECT avg(m) FROM {tag} z WHERE {' AND '.join(f'z.{k} = e.{k}' for k in keys)} AND z.d BETWEEN e.d - {days} AND e.d - 1)"
    return f"""WITH {A.JOURNEYS}, {A.STOP_TIMES}, {_LAGS_OF_P}, {A.WORKS}, {_EXPANDED}, t1 AS (SELECT real_trip_id, max(local_sequence) AS last, CAST(sum(is_real_stop) AS BIGINT) AS stops, {tops}, arg_min(departure_s, stop_sequence) AS sa, arg_max(departure_s, stop_sequence) AS sb,
  sum(coalesce({A.haversine_sql("plat", "plon", "lat", "lon")}, 0.0)) AS path, {A.haversine_sql("arg_min(lat, stop_sequence)", "arg_min(lon, stop_sequence)", "arg_max(lat, stop_sequence)", "arg_max(lon, stop_sequence)")} AS straight FROM s4 GROUP BY 1),
t2 AS (SELECT *, CASE WHEN sb - sa < 0 THEN sb - sa + 86400 ELSE sb - sa END AS dur FROM t1),
t3 AS (SELECT s4.*, CASE WHEN last > 1 THEN (local_sequence - 1) / CAST(last - 1 AS DOUBLE) ELSE 0.0 END AS pos, CASE WHEN local_sequence = last THEN 1 ELSE 0 END AS term, {", ".join(f"{v} AS {k}" for k, v in ahead.items())}, stops,
  least(CASE WHEN (dur > 0 AND path * 3600.0 > dur * 220.0) OR path > straight * 1.5 THEN straight ELSE path END, straight * 1.2, 220.0) AS km, departure_s % 86400 - sa % 86400 AS since FROM s4 JOIN t2 USING (real_trip_id)),
c AS (SELECT event_id, t3.*, row_number() OVER (PARTITION BY event_id ORDER BY least(abs(rs - t3.departure_s % 86400), abs(86400 - abs(rs - t3.departure_s % 86400))), CAST(real_trip_id AS VARCHAR), stop_sequence) AS k FROM (SELECT *, hour(datetime) * 3600 + minute(datetime) * 60 + CAST(floor(second(datetime)) AS INTEGER) AS rs FROM p) q JOIN t3 ON t3.trip_id = q.train AND t3.stop_name = q.station),
e0 AS (SELECT p.*, coalesce(pos, 0.0) AS pos, coalesce(term, 0) AS term, {", ".join(f"coalesce({k}, 0) AS {k}" for k in hubs)}, coalesce(stops, 0) AS stops, coalesce(km, 0.0) AS km, coalesce(least(greatest(CASE WHEN since < -43200 THEN since + 86400 WHEN since > 43200 THEN since - 86400 ELSE since END, 0) / 60.0, 300.0), 0.0) AS since, c.stop_id, c.lat, c.lon FROM p LEFT JOIN c ON c.event_id = p.event_id AND c.k = 1),
ld AS (SELECT d, hour, line, count(DISTINCT train) AS nb_trains FROM e0 GROUP BY 1, 2, 3), hd AS (SELECT d, hour, {dense} FROM e0 GROUP BY 1, 2), cn AS (SELECT station, count(DISTINCT line) AS cn FROM p GROUP BY 1), wg AS (SELECT line, date AS d, count(*) AS nb, max(level) AS level FROM wd GROUP BY 1, 2),
nw AS (SELECT line, d, stop_id, min({A.haversine_sql("q.lat", "q.lon", "wd.lat", "wd.lon")}) AS far FROM (SELECT DISTINCT line, d, stop_id, lat, lon FROM e0 WHERE stop_id IS NOT NULL) q JOIN wd USING (line) WHERE wd.date = q.d GROUP BY 1, 2, 3),
rl AS (SELECT line, d, avg(coalesce(delay_min, 0.0)) AS m FROM p GROUP BY 1, 2), rs AS (SELECT station, hour, d, avg(coalesce(delay_min, 0.0)) AS m FROM p GROUP BY 1, 2, 3),
wx AS (SELECT p.event_id, {", ".join(f"{v} AS {n}" for n, v in weather_of.items())} FROM p LEFT JOIN h a ON a.station = CAST((list_position({A.NAMES!r}, p.station) - 1) * 3 AS VARCHAR) AND a.date = p.d AND a.hr = p.hour LEFT JOIN h b ON b.station = '3' AND b.date = p.d AND b.hr = p.hour),
hl AS (SELECT DISTINCT line, d FROM p), hs AS (SELECT DISTINCT station, hour, d FROM p), ql AS (SELECT line, d, coalesce({rolled(["line"], 7, "rl")}, 0.0) AS m7 FROM hl e), qs AS (SELECT station, hour, d, coalesce({rolled(["station", "hour"], 30, "rs")}, 0.0) AS m30 FROM hs e),
lm AS (SELECT *, len(x) AS n, coalesce(list_avg(x), 0.0) AS mu, coalesce(sqrt(list_avg([(y - coalesce(list_avg(x), 0.0)) * (y - coalesce(list_avg(x), 0.0)) FOR y IN x])), 0.0) AS sd FROM (SELECT *, [greatest(v, 0.0) FOR v IN [{", ".join(f"retard_j_{i}" for i in range(1, 8))}] IF v IS NOT NULL] AS x FROM l)),
z AS (SELECT e0.*, {congestion} AS cong, n_hub_gent, (n_jonction_nord_midi + n_hub_bruxelles_midi + n_hub_schaerbeek + nb_trains) / 4.0 AS dens, nb_trains, cn, coalesce(nb, 0) AS nb, coalesce(level, -1) AS level, far, round(temperature, 1) + 0.0 AS t, round(precipitations, 1) AS rain, round(vent_vitesse, 1) AS wind,
  CASE WHEN vent_pointe > 25 OR vent_vitesse > 20 OR precipitations > 10 OR temperature < -5 OR temperature > 35 OR (nebulosite >= 8 AND humidite >= 95) THEN 1 ELSE 0 END AS ext, coalesce(retard_j_1, 0.0) AS r1, list_avg([v FOR v IN [retard_j_7, retard_j_14, retard_j_21] IF v IS NOT NULL]) AS wk, m7, m30, n, mu, sd,
  CASE WHEN isodow(datetime) < 6 AND (hour BETWEEN 7 AND 8 OR hour BETWEEN 17 AND 18) THEN 1 ELSE 0 END AS peak
  FROM e0 JOIN ld USING (d, hour, line) JOIN hd USING (d, hour) JOIN cn USING (station) LEFT JOIN wg USING (line, d) LEFT JOIN nw USING (line, d, stop_id) JOIN wx USING (event_id) LEFT JOIN lm ON lm.hist_group_id = e0.train || '_' || e0.station AND lm.d = e0.d JOIN ql USING (line, d) JOIN qs USING (station, hour, d))
SELECT event_id, round(pos, 5) AS position_dans_trajet, term AS est_gare_terminus, hub_liege AS traverse_hub_liege, jonction_nord_midi AS traverse_jonction_nord_midi, stops AS nb_arrets_total, round(km, 4) AS longueur_trajet_km, round(since, 4) AS temps_theorique_depuis_depart, nb_trains, n_hub_gent AS densite_hub_gent,
  round(cong, 5) AS congestion_prevue_score, cn AS nb_connexions_gare, nb, level, round(far, 4) AS travaux_distance_km, t AS meteo_temperature, ext AS meteo_conditions_extremes, round(r1, 9) AS retard_j_1, round(wk, 9) AS retard_moyen_meme_jour_semaine, round(m7, 10) AS ligne_mean_7, round(m30, 10) AS slot_mean_30,
  round(CAST(CAST(CASE WHEN n = 0 THEN 0.5 ELSE greatest(0.0, greatest(0.0, 1.0 - mu / 10.0) - CASE WHEN n >= 3 THEN least(0.2, sd / 10.0) ELSE 0.0 END) END AS FLOAT) AS DOUBLE), 4) AS fiabilite_train_historique,
  round(CAST(CAST(0.35 * least(1.0, mu / 10.0) + 0.25 * cong + 0.2 * CASE WHEN nb > 0 THEN (level + 1) / 4.0 ELSE 0.0 END + 0.1 * ext + 0.05 * peak AS FLOAT) AS DOUBLE), 4) AS risque_retard_score,
  round(CAST(CAST(0.4 * least(1.0, dens / 50.0) + 0.3 * least(1.0, nb / 3.0) + 0.2 * CASE WHEN ext = 1 THEN 1.0 WHEN rain > 5 THEN 0.5 WHEN wind > 50 THEN 0.5 ELSE 0.0 END + 0.1 * peak AS FLOAT) AS DOUBLE), 4) AS stress_reseau_score,
  round(CAST(CAST((least(1.0, stops / 25.0) + least(1.0, km / 100.0) + least(1.0, ({" + ".join(hubs)}) / 3.0) + least(1.0, cn / 10.0) + (1.0 - abs(0.5 - pos) * 2.0) * 0.5) / 4.5 AS FLOAT) AS DOUBLE), 4) AS indice_complexite,
  round(CASE WHEN delay_s IS NOT NULL THEN least(greatest(delay_s / 60.0, -20.0), 240.0) END, 5) AS target, CASE WHEN CAST(d AS VARCHAR) IN ({", ".join(repr(x) for x in HOLIDAYS)}) THEN 1 ELSE 0 END AS is_jour_ferie FROM z"""


@query(_chain_sql())
def feature_chain(spark, sf):
    """All feature steps in one plan."""
    stations = spark.createDataFrame([(n, str(3 * i)) for i, n in enumerate(A.NAMES)], "station string, weather_station string")
    out = features.build(A.journeys(spark, sf), A.stop_times(spark, sf), A.works(spark, sf), A.observations(spark, sf), stations, "3", cut=written)
    places = dict.fromkeys(("congestion_prevue_score", "position_dans_trajet", "target"), 5) | dict.fromkeys(("longueur_trajet_km", "temps_theorique_depuis_depart", "travaux_distance_km", "fiabilite_train_historique", "risque_retard_score", "stress_reseau_score", "indice_complexite"), 4)
    places |= dict.fromkeys(("retard_j_1", "retard_moyen_meme_jour_semaine"), 9) | dict.fromkeys(("ligne_mean_7", "slot_mean_30"), 10)
    return out.select("event_id", *[r(F.col(c).cast("double"), places[c]).alias(c) if c in places else c for c in _CHAIN])


# --- names and stops ---------------------------------------------------------------------------------------------


@query(f"WITH {A.STATION_NAMES} SELECT name, round(lat, 4) AS lat, round(lon, 4) AS lon FROM sc")
def station_names_union(spark, sf):
    _, stations = A.timetable(spark, sf)
    table = rows.coordinates_by_name(stations, ["fr", "nl", "symbolic"], text.station_form_1)
    return table.select("name", r("lat", 4).alias("lat"), r("lon", 4).alias("lon"))


@query(f"""WITH {A.STATION_NAMES}, sp AS (SELECT s_suppkey AS stop_id, 'GARE ' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN 'X' ELSE '' END AS stop_name, 50.0 + s_suppkey / 1000.0 AS la, 4.0 + s_suppkey / 1000.0 AS lo FROM supplier)
SELECT l_orderkey, l_linenumber, l_suppkey AS stop_id, stop_name, round(coalesce(lat, la), 4) AS stop_lat, round(coalesce(lon, lo), 4) AS stop_lon FROM lineitem LEFT JOIN sp ON sp.stop_id = l_suppkey LEFT JOIN sc ON sc.name = sp.stop_name""")
def stops_located(spark, sf):
    where, stations = A.timetable(spark, sf)
    located = stops.located(where, rows.coordinates_by_name(stations, ["fr", "nl", "symbolic"], text.station_form_1))
    times = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("stop_id"))
    return stops.at_stops(times, located).select("l_orderkey", "l_linenumber", "stop_id", "stop_name", r("stop_lat", 4).alias("stop_lat"), r("stop_lon", 4).alias("stop_lon"))


_PATCHED = ["Charleroi-Sud", "Baulers", "Hasselt-Aflos L.35", "Gare 3", "Montzen-N", "Nowhere"]


@query(f"""SELECT o_orderkey AS k, CASE n WHEN 0 THEN 50.4122 WHEN 1 THEN 50.6074 WHEN 2 THEN 50.9304 WHEN 3 THEN 49.8 WHEN 4 THEN 50.7067 END AS lat, CASE n WHEN 0 THEN 4.4376 WHEN 1 THEN 4.3499 WHEN 2 THEN 5.3378 WHEN 3 THEN 3.3 WHEN 4 THEN 5.9283 END AS lon FROM (SELECT o_orderkey, o_orderkey % {len(_PATCHED)} AS n FROM orders)""")
def coordinate_patch(spark, sf):
    _, stations = A.timetable(spark, sf)
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.get(F.array(*map(F.lit, _PATCHED)), (F.col("o_orderkey") % len(_PATCHED)).cast("int")).alias("station"))
    named = stations.select(text.station_form_2(F.col("fr")).alias("name"), "lat", "lon")
    return stops.patch_coordinates(o, named).select("k", r("lat", 4).alias("lat"), r("lon", 4).alias("lon"))


@query("""SELECT o_orderkey AS k, list_extract(['CHARLEROI-CENTRAL', 'VORST-OOST', 'BRUGGE', 'NIVELLES', 'LIEGE'], CAST(o_orderkey % 5 AS INTEGER) + 1) AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 50.0 + o_orderkey % 100 / 100.0 END AS lat, list_distinct([x FOR x IN ['A' || o_custkey % 3, CASE WHEN o_orderkey % 2 = 0 THEN 'B' END, 'A' || o_orderkey % 3] IF x IS NOT NULL]) IS NOT NULL AS has_ids,
  CAST(CASE WHEN o_custkey % 3 = o_orderkey % 3 THEN 1 ELSE 2 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS ids FROM orders""")
def names_and_identifiers(spark, sf):
    k = F.col("o_orderkey")
    raw = F.get(F.array(*map(F.lit, ["Charleroi-Sud", "forest-est", " brugge ", "BAULERS", "Liège"])), (k % 5).cast("int"))
    pair = F.when(k % 4 == 0, "x, 4.0").otherwise(F.concat((F.lit(50) + k % 100 / 100.0).cast("decimal(8,2)").cast("string"), F.lit(", 4.0")))
    ids = text.identifiers(F.concat(F.lit(" A"), (F.col("o_custkey") % 3).cast("string")), F.when(k % 2 == 0, "B ").otherwise(" "), F.concat(F.lit("A"), (k % 3).cast("string")))
    return A.table(spark, sf, "orders").select(k.alias("k"), text.corrected_name(raw).alias("name"), text.pair_part(pair, 0).alias("lat"), ids.isNotNull().alias("has_ids"), F.size(ids).alias("ids"))


@query("""SELECT o_orderkey AS k, strftime(CAST(o_orderdate AS DATE) - 1, '%Y-%m-%d') AS before, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds(o_orderkey % 24 * 3600 + o_orderkey % 60 * 60) END AS planned,
  CASE o_orderkey % 4 WHEN 0 THEN TIMESTAMP '2024-01-05 06:30:00' WHEN 1 THEN TIMESTAMP '2024-07-05 05:00:00' WHEN 2 THEN TIMESTAMP '2024-01-05 04:15:00' END AS instant FROM orders""")
def planned_times_and_instants(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    clock = F.concat(two(24), F.lit(":"), two(60), F.lit(":00"))
    shown = F.get(F.array(*map(F.lit, ["2024-01-05 07:30", "20240705 07", "2024-01-05T05:15:00+01:00", "soon"])), (k % 4).cast("int"))
    planned = dates.planned_time(day, F.when(k % 5 == 0, "25:00:00").when(k % 5 == 1, clock).otherwise(""), F.when(k % 5 > 1, clock))
    return A.table(spark, sf, "orders").select(k.alias("k"), dates.day_before(day).alias("before"), planned.alias("planned"), dates.parsed_instant(shown).alias("instant"))


# --- preparation of series ---------------------------------------------------------------------------------------


@query(f"WITH {A.TEXTED} SELECT group_id, time_idx, round(CAST(target AS DOUBLE), 2) AS target, x, kind_idx FROM cl")
def series_clean(spark, sf):
    t = A.texted_series(spark, sf)
    lists = rows.feature_lists(t.columns, ("group_id", "time_idx", "target"), ("event_id",))
    out = ser.clean(t, "group_id", "time_idx", "target", lists["real"], lists["categorical"], F.col("event_id"))
    return out.withColumn("target", r(F.col("target").cast("double"), 2))


@query(f"WITH {A.TEXTED}, ids AS (SELECT group_id, CAST(row_number() OVER (ORDER BY group_id) - 1 AS INTEGER) AS unique_id FROM (SELECT DISTINCT group_id FROM cl WHERE time_idx <= 19730)) SELECT unique_id, time_idx AS ds, round(CAST(target AS DOUBLE), 2) AS y FROM cl JOIN ids USING (group_id) WHERE time_idx > 19730")
def series_ids_join(spark, sf):
    c = ser.clean(A.texted_series(spark, sf), "group_id", "time_idx", "target", ["x"], ["kind_idx"], F.col("event_id"))
    ids = ser.series_ids(c.where("time_idx <= 19730"), "group_id")
    return ser.with_ids(c.where("time_idx > 19730"), ids, "group_id", "time_idx", "target").select("unique_id", "ds", r(F.col("y").cast("double"), 2).alias("y"))


@query(f"WITH {A.SERIES} SELECT group_id, time_idx, round(CASE WHEN time_idx >= 19733 THEN target + 1 ELSE target END, 6) AS target FROM sr")
def context_union(spark, sf):
    s = A.series(spark, sf)
    first, second = s.where("time_idx <= 19736"), s.where("time_idx >= 19733").withColumn("target", F.col("target") + 1)
    return rows.keep_last([first, second], ["group_id", "time_idx"]).withColumn("target", r("target"))


@query(f"""WITH {_EVAL}, m AS (SELECT avg(abs(pred - y)) AS mae, avg(abs(naive - y)) AS nm, count(*) AS n FROM j) SELECT n > 0 AS has_rows, mae >= 0.99 * nm AS bad, CASE WHEN mae >= 0.99 * nm THEN 'val_not_better_than_naive,test_after_val_not_better_than_naive' ELSE '' END AS reasons FROM m""")
def quality_decision(spark, sf):
    m = ser.metrics(_evaluated(spark, sf)).first().asDict()
    bad, why = ser.quality_decision(m, m)
    return spark.createDataFrame([(m["n"] > 0, bad, ",".join(why))], "has_rows boolean, bad boolean, reasons string")


@query(f"""WITH {A.SERIES}, x AS (SELECT *, lag(target) OVER (PARTITION BY group_id ORDER BY time_idx) AS j FROM sr), s AS (SELECT avg(j) AS a, avg(target * 60) AS t FROM x WHERE j IS NOT NULL) SELECT group_id, time_idx, round(j * CASE WHEN t > 20 * a THEN 60.0 ELSE 1.0 END, 6) AS naive FROM x, s WHERE j IS NOT NULL""")
def naive_baseline(spark, sf):
    """The scaled lag back in its own unit, times 60 as the target is in seconds."""
    w = Window.partitionBy("group_id").orderBy("time_idx")
    x = A.series(spark, sf).withColumn("retard_j_1", F.lag("target").over(w)).where("retard_j_1 is not null").withColumn("target", F.col("target") * 60)
    by = ser.scaler(x, ["retard_j_1"])
    scale = ridge.naive_scale(x.agg(F.avg("target")).first()[0], by["retard_j_1"][0])
    return ser.scale(x, by).select("group_id", "time_idx", r(ridge.naive("retard_j_1", by, scale), 6).alias("naive"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE round(value, 4) END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 4) END AS target FROM events WHERE event_id % 7 <> 0")
def fill_continuous(spark, sf):
    k, v = F.col("event_id"), F.round("value", 4)
    e = A.table(spark, sf, "events").select(k, F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(v).alias("a"), F.when(k % 5 != 0, v).alias("target"), F.when(k % 7 != 0, v).alias("label"))
    return rows.fill_continuous(rows.drop_and_fill(e, "label", ["event_id", "a"]).join(e.select("event_id", "target"), "event_id"), skip=("target",)).select("event_id", "a", "target")


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 500")
def tail_rows(spark, sf):
    return readers.tail(A.table(spark, sf, "events").select("event_id", "user_id"), "event_id", 500)


@query("SELECT event_type AS feature, round(sum(value), 2) AS gain FROM events GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 3")
def top_features(spark, sf):
    gains = A.table(spark, sf, "events").groupBy(F.col("event_type").alias("feature")).agg(F.sum("value").alias("gain"))
    return rows.top_features(gains, 3).withColumn("gain", r("gain", 2))


@query()
def boosted_trees(spark, sf):
    """Boosted trees on lags of the series; the built-in ones, so no parity with other libraries."""
    s = A.series(spark, sf)
    w = Window.partitionBy("group_id").orderBy("time_idx")
    x = s.select("group_id", "time_idx", "target", *[F.lag("target", i).over(w).alias(f"x{i}") for i in (1, 2, 3)]).dropna()
    model = boosting.fit(x.where("time_idx <= 19730"), ["x1", "x2", "x3"], "target", trees=5)
    return boosting.predict(model, x.where("time_idx > 19730")).select("group_id", "time_idx", "target", "pred")


# --- files -------------------------------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    """Written as CSV in order, read back as text with the delimiter found."""
    path = scratch(spark, "csv")
    writers.csv(A.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, [F.col("c_custkey")])
    return readers.csv(spark, path)


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def parquet_round_trip(spark, sf):
    """Written as zstd Parquet by priority in bounded files, read back from the first path that exists."""
    path = scratch(spark, "parquet")
    writers.parquet(A.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), path, rows_per_file=5000, partition_by=("o_orderpriority",))
    return readers.parquet(spark, f"{path}-none", path).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("""SELECT 'st' || (user_id % 30) AS station, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, round(value, 1) AS temperature, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 9 AS DOUBLE) END AS nebulosite, event_id AS precipitations
FROM events WHERE event_id % 23 <> 0 AND event_id % 29 <> 0""")
def observations_from_text(spark, sf):
    """Semicolon text with decimal commas; rows without a station or a readable time are skipped."""
    k, path = F.col("event_id"), scratch(spark, "synop")
    cells = {
        "code": F.when(k % 23 != 0, F.concat(F.lit("st"), (F.col("user_id") % 30).cast("string"))), "timestamp": F.when(k % 29 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise("soon"),
        "temp": F.replace(F.round("value", 1).cast("decimal(12,1)").cast("string"), F.lit("."), F.lit(",")), "cloudiness": F.when(k % 4 != 0, (k % 9).cast("string")).otherwise("n/a"), "precip": k.cast("string"),
    }
    A.table(spark, sf, "events").select(*[c.alias(n) for n, c in cells.items()]).write.options(header=True, sep=";").csv(path)
    out = readers.synop(readers.csv(spark, path))
    return out.select("station", "date", "hour", "temperature", "nebulosite", F.col("precipitations").cast("long").alias("precipitations"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def json_object_round_trip(spark, sf):
    """A small table as one JSON object by key, and its entries as rows again."""
    nation = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    path = scratch(spark, "json")
    body = nation.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), F.struct("name", "region"))))).alias("value"))
    body.write.text(path)
    return readers.json_map(spark, path, "struct<name: string, region: bigint>", "id").select("id", "value.name", "value.region")


@query("""SELECT c.c_custkey AS k, CASE WHEN s.s_suppkey IS NOT NULL AND s.s_suppkey % 2 = 0 THEN s.s_acctbal ELSE c.c_acctbal END AS v FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def last_write_wins(spark, sf):
    """Files in order, the later one wins."""
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    s = A.table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    known = s.join(c.select("k"), "k", "left_semi")
    return readers.last_write_wins([c, known], ["k"])
