"""The feature chain as one lazy plan: temporal, calendar, trips, density, works, weather, history, scores.

Steps are DataFrame -> DataFrame, so Catalyst prunes and orders the whole chain. Aggregates that rows look up (history,
connections) are fed from the rows as they come and not from the widened ones, so a branch reads the columns it needs
and no more. Where trips have been matched, three branches start from the widened rows; ``build`` takes a function that
cuts the plan there (such as ``session.written``, a table in the shared folder), so that the match is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CONGESTION
from ..functions import dates, text
from ..operators import density, history, scores, trips, weather, works

HUBS = list(CONGESTION)


def base(df: DataFrame) -> DataFrame:
    """Keys and parts of time of (train, station, line, datetime, delay_s); rows without a time go. The target is the delay
    in minutes within -20 and 240; null where the delay is."""
    t = F.col("datetime")
    out = df.where(t.isNotNull()).withColumns(
        {"date": t.cast("date"), "d": t.cast("date"), "hour": F.hour(t), "delay_min": history.delay_minutes(F.col("delay_s")), "fest_weekend": dates.is_weekend(t), "is_heure_pointe": dates.is_peak(t), "periode_journee": dates.day_period(t)}
    )
    keys = {"group_id": text.group_id(F.col("train"), F.col("station")), "hist_group_id": text.strict_group_id(F.col("train"), F.col("station"))}
    return dates.temporal_features(out).withColumns(keys | {"target": history.target_minutes(F.col("delay_s"))})


def with_calendar(df: DataFrame) -> DataFrame:
    cal = dates.calendar(df.sparkSession).withColumnRenamed("date_key", "date")
    return df.join(F.broadcast(cal), "date", "left").fillna(0, ["is_jour_ferie", "is_vacances_scolaires"])


def stop_features(stop_times: DataFrame) -> DataFrame:
    """Features of each stop of each sub-trip: its place, hubs ahead, times, and length and stops of the trip."""
    stops = trips.segments(trips.stop_flags(trips.sessions(stop_times)))
    placed = trips.theoretical_minutes(trips.position_and_hubs(stops))
    summary = trips.trip_summary(stops)
    straight = trips.haversine(*map(F.col, ("first_lat", "first_lon", "last_lat", "last_lon")))
    whole = summary.select("real_trip_id", F.col("nb_stops").alias("nb_arrets_total"), trips.sane_distance(F.col("path_km"), straight, F.col("end_s") - F.col("start_s")).alias("longueur_trajet_km"))
    return placed.join(whole, "real_trip_id")


TRIP = ["position_dans_trajet", "est_gare_terminus", *[f"traverse_{k}" for k in HUBS], "est_hub_majeur", "temps_theorique_depuis_depart", "temps_theorique_jusque_arrivee", "nb_arrets_total", "longueur_trajet_km"]


def with_trips(df: DataFrame, stops: DataFrame) -> DataFrame:
    """The stop (of ``stop_features``) of the row's train at its station that is nearest in time, with the features of its
    trip; 0 without one."""
    candidates = stops.select(F.col("trip_id").alias("train"), F.col("stop_name").alias("station"), "real_trip_id", "stop_sequence", (F.col("departure_s") % 86400).alias("candidate_s"))
    t = F.col("datetime")
    rows = df.withColumn("row_s", F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))
    met = trips.best_match(rows, candidates, ["train", "station"]).drop("row_s", "sched_diff")
    found = stops.select("real_trip_id", "stop_sequence", "stop_id", "lat", "lon", *TRIP)
    return met.join(found, ["real_trip_id", "stop_sequence"], "left").fillna(0, TRIP)


def with_density(df: DataFrame) -> DataFrame:
    """JOI-11: distinct trains of the hour on the line and through each hub, and the congestion that follows."""
    out = df.join(density.line_density(df), ["date", "hour", "line"], "left")
    hubs = density.hub_density(df, {k: F.col(f"traverse_{k}") == 1 for k in HUBS})
    out = out.join(hubs, ["date", "hour"], "left")
    return out.withColumn("congestion_prevue_score", density.congestion({k: F.col(f"densite_{k}") for k in HUBS}))


def with_connections(df: DataFrame, rows: DataFrame, external: DataFrame | None = None) -> DataFrame:
    return df.join(trips.connections(rows, "station", "line", external).withColumnRenamed("nb_connexions", "nb_connexions_gare"), "station", "left").fillna(0, ["nb_connexions_gare"])


def with_history(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Lags and rolling means of ``rows`` (base) on the widened rows."""
    out = df.join(history.lag_features(history.lags(rows)), ["hist_group_id", "d"], "left")
    for keys, tag in ((["line"], "ligne"), (["station"], "gare"), (["station", "hour"], "slot")):
        stats = history.rolling(rows, keys)
        out = out.join(stats.select(*keys, "d", *[F.col(c).alias(f"{tag}_{c}") for c in ("mean_7", "std_7", "ok_7", "mean_30")]), [*keys, "d"], "left")
    return out.fillna(0.0, [c for c in out.columns if c.split("_")[0] in ("ligne", "gare", "slot")])


def with_works(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Works of the row's line that day, and the nearest one to its stop."""
    days = works.daily(sites)
    near = works.nearest_site(df.where("stop_id is not null"), days).withColumnRenamed("km", "travaux_distance_km")
    return works.impact_features(df, days).join(near, ["line", "date", "stop_id"], "left")


def with_weather(df: DataFrame, observed: DataFrame, stations: DataFrame, default: str) -> DataFrame:
    """``stations``: (station, weather_station)."""
    names = list(weather.WEATHER_DEFAULTS)
    mapped = df.join(stations, "station", "left").withColumnsRenamed({"station": "stop_station", "weather_station": "station"})
    return weather.weather_features(mapped, weather.expand_hours(observed, names), default).withColumnsRenamed({"station": "weather_station", "stop_station": "station"})


def with_scores(df: DataFrame) -> DataFrame:
    out = scores.lag_moments(df)
    traffic = ["densite_jonction_nord_midi", "densite_hub_bruxelles_midi", "densite_hub_schaerbeek", "nb_trains"]
    mean = sum([F.coalesce(F.col(c), F.lit(0)) for c in traffic[1:]], F.coalesce(F.col(traffic[0]), F.lit(0))) / len(traffic)
    hubs = sum([F.col(f"traverse_{k}") for k in HUBS[1:]], F.col(f"traverse_{HUBS[0]}"))
    extreme, peak = F.col("meteo_conditions_extremes"), F.col("is_heure_pointe")
    found = {
        "fiabilite_train_historique": scores.reliability(),
        "risque_retard_score": scores.risk(F.col("_m"), F.coalesce("congestion_prevue_score", F.lit(0.0)), F.col("active"), F.col("level"), extreme, peak),
        "stress_reseau_score": scores.stress(mean, F.col("nb"), extreme, F.col("meteo_precipitations"), F.col("meteo_vent_vitesse"), peak),
        "indice_complexite": scores.complexity(F.col("nb_arrets_total"), F.col("longueur_trajet_km"), hubs, F.col("nb_connexions_gare"), F.col("position_dans_trajet")),
    }
    return out.withColumns({k: v.cast("float") for k, v in found.items()}).drop("_n", "_m", "_sd")


def build(punctuality: DataFrame, stop_times: DataFrame, sites: DataFrame, observed: DataFrame, stations: DataFrame, default: str, connections: DataFrame | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    rows = base(punctuality)
    met = cut(rows.transform(with_calendar).transform(with_trips, cut(stop_features(stop_times))))
    return (
        met.transform(with_density).transform(with_connections, rows, connections)
        .transform(with_works, sites).transform(with_weather, observed, stations, default).transform(with_history, rows).transform(with_scores)
    )
