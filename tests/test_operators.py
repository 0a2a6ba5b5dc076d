"""Operators against literal results, slow restatements and invariants."""

import json
import random
from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from perron.constants import ALL_TIERS, OWN_TIERS
from perron.operators import history, ridge, rows, series, trips, weather, works
from perron.sources import readers, writers
from perron.streaming import enrich


def test_sessions_split_only_above_the_gap(spark):
    df = spark.createDataFrame([("t", i, s) for i, s in enumerate([0, 3600, 10800, 18001])], "trip_id string, stop_sequence int, departure_s int")
    assert [r.sub_trip_idx for r in trips.sessions(df).orderBy("stop_sequence").collect()] == [0, 0, 0, 1]


def test_best_match_null_rules(spark):
    row = spark.createDataFrame([(1, 5, 86340), (2, 6, 86340), (3, 7, 1)], "k int, stop int, row_s int")
    c = spark.createDataFrame([(5, "a", 1, 60), (5, "b", 1, 85000), (6, "c", 1, None), (6, "d", 1, 85000)], "stop int, real_trip_id string, stop_sequence int, candidate_s int")
    pick = lambda strict: {r.k: r.real_trip_id for r in trips.best_match(row, c, ["stop"], strict=strict).collect()}
    assert pick(False) == {1: "a", 2: "d", 3: None}
    assert pick(True) == {1: "a", 2: "c", 3: None}


def test_works_days(spark):
    df = spark.createDataFrame([("l", date(2024, 1, 1), date(2024, 1, 3), "total", 1.0, 1.0), ("l", date(2024, 1, 3), date(2024, 1, 1), "", 1.0, 1.0)], "line string, start date, end date, impact string, lat double, lon double")
    assert works.daily(df).count() == 3


def test_weather_hours_wrap_on_their_date(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1), 23, 5.0)], "station string, date date, hour int, temperature double")
    got = weather.expand_hours(df, ["temperature"]).collect()
    assert {r.hour for r in got} == {20, 21, 22, 23, 0, 1, 2} and {r.date for r in got} == {date(2024, 1, 1)}


def test_weather_falls_back_as_a_whole(spark):
    cols = "station string, date date, hour int, temperature double, precipitations double, vent_vitesse double, vent_pointe double, humidite double, nebulosite double"
    d = date(2024, 1, 2)
    hourly = spark.createDataFrame([("own", d, 5, 5.0, 1.0, 1.0, 1.0, 1.0, None), ("def", d, 5, 9.0, 2.0, 2.0, 26.0, 2.0, 3.0)], cols)
    q = spark.createDataFrame([("own", d, 5), ("own", d, 6)], "station string, date date, hour int")
    got = {r.hour: r for r in weather.weather_features(q, hourly, default="def").collect()}
    assert (got[5].meteo_temperature, got[5].meteo_nebulosite, got[5].meteo_conditions_extremes) == (9.0, 3.0, 1)
    assert (got[6].meteo_temperature, got[6].meteo_precipitations, got[6].meteo_observee_j_1) == (10.0, 0.0, 10.0)


def slow_lookup(data, order, station, h):
    """The rules one station and one hour at a time."""
    have = data.get(station, set())
    if h in have:
        return 0, station
    for t in OWN_TIERS:
        for d in (-t, t):
            if h + d in have:
                return d, station
    for d in range(1, 721):
        for s in (d, -d):
            if h + s in have:
                return s, station
    best = None
    for other in order:
        have = data.get(other, set())
        found = 0 if h in have else next((d for t in ALL_TIERS for d in (-t, t) if h + d in have), None)
        if found is None and best is None:
            found = next((s for d in range(169, 721) for s in (d, -d) if h + s in have), None)
        if found is not None and (best is None or abs(found) < abs(best[0])):
            best = (found, other)
    return best or (None, None)


def test_weather_grid_follows_the_rules(spark):
    rng = random.Random(4)
    order = ["A", "B", "C", "D"]
    data = {"A": {1500}, "B": set(rng.sample(range(0, 2600), 4)), "C": set(), "D": set(rng.sample(range(900, 2600), 60))}
    observed = spark.createDataFrame([(s, h) for s, hs in data.items() for h in hs], "station string, h int")
    stations = spark.createDataFrame([(s, i) for i, s in enumerate(order)], "station string, ordinal int")
    got = {(r.station, r.h): (r.offset, r.source) for r in weather.resolve_grid(observed, stations, 0, 2600).collect()}
    assert len(got) == 5 * 2601  # a row without a station as well
    for s in [*order, None]:
        for h in range(0, 2601, 7):
            assert got[s, h] == slow_lookup(data, order, s, h), (s, h)


def test_history_null_rules(spark):
    t = date(2024, 1, 1)
    df = spark.createDataFrame([("k", t, 2.0), ("k", t, None)], "hist_group_id string, d date, delay_min double")
    assert history.daily_stats(df, ["hist_group_id"]).first().day_mean == 1.0
    later = df.unionByName(spark.createDataFrame([("k", date(2024, 1, 8), 9.0)], df.schema))
    got = {str(r.d): r for r in history.lag_features(history.lags(later)).collect()}
    assert got["2024-01-08"].retard_j_7 == 2.0 and got["2024-01-08"].retard_moyen_meme_jour_semaine == 2.0
    assert (got["2024-01-01"].lag_missing_semaine, got["2024-01-01"].retard_j_1) == (1, 0.0)


def test_rolling_is_closed_left(spark):
    df = spark.createDataFrame([("l", date(2024, 1, d), x) for d, x in ((1, 1.0), (3, 3.0), (8, 8.0), (9, None))], "line string, d date, delay_min double")
    assert [r.mean_7 for r in history.rolling(df, ["line"]).orderBy("d").collect()] == [None, 1.0, 2.0, 5.5]


def test_no_leakage(spark):
    """Delays from a day on do not change what history says about that day or earlier ones."""
    rng = random.Random(2)
    base = [("k%d" % (i % 5), date(2024, 1, 1 + i % 20), rng.random() * 30) for i in range(300)]
    changed = [(k, d, x + 1000 if d >= date(2024, 1, 12) else x) for k, d, x in base]

    def features(data):
        df = spark.createDataFrame(data, "hist_group_id string, d date, delay_min double")
        both = history.lags(df).join(history.rolling(df, ["hist_group_id"]), ["hist_group_id", "d"]).where("d <= date'2024-01-12'")
        return sorted(map(str, both.collect()))

    assert features(base) == features(changed)


def test_row_operators(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert [(r.k, r.v) for r in rows.keep_one(df, ["k"], [F.desc("o")]).orderBy("k").collect()] == [("a", "y"), ("b", None)]
    assert {r.k: r.v for r in rows.last_values(df, "k", "o", ["v"]).collect()} == {"a": "y", "b": None}
    codes = rows.label_codes(df, "v")
    assert {r.v: r.v_idx for r in rows.encode_labels(df, "v", codes).collect()} == {"x": 0.0, "y": 1.0, None: 0.0}
    assert rows.select_existing(df, ["v", "zz", "k"], always=("k",), exclude=("v",)).columns == ["k"]
    assert rows.split_by_prefix(["meteo_observee_j_1", "meteo_temp", "est_x", "zz"], ("est_",), ("meteo_observee_",), ("meteo_",)) == {"static": ["est_x"], "hist": ["meteo_observee_j_1", "zz"], "future": ["meteo_temp"]}
    assert series.scaler(spark.createDataFrame([(3.0,), (3.0,)], "x double"), ["x"]) == {"x": (3.0, 1.0)}
    counts = spark.createDataFrame([(k, i) for k, n in (("a", 100), ("b", 86), ("c", 85)) for i in range(n)], "g string, i int")
    assert series.window_counts(counts, "g", 86).agg(F.sum("windows")).first()[0] == 16


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 3))
    x -= x.mean(axis=0)
    y = x @ [1.0, -2.0, 0.5] + 7 + rng.standard_normal(500) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double").repartition(4)
    m = ridge.fit(df, ["a", "b", "c"], "y", alphas=[2.0])
    assert np.allclose(m.weights, np.linalg.solve(x.T @ x + 2 * np.eye(3), x.T @ (y - y.mean()))) and abs(m.intercept - y.mean()) < 1e-9
    assert len(ridge.degree_two([str(i) for i in range(15)])) == 120


def test_readers_and_writers(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("\n code ; timestamp;temp\n s1;2024-01-01T05:00;4,5\n ;2024-01-01T05:00;1\n s2;oops;1\n")
    b.write_text("a;b,c\n1;2,3\n")
    assert readers.delimiter(spark, str(a)) == ";" and readers.delimiter(spark, str(b)) == ","
    (tmp_path / "c.csv").write_text("code;timestamp;temp\n s1 ;2024-01-01T05:00;4,5\n ;2024-01-01T05:00;1\ns2;oops;1\n")
    got = readers.synop(readers.csv(spark, str(tmp_path / "c.csv"))).collect()
    assert [(r.station, r.hour, r.temperature) for r in got] == [("s1", 5, 4.5)]
    one, two = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "z")], "k int, v string")
    assert {r.k: r.v for r in readers.last_write_wins([one, two], ["k"]).collect()} == {1: "z", 2: "y"}
    writers.json_object(one, str(tmp_path / "m.json"), "k")
    assert json.loads((tmp_path / "m.json").read_text()) == {"1": {"v": "x"}, "2": {"v": "y"}}
    assert {r.key: r.value.v for r in readers.json_map(spark, str(tmp_path / "m.json"), "struct<v: string>").collect()} == {"1": "x", "2": "y"}
    assert readers.json_map(spark, str(tmp_path / "none.json"), "struct<v: string>").count() == 0
    writers.parquet(one, str(tmp_path / "p"), rows_per_file=1, partition_by=("k",))
    assert readers.parquet(spark, str(tmp_path / "missing"), str(tmp_path / "p")).count() == 2
    assert readers.missing(spark, str(tmp_path / "p"), ["v", "w"]) == ["w"]
    assert readers.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_streaming_enrichment_equals_batch(spark, tmp_path):
    data = [(datetime(2024, 1, 1, h), "s%d" % (h % 3), float(h)) for h in range(24)]
    batch = spark.createDataFrame(data, "ts timestamp, station string, delay double")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    grid = spark.createDataFrame([("s0", 1), ("s1", 2)], "station string, offset int")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = enrich.enrich_stream(stream, grid, ["station"]).writeStream.format("memory").queryName("enriched").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("enriched").collect())) == sorted(map(str, enrich.enrich_stream(batch, grid, ["station"]).collect()))
    q = enrich.running_moments(stream, "station", "delay").writeStream.outputMode("complete").format("memory").queryName("moments").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("moments").collect())) == sorted(map(str, enrich.running_moments(batch, "station", "delay").collect()))
