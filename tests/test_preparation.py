"""Enrichment, stops, series and evaluation against literal results and slow restatements."""

import random
import time
from datetime import date, datetime

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from perron.functions import dates
from perron.operators import boosting, enrich, ridge, rows, scores, series, stops, trips, weather
from perron.sources import readers, writers
from perron.streaming import enrich as streaming


def slow_best(row, candidates, strict):
    def order(c):
        gap = None if row[2] is None or c[3] is None else min(abs(row[2] - c[3]), abs(86400 - abs(row[2] - c[3])))
        null = (gap is not None) if strict else (gap is None)
        return (null, gap or 0, c[1] is None, c[1] or "", c[2] is None, c[2] or 0), gap

    mine = [c for c in candidates if c[0] == row[1] and row[1] is not None]
    if not mine:
        return None, None, None
    best = min(mine, key=lambda c: order(c)[0])
    return best[1], best[2], order(best)[1]


@pytest.mark.parametrize("strict", [False, True])
def test_best_match_equals_all_pairs(spark, strict):
    rng = random.Random(3)
    second = lambda: rng.choice([0, 1, 43199, 43200, 43201, 86399, *[rng.randrange(86400) for _ in range(20)]])
    data = [(k, rng.choice([None, *range(12)]), rng.choice([None, *[second() for _ in range(9)]])) for k in range(300)]
    near = [(rng.choice([None, *range(10)]), rng.choice([None, "a", "b", "c"]), rng.choice([None, 1, 2]), rng.choice([None, *[second() for _ in range(11)]])) for _ in range(150)]
    r = spark.createDataFrame(data, "k int, stop int, row_s int")
    c = spark.createDataFrame(near, "stop int, real_trip_id string, stop_sequence int, candidate_s int")
    got = {x.k: (x.real_trip_id, x.stop_sequence, x.sched_diff) for x in trips.best_match(r, c, ["stop"], strict=strict).collect()}
    assert got == {row[0]: slow_best(row, near, strict) for row in data}


def test_nearest_station_in_slices(spark):
    rng = random.Random(1)
    places = spark.createDataFrame([(str(i), 49 + rng.random() * 3, 2 + rng.random() * 4) for i in range(40)], "place_id string, lat double, lon double")
    stations = spark.createDataFrame([(i, f"s{i}", 49 + rng.random() * 3, 2 + rng.random() * 4) for i in range(90)] + [(90, "twin", 50.0, 4.0), (91, "later twin", 50.0, 4.0)], "ordinal int, station_id string, s_lat double, s_lon double")
    one, many = (sorted(map(tuple, weather.nearest_station(places, stations, slice_size=n).collect())) for n in (1000, 7))
    assert one == many and len(one) == 40 and not any(r[1] == "later twin" for r in one)
    assert weather.nearest_station(places, stations.limit(0)).collect() == []


def all_pairs_km(lat, lon, s_lat, s_lon):
    lat, lon, s_lat, s_lon = (np.radians(x) for x in (lat[:, None], lon[:, None], s_lat[None], s_lon[None]))
    c = np.sin((s_lat - lat) / 2) ** 2 + np.cos(lat) * np.cos(s_lat) * np.sin((s_lon - lon) / 2) ** 2
    return 2 * 6371.0 * np.arctan2(np.sqrt(c), np.sqrt(np.maximum(1 - c, 0)))


def test_nearest_station_of_many(spark):
    """There are 800 million pairs: time follows places and stations, not their product."""
    k = F.col("id")
    places = spark.range(40_000).select(k.alias("place_id"), (k * 0.618034 % 1 * 160 - 80).alias("lat"), (k * 0.414214 % 1 * 360 - 180).alias("lon"))
    stations = spark.range(20_000).select(k.alias("ordinal"), k.cast("string").alias("station_id"), (k * 0.732051 % 1 * 160 - 80).alias("s_lat"), (k * 0.236068 % 1 * 360 - 180).alias("s_lon"))
    began = time.time()
    got = {r.place_id: r for r in weather.nearest_station(places, stations).collect()}
    assert time.time() - began < 60 and len(got) == 40_000
    some, there = (np.array([r[-2:] for r in df.collect()]) for df in (places.where("place_id % 100 = 0"), stations))
    km = all_pairs_km(*some.T, *there.T)
    assert [got[i * 100].station_id for i in range(400)] == [str(j) for j in km.argmin(axis=1)]
    assert np.allclose([got[i * 100].distance_km for i in range(400)], km.min(axis=1), atol=6e-4)


def test_nearest_station_with_unknown_coordinates(spark):
    nan, inf = float("nan"), float("inf")
    places = spark.createDataFrame([(1, 50.0, 4.0), (2, None, 4.0), (3, nan, 4.0), (4, 50.0, inf), (5, 50.0, 4.0), (5, 50.0, 4.0)], "place_id int, lat double, lon double")
    stations = spark.createDataFrame([(0, "a", None, 4.0), (1, "b", nan, 4.0), (2, "c", 50.0, -inf), (3, "d", 51.0, 4.0), (4, "e", 50.0, 364.1)], "ordinal int, station_id string, s_lat double, s_lon double")
    for n in (1000, 1):
        got = sorted(map(tuple, weather.nearest_station(places, stations, slice_size=n, place_slice=n).collect()))
        assert got == [(1, "e", 7.147, False), (2, None, None, None), (3, None, None, None), (4, None, None, None), (5, "e", 7.147, False)]
    none = weather.nearest_station(places, stations.where("ordinal < 3")).collect()
    assert sorted(map(tuple, none)) == [(i, None, None, None) for i in range(1, 6)]


@pytest.mark.parametrize("n", [1, 16, 17, 700])
def test_tree_finds_what_all_pairs_find(n):
    from perron.operators import kdtree

    rng = np.random.default_rng(n)
    even = lambda k: (rng.uniform(-90, 90, k), rng.uniform(-180, 180, k))
    grid = lambda k: (rng.integers(-9, 10, k) * 10.0, rng.integers(-40, 41, k) * 10.0)
    town = lambda k: (rng.uniform(50, 50.01, k), rng.uniform(4, 4.01, k))
    odd = lambda k: (rng.uniform(-90, 90, k), np.where(rng.random(k) < 0.1, 1e12, rng.uniform(-1e5, 1e5, k)))
    for of in (even, grid, town, odd):
        for places in (even(200), grid(200)):
            stations = of(n)
            km = all_pairs_km(*places, *stations)
            want = set(zip(*(x.tolist() for x in np.nonzero(km == km.min(axis=1)[:, None]))))
            found = kdtree.Tree(*stations).nearest(*places)
            assert want <= set(zip(*(x.tolist() for x in found)))
            assert of is grid or len(found[0]) < 1.1 * len(want) + 10


def test_enrichment_of_one_row(spark):
    row = {"PTCAR_NO": " 7 ", "gare_arrivee": "9", "DATDEP": "05JAN2024", "REAL_TIME_DEP": "0730", "REAL_DATE_ARR": "2024-01-05", "REAL_TIME_ARR": "09:10", "temp_depart": "old"}
    df = spark.createDataFrame([row, row | {"PTCAR_NO": "", "gare_arrivee": "", "DATDEP": "soon", "REAL_DATE_ARR": ""}])
    h = (datetime(2024, 1, 5) - datetime(1970, 1, 1)).days * 24 + 6
    seen = spark.createDataFrame([("A", h, 1.0, 2.0, 3.0, 4.0, 5.0), ("B", h + 6, 6.0, 7.0, 8.0, 9.0, 10.0)], "station string, h int, temp double, precip double, wind_speed double, humidity double, pressure double")
    stations = spark.createDataFrame([("A", 0), ("B", 1)], "station string, ordinal int")
    mapping = spark.createDataFrame([("7", "A", 1.5, False)], "place_id string, station_id string, distance_km double, no_station boolean")
    out = enrich.enrich(df, mapping, enrich.hour_weather(seen, stations, h - 10, h + 10))
    assert out.columns[-18:] == enrich.OUTPUT and out.columns.count("temp_depart") == 1
    found = {r.gare_arrivee: r for r in out.collect()}
    one = found["9"]  # the place of arrival has no station: of all stations, A is nearest in time
    assert (one.temp_depart, one.pressure_depart, one.depart_weather_offset_hours, one.depart_station_meteo, one.depart_station_distance_km, one.depart_no_station) == (1.0, 5.0, 0, "A", 1.5, False)
    assert (one.temp_arrivee, one.arrival_weather_offset_hours, one.arrival_station_meteo, one.arrival_no_station) == (1.0, -2, None, True)
    none = found[""]
    assert none.temp_depart is None and none.depart_no_station and none.arrival_weather_offset_hours is None
    assert tuple(out.agg(*enrich.enrichment_counters()).first()) == (2, 1, 2, 2)


def test_counters_are_observed_without_a_pass_of_their_own(spark):
    from pyspark.sql import Observation

    o = Observation("counts")
    spark.range(10).observe(o, *rows.counters(odd=F.col("id") % 2 == 1)).write.format("noop").mode("overwrite").save()
    assert o.get == {"rows": 10, "odd": 5}


def test_times_of_text(spark):
    texts = ["2024-01-05", "20240105", "2024-01-05 07", "20240105 0730", "2024-01-05 07:30:20", "2024-01-05T07:30:00Z", "2024-01-05T07:30:00+0200", "2024-07-05 02:00", "5.1.2024", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(dates.parsed_instant(F.col("t"))).collect()]
    at = lambda *a: datetime(2024, *a)
    assert got == [at(1, 4, 23), at(1, 4, 23), at(1, 5, 6), at(1, 5, 6, 30), at(1, 5, 6, 30, 20), at(1, 5, 7, 30), at(1, 5, 5, 30), at(7, 5, 0), None, None]
    days = spark.createDataFrame([("01JAN2022",), ("20220131",), ("2022-01-31",), ("2022-01-31 10:00:00",), ("x",)], "t string").select(dates.flexible_date(F.col("t"))).collect()
    assert [r[0] for r in days] == [date(2022, 1, 1), date(2022, 1, 31), date(2022, 1, 31), date(2022, 1, 31), None]


def test_scores_of_the_fixtures(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert abs(value(scores.risk(lit(5.0), lit(0.8), lit(1), lit(3), lit(1), lit(1))) - 0.725) < 1e-9
    assert abs(value(scores.stress(lit(25.0), lit(3), lit(1), lit(0.0), lit(0.0), lit(1))) - 0.8) < 1e-9
    assert abs(value(scores.complexity(lit(25), lit(50.0), lit(3), lit(5), lit(0.5))) - 0.77778) < 1e-4


def test_stops_and_patches(spark):
    where = spark.createDataFrame([(1, "Bruges ", 1.0, 1.0), (2, "Nowhere", 2.0, 2.0)], "stop_id int, stop_name string, stop_lat double, stop_lon double")
    stations = spark.createDataFrame([("Bruges", "Brugge", 51.0, 3.0), (None, "Bruges", 9.0, 9.0)], "fr string, nl string, lat double, lon double")
    named = rows.coordinates_by_name(stations, ["fr", "nl"], F.upper)
    assert {r.name: r.lat for r in named.collect()} == {"BRUGES": 51.0, "BRUGGE": 51.0}
    got = stops.at_stops(spark.createDataFrame([(1,), (2,), (3,)], "stop_id int"), stops.located(where, named)).orderBy("stop_id").collect()
    assert [(r.stop_name, r.stop_lat) for r in got] == [("BRUGES", 51.0), ("NOWHERE", 2.0), (None, None)]
    sites = spark.createDataFrame([("Baulers",), ("Brugge",), ("x",)], "station string")
    assert [r.lat for r in stops.patch_coordinates(sites, named).orderBy("station").collect()] == [50.6074, 51.0, None]


def test_last_values_take_each_columns_last(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, None, 2.0), ("a", 3, "z", None), ("b", 1, None, None)], "k string, o int, v string, w double")
    assert sorted(map(tuple, rows.last_values(df, "k", "o", ["v", "w"]).collect())) == [("a", "z", 2.0), ("b", None, None)]


def test_sorted_codes_of_many_values(spark):
    values = [f"v{i:06d}" for i in random.Random(2).sample(range(10**6), 9000)]
    df = spark.createDataFrame([(v,) for v in values * 2] + [(None,)], "x string")
    got = {r.value: r.code for r in rows.sorted_codes(df, "x", buckets=16).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    assert rows.sorted_codes(df.limit(0), "x").collect() == []


def test_series_cleaning_and_ids(spark):
    raw = [("b", "3", "1.5", "nan", "x"), ("b", "3", "2.5", "7", "-4"), ("a", "1", "1", None, "2"), (None, "1", "1", "1", "1"), ("a", "x", "1", "1", "1"), ("c", "1", "NaN", "1", "1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(raw)], "i int, g string, t string, y string, r string, c_idx string")
    clean = series.clean(df, "g", "t", "y", ["r"], ["c_idx"], F.col("i"))
    assert sorted(map(tuple, clean.collect())) == [("a", 1, 1.0, 0.0, 2.0), ("b", 3, 2.5, 7.0, 0.0)]
    ids = series.series_ids(clean, "g")
    assert {r.g: r.unique_id for r in ids.collect()} == {"a": 0, "b": 1}
    assert [r.unique_id for r in series.with_ids(spark.createDataFrame([("b", 1, 1.0), ("z", 1, 1.0)], "g string, t int, y double"), ids, "g", "t", "y").collect()] == [1]


def test_evaluation_decisions_and_budgets():
    good, bad = {"mae": 1.0, "naive_mae": 2.0, "n": 5}, {"mae": 1.99, "naive_mae": 2.0, "n": 5}
    assert series.quality_decision(good, good) == (False, [])
    assert series.quality_decision(bad, good) == (True, ["val_not_better_than_naive"])
    assert series.quality_decision({"mae": None, "n": 0}, bad) == (True, ["val_predictions_non_finite_or_missing", "test_after_val_not_better_than_naive"])
    assert series.step_budget(100, 1000, epochs=3, batch=32)["max_steps"] == 12
    assert series.step_budget(100, 1000, epochs=3, batch=32, windows_batch=100, by="windows")["max_steps"] == 30
    assert series.step_budget(100, 1000, epochs=None, max_steps=7, batch=32)["epochs_by_series"] == 7 / 4
    assert (ridge.naive_scale(100.0, 2.0), ridge.naive_scale(30.0, 2.0), ridge.naive_scale(100.0, None)) == (60.0, 1.0, 1.0)
    lists = rows.feature_lists(["id", "ds", "y", "a", "b_idx", "z"], ("id", "ds", "y"), ("z",))
    assert lists == {"read": ["id", "ds", "y", "a", "b_idx"], "exogenous": ["a", "b_idx"], "categorical": ["b_idx"], "real": ["a"]}
    assert rows.split_by_prefix(["s_a", "zz", "h_b"], ("s_",), ("h_",), ("f_",), {"future": ["zz"], "hist": []}) == {"static": ["s_a"], "hist": ["h_b"], "future": ["zz"]}


def test_boosted_trees_rank_features(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(a := rng.random(), rng.random(), 3.0 * a, i % 5 == 0) for i in range(400)], "a double, b double, y double, held boolean")
    model = boosting.fit(df, ["a", "b"], "y", trees=10, depth=3, step=0.5, holdout="held")
    top = rows.top_features(spark.createDataFrame(boosting.gains(model, ["a", "b"]), "feature string, gain double"), 1).first()
    assert top.feature == "a" and boosting.predict(model, df).agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0] < 0.7


def test_more_readers(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\n1,Gent,51.0,3.7\n")
    (tmp_path / "stop_times.txt").write_text("trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,24:10:00,24:10:30,1,1\n")
    where, times = readers.timetable(spark, str(tmp_path))
    assert where.first().stop_lat == 51.0 and (times.first().departure_s, times.first().dwell_s) == (87030, 30)
    df = spark.createDataFrame([(i, i % 7) for i in range(1000)] + [(None, 0)], "t int, v int")
    assert sorted(r.t for r in readers.tail(df, "t", 37).collect()) == list(range(963, 1000))
    assert 37 <= readers.tail(df, "t", 37, trim=False, ranges=10).count() <= 200
    assert readers.tail(df.limit(0), "t", 5).collect() == []
    log = tmp_path / "log.txt"
    log.write_text("start\nEpoch 0:  50%|## | 5/10 [x]\rEpoch 2: 30%|# | 3/10 [y]\nMetric did not improve\n==== training done ====\n")
    assert readers.progress(spark, str(log)) == {"epoch": 2, "percent": 30, "done": 3, "of": 10, "epochs": 2.3, "steps": 23, "early_stop": True, "ended": True}
    log.write_text("Epoch 4: done\n")
    assert readers.progress(spark, str(log))["epochs"] == 5.0
    raw = spark.createDataFrame([("s1", "2024-01-01T05:00", "1"), ("", "2024-01-01T05:00", "1"), ("s2", "oops", "1")], "code string, timestamp string, temp string")
    assert raw.agg(readers.skipped(raw)).first()[0] == 2 and readers.synop(raw).count() == 1
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.csv").write_text(f"a,b\n{i},x\n")
    stream = readers.stream_csv(spark, str(tmp_path / "in"), "a int, b string", 1)
    writers.stream_parquet(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
    writers.parquet(spark.range(50_000).withColumn("x", F.rand(1)), str(tmp_path / "groups"), group_bytes=100_000)
    meta = [pq.read_metadata(f) for f in (tmp_path / "groups").glob("*.parquet")]
    assert sum(m.num_row_groups for m in meta) > len(meta) and all(m.row_group(0).column(0).is_stats_set for m in meta)
    ordered = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "o int, v string")
    writers.csv(ordered, str(tmp_path / "csv"), [F.col("o")])
    assert [r.v for f in sorted((tmp_path / "csv").glob("*.csv")) for r in spark.read.csv(str(f), header=True).collect()] == ["a", "b", "c"]


def test_connections_come_from_an_external_table(spark):
    df = spark.createDataFrame([("s", "l1"), ("s", None)], "station string, line string")
    outside = spark.createDataFrame([("s", 9)], "station string, nb_connexions int")
    assert trips.connections(df, "station", "line").first().nb_connexions == 2 and trips.connections(df, "station", "line", outside).first().nb_connexions == 9


def test_fill_for_training_takes_the_mean_of_the_day(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 3, None), ("b", 1, None), ("b", 2, None), ("c", 2, 6.0)], "g string, t long, y double")
    got = {(r.g, r.t): r.y for r in series.complete_days(df, "g", "t", ["y"], "training").collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 2.0, ("a", 3): 2.0, ("b", 1): 2.0, ("b", 2): 4.0, ("c", 2): 6.0}


def test_enrichment_of_a_stream_keeps_the_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        lines = [f"{(7 * j + i) % 5},2024-01-05,{j % 24:02d}:00" for j in range(40)]
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join(["PTCAR_NO,DATDEP,REAL_TIME_DEP", *lines]) + "\n")
    h = (datetime(2024, 1, 5) - datetime(1970, 1, 1)).days * 24
    seen = spark.createDataFrame([("A", h + k, float(k), 0.0, 0.0, 0.0, 0.0) for k in range(0, 24, 5)], "station string, h int, temp double, precip double, wind_speed double, humidity double, pressure double")
    weather_of = enrich.hour_weather(seen, spark.createDataFrame([("A", 0)], "station string, ordinal int"), h - 5, h + 30)
    mapping = spark.createDataFrame([(str(k), "A", 1.0, False) for k in range(4)], "place_id string, station_id string, distance_km double, no_station boolean")
    stream = readers.stream_csv(spark, str(tmp_path / "in"), "PTCAR_NO string, DATDEP string, REAL_TIME_DEP string", 1)
    streaming.enrich_files(stream, mapping, weather_of, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    batches = [[r for f in sorted(b.glob("*.csv")) for r in spark.read.csv(str(f), header=True).collect()] for b in sorted((tmp_path / "out").glob("batch-*"))]
    assert sorted(tuple(r.PTCAR_NO for r in b) for b in batches) == sorted(tuple(str((7 * j + i) % 5) for j in range(40)) for i in range(2))
    assert all(len(r.asDict()) == 21 and (r.temp_depart is not None) and r.depart_no_station == ("true" if r.PTCAR_NO == "4" else "false") for b in batches for r in b)


def test_windowed_delays_end_with_the_watermark(spark, tmp_path):
    rows_in = [(datetime(2024, 1, 1, h, 30), "s", float(h)) for h in (1, 1, 2, 9)]
    spark.createDataFrame(rows_in, "ts timestamp, k string, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    q = streaming.windowed_delays(stream, "ts", "k", "v").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.window.start.hour, r.n, r.mean_delay) for r in spark.table("windows").collect()) == [(1, 2, 1.0), (2, 1, 2.0)]
