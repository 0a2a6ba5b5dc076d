"""Expressions against literal expected values."""

import math

import pytest
from pyspark.sql import functions as F

from perron.constants import CONGESTION, NAME_CORRECTIONS
from perron.functions import dates, geo, numeric, text
from perron.operators import density, scores, series, trips


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_cyclic_hour_and_weekday(spark):
    df = spark.sql("select timestamp_ntz'2024-01-07 10:00:00' as datetime")
    r = dates.temporal_features(df).first()
    assert (round(r.heure_prevue_sin, 4), round(r.heure_prevue_cos, 4), r.jour_semaine_sin, r.jour_semaine_cos) == (0.5, -0.866, 0.0, 1.0)
    assert df.select(dates.is_weekend(F.col("datetime"))).first()[0] == 1


def test_train_type(spark):
    rows = [("IC 33",), ("S52",), ("L B9",), ("P",), ("ic-1",), ("CR 1",), ("EXTRA",), (None,)]
    assert [v[0] for v in values(spark, rows, "x string", text.train_type(F.col("x")))] == ["IC", "S", "L", "P", "IC", "CR", "UNKNOWN", "UNKNOWN"]


def test_keys_and_names(spark):
    n = F.lit(None).cast("string")
    r = spark.range(1).select(text.group_id(n, n), text.strict_group_id(n, n), text.line_name(F.lit(" 28 A 1")), *[f(F.lit("Liège-Guillemins")) for f in (text.station_form_1, text.station_form_2, text.station_form_3)], text.station_form_3(F.lit("é!")), text.station_form_3(F.lit("!")), text.corrected_name(F.lit("forest-midi"))).first()
    assert tuple(r) == ("UNKNOWN_", None, "28A 1", "LIEGE-GUILLEMINS", "LIEGEGUILLEMINS", "LIEGE-GUILLEMINS", "E", None, "VORST-ZUID")
    assert len(NAME_CORRECTIONS) == 19


def test_calendar_and_peak(spark):
    cal = {str(r.date_key): (r.is_jour_ferie, r.is_vacances_scolaires) for r in dates.calendar(spark).collect()}
    assert len(cal) == 7670
    assert (cal["2023-07-21"][0], cal["2025-07-21"][0], cal["2025-01-05"][1], cal["2025-01-06"][1]) == (1, 0, 1, 0)
    times = [("2024-01-05 07:00:00",), ("2024-01-05 09:00:00",), ("2024-01-06 07:30:00",)]
    assert [v[0] for v in values(spark, times, "t string", dates.is_peak(F.col("t").cast("timestamp_ntz")))] == [1, 0, 0]


def test_flexible_dates_and_times(spark):
    got = values(spark, [("01JAN2022",), ("20220131",), ("2022-01-31",), ("x",), (None,)], "x string", dates.flexible_date(F.col("x")).cast("string"))
    assert [v[0] for v in got] == ["2022-01-01", "2022-01-31", "2022-01-31", None, None]
    got = values(spark, [("0905",), ("09",), ("9:05",), ("090507",), ("09:05:07",), ("2560",)], "x string", dates.flexible_seconds(F.col("x")))
    assert [v[0] for v in got] == [32700, 32400, None, 32707, 32707, None]
    got = values(spark, [("2024-03-31 02:30:00",), ("2024-07-01 00:10:00",), ("2024-12-01 00:59:59",)], "x string", dates.utc_hour_key(F.col("x").cast("timestamp_ntz")))
    assert [v[0] for v in got][1:] == ["2024-06-30-22", "2024-11-30-23"]


def test_parsers(spark):
    got = values(spark, [("12,5",), ("7abc",), ("",), ("abc",), ("-.5e1x",)], "x string", text.lenient_float(F.col("x")))
    assert [v[0] for v in got] == [12.5, 7.0, None, None, -5.0]
    got = values(spark, [("50.8, 4.3",), ("POINT (50.8 4.3)",), ('{"coordinates":[4.3, 50.8]}',), ("x",), (None,)], "x string", text.point(F.col("x")).alias("p"))
    assert [v[0] and v[0].lat for v in got] == [50.8, 50.8, 4.3, None, None]
    got = values(spark, [("Total closure",), ("voie unique",), ("Vitesse réduite",), ("",), (None,), ("autre",)], "x string", text.works_type(F.col("x")), text.works_level(text.works_type(F.col("x"))))
    assert got == [("total_closure", 3), ("single_track", 2), ("speed_reduction", 1), ("none", 0), ("none", 0), ("other", 0)]
    assert spark.range(1).select(text.identifiers(F.lit(" a "), F.lit(""), F.lit("b"), F.lit("a"), F.lit(None))).first()[0] == ["a", "b"]


def test_distances(spark):
    rows = [(130.0, 80.0, 3600), (110.0, 80.0, 3600), (300.0, 200.0, 3600)]
    assert [v[0] for v in values(spark, rows, "p double, s double, t int", trips.sane_distance(F.col("p"), F.col("s"), F.col("t")))] == [80.0, 96.0, 200.0]
    point = [F.lit(x) for x in (50.0, 4.0, 51.0, 5.0)]
    a, b = spark.range(1).select(geo.haversine(*point), geo.haversine_atan2(*point)).first()
    assert abs(a - 131.8) < 1 and abs(a - b) < 1e-9


def test_numeric(spark):
    got = values(spark, [(84600, 1800), (1000, 400)], "a int, b int", numeric.day_difference(F.col("a"), F.col("b")))
    assert [v[0] for v in got] == [60.0, 0.0]
    r = spark.range(1).select(numeric.clip(F.lit(None).cast("double"), 0, 1), numeric.clip(F.lit(7.0), 0, 1), numeric.row_mean([F.lit(3.0), F.lit(None), F.lit(5.0)]), numeric.row_mean([F.lit(None).cast("double")]), numeric.cyclic_gap(F.lit(86340), F.lit(60))).first()
    assert tuple(r) == (None, 1.0, 4.0, None, 120)


@pytest.mark.parametrize(("times", "want"), [(0.5, 0.5), (2.0, 2.0)])
def test_congestion_is_not_capped(spark, times, want):
    r = spark.range(1).select(density.congestion({k: F.lit(c * times) for k, (c, _) in CONGESTION.items()})).first()[0]
    assert abs(r - want) < 1e-9


def test_scores(spark):
    cases = {(5.0, -2.0): 0.75, (5.0, 0.0, 10.0): 0.3, (): 0.5}
    for lags, want in cases.items():
        row = {f"retard_j_{n}": F.lit(lags[n - 1] if n <= len(lags) else 0.0) for n in range(1, 8)} | {f"lag_missing_j{n}": F.lit(0 if n <= len(lags) else 1) for n in range(1, 8)}
        assert abs(scores.lag_moments(spark.range(1).withColumns(row)).select(scores.reliability()).first()[0] - want) < 1e-9
    one = [F.lit(x) for x in (5.0, 0.8, 1, 3, 1, 1)]
    two = [F.lit(x) for x in (25.0, 3, 1, 0.0, 0.0, 1)]
    three = [F.lit(x) for x in (25, 50, 3, 5, 0.5)]
    risk, stress, complexity = spark.range(1).select(scores.risk(*one), scores.stress(*two), scores.complexity(*three)).first()
    assert abs(risk - 0.725) < 1e-9 and abs(stress - 0.8) < 1e-9 and abs(complexity - 0.7778) < 1e-4


def test_split_bounds(spark):
    rows = [("2025-02-28 00:00:00",), ("2025-02-28 00:00:01",), ("2025-07-31 00:00:00",), ("2025-07-31 08:00:00",)]
    t = F.col("t").cast("timestamp_ntz")
    assert [v[0] for v in values(spark, rows, "t string", series.split_label(t, "2025-02-28", "2025-07-31"))] == ["train", "val", "val", "test"]
    assert [v[0] for v in values(spark, rows, "t string", series.split_label(t, "2025-02-28", "2025-07-31", whole_days=True))] == ["train", "train", "val", "val"]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (2.0, 4.0, 2.0), (math.nan, 1.0, 1.0)], "y double, pred double, naive double")
    r = series.metrics(df).first()
    assert (r.mae, round(r.rmse, 4), r.naive_mae, r.improvement, r.n) == (1.5, 1.5811, 0.5, -200.0, 2)
