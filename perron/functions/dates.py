"""Date and time expressions: Column -> Column, no UDF."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CALENDAR, HOLIDAYS, SCHOOL_HOLIDAYS


def at_seconds(day: Column, seconds: Column) -> Column:
    """DAT-01."""
    return F.timestamp_add("SECOND", seconds, day.cast("timestamp_ntz"))


def iso_weekday(t: Column) -> Column:
    """1 Monday to 7 Sunday."""
    return F.weekday(t) + 1


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """MTH-01: sine and cosine of a phase, rounded to 4 places, float."""
    angle = value * F.lit(2.0 * 3.141592653589793 / period)
    return F.round(F.sin(angle), 4).cast("float"), F.round(F.cos(angle), 4).cast("float")


def temporal_features(df: DataFrame, t: str = "datetime") -> DataFrame:
    c = F.col(t)
    out = {}
    for name, value, period in (("heure_prevue", F.hour(c) + F.minute(c) / 60.0, 24), ("jour_semaine", iso_weekday(c) % 7, 7), ("mois", F.month(c) - 1, 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(value.cast("double"), period)
    return df.withColumns(out)


def is_weekend(t: Column) -> Column:
    return (iso_weekday(t) >= 6).cast("int")


def is_peak(t: Column) -> Column:
    """DAT-04: Monday to Friday, 7 to 9 and 17 to 19."""
    h = F.hour(t)
    return ((iso_weekday(t) < 6) & (((h >= 7) & (h < 9)) | ((h >= 17) & (h < 19)))).cast("int")


def day_period(t: Column) -> Column:
    """DAT-05."""
    h = F.hour(t)
    return F.when(h < 6, "nuit").when(h < 12, "matin").when(h < 14, "midi").when(h < 18, "apres_midi").when(h < 22, "soir").otherwise("fin_soiree")


def calendar(spark: SparkSession) -> DataFrame:
    """DAT-06/07: one row for each day of 2010-2030; 7670 rows, so it may be broadcast."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{CALENDAR[0]}', DATE'{CALENDAR[1]}', INTERVAL 1 DAY)")).alias("date_key"))
    school = functools.reduce(lambda a, b: a | b, [F.col("date_key").between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in SCHOOL_HOLIDAYS])
    return days.select("date_key", F.col("date_key").isin(*[F.lit(x).cast("date") for x in HOLIDAYS]).cast("int").alias("is_jour_ferie"), school.cast("int").alias("is_vacances_scolaires"))


def clock_seconds(x: Column) -> Column:
    """DAT-10: seconds of HH:MM:SS; hours may pass 24."""
    part = lambda a: F.substring(x, a, 2).try_cast("int")
    return part(1) * 3600 + part(4) * 60 + part(7)


def trip_ids(train: Column, day: Column) -> tuple[Column, Column]:
    """DAT-09: T_<no>_<ddMMMyyyy> and T_<no>_<yyyyMMdd>."""
    head = F.concat(F.lit("T_"), train.cast("string"), F.lit("_"))
    return F.concat(head, F.upper(F.date_format(day, "ddMMMyyyy"))), F.concat(head, F.date_format(day, "yyyyMMdd"))


def flexible_date(x: Column) -> Column:
    """DAT-13: yyyy-MM-dd, yyyyMMdd or ddMMMyyyy; else the day of what reads as a timestamp, else null."""
    t = F.trim(x)
    shapes = ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{2}[A-Za-z]{3}\d{4}$", "ddMMMyyyy"))
    out = None
    for pattern, form in shapes:
        out = (F if out is None else out).when(t.rlike(pattern), F.try_to_date(F.initcap(t) if form[0] == "d" else t, form))
    return out.otherwise(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]"), t.try_cast("timestamp_ntz").cast("date")))


def flexible_seconds(x: Column) -> Column:
    """DAT-14: seconds of HH:mm:ss, HH:mm, HHmm, HH or HHmmss; else null."""
    t = F.trim(x)
    digits = F.regexp_replace(t, ":", "")
    part = lambda a: F.coalesce(F.substring(digits, a, 2).try_cast("int"), F.lit(0))
    fits = t.rlike(r"^(\d{2}:\d{2}:\d{2}|\d{2}:\d{2}|\d{4}|\d{2}|\d{6})$") & (part(1) < 24) & (part(3) < 60) & (part(5) < 60)
    return F.when(fits, part(1) * 3600 + part(3) * 60 + part(5))


def parsed_instant(x: Column, zone: str = "Europe/Brussels") -> Column:
    """DAT-12: UTC time of a text: an instant where it ends in Z or an offset, else a local time of ``zone`` in one of the
    shapes yyyy-MM-dd or yyyyMMdd, alone or followed by HH, HH:mm, HHmm or HH:mm:ss; else null."""
    t = F.trim(x)
    shape = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::(\d{2}))?)?)?$"
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(t, shape, i), F.lit("")), F.lit(default))
    plain = F.concat(part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    zoned = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    local = F.convert_timezone(F.lit(zone), F.lit("UTC"), plain.try_cast("timestamp_ntz"))
    instant = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(zoned, instant).when(t.rlike(shape), local)


def utc_hour_number(local: Column, zone: str = "Europe/Brussels") -> Column:
    """Hours since 1970 in UTC of a local time without zone."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return (F.unix_date(utc.cast("date")) * 24 + F.hour(utc)).cast("int")


def planned_time(day: Column, *clocks: Column) -> Column:
    """DAT-01: day and the first of the clock texts (HH:MM:SS) that is readable; null without one."""
    readable = [F.when(c.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), clock_seconds(c)) for c in clocks]
    return at_seconds(day, F.coalesce(*readable))


def day_before(day: Column) -> Column:
    """DAT-11: the day before as text."""
    return F.date_format(F.date_sub(day, 1), "yyyy-MM-dd")


def utc_hour_key(local: Column, zone: str = "Europe/Brussels") -> Column:
    """DAT-12: yyyy-MM-dd-HH in UTC of a local time without zone, floored to the hour."""
    return F.date_format(F.to_utc_timestamp(F.date_trunc("HOUR", local.cast("timestamp")), zone), "yyyy-MM-dd-HH")
