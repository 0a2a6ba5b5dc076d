"""Trip shape: sessions, real stops, hubs, summaries, best match in time, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FEATURE_HUBS, HUBS, JUNCTION, SESSION_GAP
from ..functions.geo import haversine
from ..functions.numeric import clip, cyclic_gap, day_difference


def sessions(df: DataFrame, gap: int = SESSION_GAP) -> DataFrame:
    """WIN-01/02: sub-trips of (trip_id, stop_sequence, departure_s), a new one after a gap of more than ``gap``."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    jump = F.when(F.abs(F.col("departure_s") - F.lag("departure_s").over(w)) > gap, 1).otherwise(0)
    index = F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.withColumn("_jump", jump).withColumn("sub_trip_idx", index.cast("int")).drop("_jump")
    return out.withColumn("real_trip_id", F.concat(F.col("trip_id").cast("string"), F.lit("_sub"), F.col("sub_trip_idx").cast("string")))


def stop_flags(df: DataFrame) -> DataFrame:
    """WIN-03/04: real stops (dwell, first or last) and the local rank within a sub-trip, in one exchange."""
    w = Window.partitionBy("real_trip_id")
    ends = (F.col("stop_sequence") == F.min("stop_sequence").over(w)) | (F.col("stop_sequence") == F.max("stop_sequence").over(w))
    return df.withColumns({"is_real_stop": ((F.col("dwell_s") > 0) | ends).cast("int"), "local_sequence": F.dense_rank().over(w.orderBy("stop_sequence"))})


def segments(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("real_trip_id").orderBy("stop_sequence")
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return df.withColumn("segment_km", F.coalesce(step, F.lit(0.0)))


def trip_summary(df: DataFrame, hubs: dict[str, Column] | None = None) -> DataFrame:
    """AGG-06..11: per sub-trip its stops, ends, length and the last local rank at each hub (-1: none)."""
    at = {k: F.max(F.when(c, F.col("local_sequence")).otherwise(-1)).alias(f"max_seq_{k}") for k, c in (hubs or {}).items()}
    ends = F.struct("stop_sequence", "departure_s")
    return df.groupBy("real_trip_id").agg(
        F.sum("is_real_stop").alias("nb_stops"), F.max("local_sequence").alias("max_sequence"),
        F.min_by("departure_s", ends).alias("start_s"), F.max_by("departure_s", ends).alias("end_s"),
        F.min_by("lat", ends).alias("first_lat"), F.min_by("lon", ends).alias("first_lon"), F.max_by("lat", ends).alias("last_lat"), F.max_by("lon", ends).alias("last_lon"),
        F.sum("segment_km").alias("path_km"), *at.values(),
    )


def hub_predicates(name: Column) -> dict[str, Column]:
    return {k: name.isin(v) for k, v in FEATURE_HUBS.items()}


def is_major_hub(name: Column) -> Column:
    """Null for a null name."""
    return name.isin(sorted({*JUNCTION, *(x for v in HUBS.values() for x in v)})).cast("int")


def best_match(rows: DataFrame, candidates: DataFrame, keys: list[str], *, strict: bool = False) -> DataFrame:
    """JOI-06..08, AGG-09: for each row the candidate nearest in time of day, the short way round the clock.

    ``rows`` has row_s, ``candidates`` candidate_s (seconds of the day), real_trip_id and stop_sequence; ties go by the
    smaller real_trip_id, then stop_sequence (nulls last). Rows without candidates stay. A candidate without a time
    counts only where there is no other, but wins with ``strict``, as nulls sorted first would; a row without a time takes
    the first candidate.

    The nearest candidate is the last one before or the first one after on the clock, so rows and candidates are merged
    in time order by (keys, hour) instead of being paired: the exchange grows with rows plus candidates. What lies beyond
    an hour comes from the first and last candidates of the other hours.
    """
    name = F.struct(F.col("real_trip_id").isNull().alias("n1"), "real_trip_id", F.col("stop_sequence").isNull().alias("n2"), "stop_sequence")
    hour = lambda s: F.floor(F.pmod(s, F.lit(86400)) / 3600).cast("int")
    candidates = candidates.dropna(subset=keys)  # a null key meets nothing
    timed = candidates.where("candidate_s is not null").groupBy(*keys, F.col("candidate_s").cast("double").alias("s")).agg(F.min(name).alias("c"))
    timed = timed.select(*keys, hour(F.col("s")).alias("h"), F.struct("s", "c").alias("at"))
    # per key and hour: the nearest candidates of the hours before and after, round the clock
    hours = timed.groupBy(*keys, "h").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("h", "lo", "hi"))).alias("hours"))
    untimed = candidates.groupBy(*keys).agg(F.min(F.when(F.col("candidate_s").isNull(), name)).alias("null_c"), F.min(name).alias("any_c"))
    each = untimed.join(hours, keys, "left")
    tagged = rows.withColumns({"_h": hour(F.col("row_s")), "_row": F.struct(*[F.col(c) for c in rows.columns])})
    left = tagged.select(*keys, F.col("_h").alias("h"), F.col("row_s").cast("double").alias("t"), F.lit(None).cast(timed.schema["at"].dataType).alias("at"), "_row")
    right = timed.select(*keys, "h", F.col("at.s").alias("t"), "at", F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys, "h").orderBy("t")
    both = left.unionByName(right).withColumns(
        {
            "prev": F.last("at", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "next": F.first("at", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    met = both.where("_row is not null").join(each, keys, "left")
    before, after = F.filter("hours", lambda x: x["h"] < F.col("h")), F.filter("hours", lambda x: x["h"] > F.col("h"))
    met = met.withColumns({"before": F.try_element_at(F.when(F.size(before) > 0, before).otherwise(F.col("hours")), F.lit(-1)), "after": F.try_element_at(F.when(F.size(after) > 0, after).otherwise(F.col("hours")), F.lit(1))})
    near = [F.coalesce("prev", "before.hi"), F.coalesce("next", "after.lo")]
    gaps = [F.when(x.isNotNull() & F.col("t").isNotNull(), F.struct(cyclic_gap(F.col("t"), x["s"]).alias("gap"), x["c"].alias("c"))) for x in near]
    best = F.least(*gaps)
    chosen = F.when(F.col("t").isNull(), F.col("any_c"))
    if strict:
        chosen = chosen.when(F.col("null_c").isNotNull(), F.col("null_c"))
    chosen = chosen.when(best.isNotNull(), best["c"]).otherwise(F.col("null_c"))
    timeless = F.col("t").isNull() | (F.col("null_c").isNotNull() if strict else F.lit(False))
    out = met.select("_row", chosen.alias("c"), F.when(~timeless, best["gap"]).cast("long").alias("sched_diff"))
    return out.select("_row.*", "c.real_trip_id", "c.stop_sequence", "sched_diff")


def sane_distance(path: Column, straight: Column, seconds: Column) -> Column:
    """Path length, replaced by the straight line where implausible, and bounded."""
    duration = F.when(seconds < 0, seconds + 86400).otherwise(seconds)
    too_fast = (duration > 0) & (path * 3600.0 > duration * 220.0)
    plain = F.when(too_fast | (path > straight * 1.5), straight).otherwise(path)
    return F.least(plain, straight * 1.2, F.lit(220.0))


def position_and_hubs(stops: DataFrame) -> DataFrame:
    """JOI-09: each stop of a sub-trip with its place in it and the hubs that the trip still passes.

    ``stops`` has real_trip_id, stop_sequence, local_sequence and stop_name. The trip's aggregates come by windows over the
    exchange that the trip's own windows need, so they are not joined back.
    """
    w = Window.partitionBy("real_trip_id")
    here, last = F.col("local_sequence"), F.max("local_sequence").over(w)
    hubs = {f"traverse_{k}": F.max(F.when(c, here).otherwise(-1)).over(w) > here for k, c in hub_predicates(F.col("stop_name")).items()}
    out = stops.withColumns({"position_dans_trajet": position(here, last), "est_gare_terminus": F.coalesce((here == last).cast("int"), F.lit(0)), **{k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in hubs.items()}})
    return out.withColumn("est_hub_majeur", F.coalesce(is_major_hub(F.col("stop_name")), F.lit(0)))


def theoretical_minutes(stops: DataFrame) -> DataFrame:
    """MTH-08 by stop: minutes from the trip's start and to its end by the timetable, 0 to 300."""
    w = Window.partitionBy("real_trip_id").orderBy("stop_sequence").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_day = lambda c: c % 86400
    now, a, b = of_day(F.col("departure_s")), of_day(F.first("departure_s").over(w)), of_day(F.last("departure_s").over(w))
    timed = stops.withColumns({"_now": now, "_a": a, "_b": b})
    found = {"temps_theorique_depuis_depart": day_difference(F.col("_a"), F.col("_now")), "temps_theorique_jusque_arrivee": day_difference(F.col("_now"), F.col("_b"))}
    return timed.withColumns({k: clip(v, 0.0, 300.0) for k, v in found.items()}).drop("_now", "_a", "_b")


def position(sequence: Column, last: Column) -> Column:
    return F.when((last > 1) & sequence.isNotNull(), (sequence - 1) / (last - 1)).otherwise(0.0)


def connections(df: DataFrame, station: str, line: str, external: DataFrame | None = None) -> DataFrame:
    """JOI-10, AGG-01: distinct lines at each station, a null line counts as one; or the ``external`` table
    (station, nb_connexions) where there is one."""
    if external is not None:
        return external.select(F.col(station), F.col("nb_connexions").cast("long").alias("nb_connexions"))
    return df.groupBy(station).agg((F.count_distinct(line) + F.max(F.col(line).isNull().cast("int"))).alias("nb_connexions"))
