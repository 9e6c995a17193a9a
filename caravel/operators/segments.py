"""Seat segments and their verdicts, by windows over a car's fixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions import geo
from caravel.operators.attribution import holders
from caravel.operators.intervals import minutes_between
from caravel.operators.joins import asof_after, asof_before


@dataclass(frozen=True)
class Rules:
    """Fixed values of the segmenter, in minutes, km and km/h."""

    bridge: float = 10
    gap_break: float = 15
    min_minutes: float = 5
    min_km: float = 1
    min_top: float = 5
    max_hours: float = 8
    empties: int = 2
    lag_minutes: float = 120


def seat_segments(fixes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`fixes` (plate, captured_at, seat_occupied, ...) with segment (a number in the car;
    null outside): an occupied fix extends the open segment if the fix before it, of any
    kind, is at most `bridge` minutes back; `empties` empty fixes in a row close it.

    An occupied fix opens a segment if there was none before, if enough empty ones came
    since, or after a gap; so a running count of openings numbers them, in one sort that
    spills and never gathers a car's life.
    """
    order = Window.partitionBy("plate").orderBy("captured_at", "seat_occupied")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    occupied = F.coalesce(F.col("seat_occupied").cast("boolean"), F.lit(False))
    rows = fixes.withColumn("__occ", occupied).withColumn("__n", F.row_number().over(order)).withColumn("__gap", minutes_between(F.lag("captured_at").over(order), F.col("captured_at")))
    rows = rows.withColumn("__last", F.max(F.when(F.col("__occ"), F.col("__n"))).over(before))
    opens = F.col("__occ") & (F.col("__last").isNull() | (F.col("__n") - F.col("__last") > rules.empties) | (F.col("__gap") > rules.bridge))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.when(F.col("__occ"), F.sum(opens.cast("bigint")).over(so_far))
    return rows.withColumn("segment", number).drop("__occ", "__n", "__gap", "__last")


def summarised(marked: DataFrame) -> DataFrame:
    """One row a segment: start, end, minutes, km (odometer if it moved 0 to 500, else the
    fixes' distance), top speed, share of ignition, largest gap, fixes.
    """
    order = Window.partitionBy("plate", "segment").orderBy("captured_at")
    step = geo.haversine_km(F.lag("lat").over(order), F.lag("lng").over(order), F.col("lat"), F.col("lng"))
    gap = minutes_between(F.lag("captured_at").over(order), F.col("captured_at"))
    rows = marked.filter("segment is not null").withColumn("__km", step).withColumn("__gap", gap)
    moved = F.max("odometer") - F.min("odometer")
    return rows.groupBy("plate", "segment").agg(
        F.min("captured_at").alias("start"),
        F.max("captured_at").alias("end"),
        minutes_between(F.min("captured_at"), F.max("captured_at")).alias("minutes"),
        F.when((moved > 0) & (moved < 500), moved).otherwise(F.coalesce(F.sum("__km"), F.lit(0.0))).alias("km"),
        F.coalesce(F.max("speed"), F.lit(0.0)).alias("top_speed"),
        F.avg(F.col("ignition").cast("double")).alias("ignition_ratio"),
        F.coalesce(F.max("__gap"), F.lit(0.0)).alias("max_gap"),
        F.count("*").alias("fixes"),
    )


def seat_class(rules: Rules = Rules()) -> Column:
    """sensor_suspect, partial, stationary or candidate, in that order of precedence."""
    return (
        F.when(F.col("minutes") > 60 * rules.max_hours, "sensor_suspect")
        .when((F.col("minutes") >= 30) & (F.col("ignition_ratio") < 0.2) & (F.col("top_speed") < rules.min_top), "sensor_suspect")
        .when(F.col("max_gap") > rules.gap_break, "partial")
        .when(F.col("minutes") < rules.min_minutes, "stationary")
        .when((F.col("km") < rules.min_km) | (F.col("top_speed") < rules.min_top), "stationary")
        .otherwise("candidate")
    )


def journey_class(rules: Rules = Rules()) -> Column:
    """The same for tracker journeys (start, end, distance_km)."""
    minutes = minutes_between(F.col("start"), F.col("end"))
    km = F.col("distance_km")
    return (
        F.when(F.col("end").isNull(), "unverifiable")
        .when(minutes > 60 * rules.max_hours, "suspect")
        .when(km.isNull() | (km < 0) | (km >= 500), "unverifiable")
        .when((minutes < rules.min_minutes) | (km < rules.min_km) | (km < rules.min_top * minutes / 60), "stationary")
        .otherwise("candidate")
    )


def booking_end(requested: Column, ended: Column, outcome: Column, duration_s: Column, km: Column) -> Column:
    """When a booking's window ends: its end; at once if it never ran; its duration; two
    minutes a km up to three hours; else half an hour.
    """
    plus = lambda s: requested + F.make_dt_interval(secs=s.cast("decimal(18,6)"))
    return (
        F.when(ended.isNotNull(), ended)
        .when(outcome == "not_completed", requested)
        .when(duration_s > 0, plus(duration_s))
        .when(km > 0, plus(F.least(km * 120, F.lit(10800.0))))
        .otherwise(requested + F.expr("INTERVAL '30' MINUTE"))
    )


def verdict(kind: Column, matched: Column, clock_lag: Column, end: Column, window_end: Column, edge: Column, channels_missing: Column, never_collected: Column, rules: Rules = Rules()) -> Column:
    """The judgement of a candidate; other kinds keep their own."""
    return (
        F.when(kind != "candidate", kind)
        .when(matched.isNotNull(), "authorized")
        .when(clock_lag > 60, "unverifiable")
        .when(minutes_between(end, window_end) < rules.lag_minutes, "pending")
        .when(edge | channels_missing | never_collected, "unverifiable")
        .otherwise("unauthorized")
    )


def attributed(segments: DataFrame, trips: DataFrame, custody: DataFrame, before_minutes: int = 240) -> DataFrame:
    """Who an unexplained segment (segment_id, plate, start, end) belongs to, as a ladder:
    bracketed (one person's completed trips within `before_minutes` before and after, and
    nobody else's between), last_trip, sole_custodian, ambiguous, unknown.

    `trips`: plate, person, t_start, t_end. `custody`: plate, day, person.
    """
    # evidence depends on a car and two times alone; it is found by sorting, without pairs
    reach = F.expr(f"INTERVAL '{before_minutes}' MINUTE")
    span = ["plate", "start", "end"]
    done = trips.filter("t_start is not null and t_end is not null")
    newest = done.groupBy("plate", "t_end").agg(F.max("person").alias("last_person"))
    sides = asof_before(segments.select(*span).distinct(), newest, ["plate"], "start", "t_end", ["last_person"])
    sides = sides.select(*span, "last_person", F.when(F.col("at") > F.col("start") - reach, F.col("last_person")).alias("before_person"))
    soonest = done.groupBy("plate", "t_start").agg(F.min("person").alias("next_person"))
    sides = asof_after(sides, soonest, ["plate"], "end", "t_start", ["next_person"])
    sides = sides.select(*span, "last_person", "before_person", F.when(F.col("at") < F.col("end") + reach, F.col("next_person")).alias("after_person"))
    so_far = Window.partitionBy("plate").orderBy("t_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = done.groupBy("plate", "t_start").agg(F.max("t_end").alias("__end")).select("plate", "t_start", F.max("__end").over(so_far).alias("until"))
    sides = asof_before(sides, running, ["plate"], "end", "t_start", ["until"], strictly=True)
    known = sides.withColumn("between", F.coalesce(F.col("until") > F.col("start"), F.lit(False))).drop("at", "until")
    joined = segments.join(known.join(holders(segments, custody), span, "left"), span, "left")
    bracketed = (F.col("before_person") == F.col("after_person")) & ~F.col("between")
    one, several = F.col("custodian") == F.col("other"), F.col("custodian") != F.col("other")
    basis = F.when(bracketed, "bracketed").when(F.col("last_person").isNotNull(), "last_trip").when(one, "sole_custodian").when(several, "ambiguous").otherwise("unknown")
    person = F.when(bracketed, F.col("before_person")).when(F.col("last_person").isNotNull(), F.col("last_person")).when(one, F.col("custodian"))
    return joined.select(*segments.columns, basis.alias("basis"), person.alias("person"))
