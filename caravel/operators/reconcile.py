"""What must be known before an unexplained segment counts as unauthorized: that its clock
is right, that its bookings have arrived, that its ends were seen, and that every channel
that could explain it was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravel.operators.intervals import minutes_between
from caravel.operators.joins import match_bookings
from caravel.operators.segments import Rules, seat_class, seat_segments, summarised, verdict

#: A clock further ahead than this is an error of the record and no lag, in minutes.
AHEAD = -60


def edges(fixes: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """plate, segment, gap_before and gap_after (minutes) of the seat segments of `fixes`:
    the gap before its first fix, and before the fix that closed it, null where there is
    none: then its true extent is unknown.

    The closing fix is the next occupied one, or the last of `empties` empty ones. The
    windows are those of the segments, over one sort.
    """
    order = Window.partitionBy("plate").orderBy("captured_at", "seat_occupied")
    occupied = F.coalesce(F.col("seat_occupied").cast("boolean"), F.lit(False))
    gap = minutes_between(F.lag("captured_at").over(order), F.col("captured_at"))
    rows = seat_segments(fixes, rules).withColumns({"__occ": occupied, "__gap": gap})
    after = [F.when(F.lead("__occ", j).over(order), F.lead("__gap", j).over(order)) for j in range(1, rules.empties)]
    rows = rows.withColumn("__after", F.coalesce(*after, F.lead("__gap", rules.empties).over(order))).filter("segment is not null")
    return rows.groupBy("plate", "segment").agg(F.min_by("__gap", "captured_at").alias("gap_before"), F.max_by("__after", "captured_at").alias("gap_after"))


def clock_lags(fixes: DataFrame, key: list[str]) -> DataFrame:
    """`key` and lag, the upper median of the minutes from captured_at to polled_at, of the
    fixes that have both; clocks more than an hour ahead are left out.

    Minutes are counted first; only the minute with the median is looked at more closely, as
    distinct lags with their counts. No group's lags are sorted in one task.
    """
    lag = minutes_between(F.col("captured_at"), F.col("polled_at"))
    lags = fixes.select(*key, lag.alias("lag")).filter(F.col("lag") > AHEAD).withColumn("minute", F.floor("lag"))
    minutes = lags.groupBy(*key, "minute").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*key)
    upto = whole.orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = minutes.withColumns({"upto": F.sum("n").over(upto), "middle": F.floor(F.sum("n").over(whole) / 2)})
    at = placed.filter((F.col("upto") > F.col("middle")) & (F.col("upto") - F.col("n") <= F.col("middle")))
    at = at.select(*key, "minute", (F.col("middle") - (F.col("upto") - F.col("n"))).alias("rest"))
    near = lags.groupBy(*key, "minute", "lag").agg(F.count("*").alias("n")).join(at, [*key, "minute"])
    so_far = F.sum("n").over(Window.partitionBy(*key).orderBy("lag").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return near.withColumn("upto", so_far).filter(F.col("upto") > F.col("rest")).groupBy(*key).agg(F.min("lag").alias("lag"))


def unread_channels(bookings: DataFrame, passes: DataFrame) -> DataFrame:
    """pass and unread: the channels (platform) that have ever had a booking but none in the
    pass, in order. `passes` has a row for each pass.
    """
    ever = bookings.agg(F.array_sort(F.collect_set("platform")).alias("ever"))  # one row, as long as there are channels
    seen = bookings.groupBy("pass").agg(F.collect_set("platform").alias("seen"))
    joined = passes.select("pass").distinct().join(seen, "pass", "left").crossJoin(F.broadcast(ever))
    return joined.select("pass", F.array_except("ever", F.coalesce("seen", F.array().cast("array<string>"))).alias("unread"))


def uncollected_fleets(bookings: DataFrame, declared: DataFrame, channel: str = "hotel") -> DataFrame:
    """The fleets of `declared` (fleet_id) whose account on a channel was never read,
    although that of another fleet was.
    """
    read = bookings.filter(F.col("platform") == channel).select("fleet_id").distinct()
    any_read = read.agg((F.count("*") > 0).alias("any"))
    return declared.select("fleet_id").distinct().join(read, "fleet_id", "left_anti").crossJoin(F.broadcast(any_read)).filter("any").select("fleet_id")


def judged(fixes: DataFrame, bookings: DataFrame, declared: DataFrame, days: int, origin: str, rules: Rules = Rules()) -> DataFrame:
    """Every seat segment of `fixes` (plate, source, fleet_id, captured_at, polled_at, ...)
    with its kind, matched booking, verdict and reason.

    `bookings`: booking_id, plate, platform, fleet_id, b_start, b_end, outcome; `declared`:
    fleets with an account of their own on the hotel channel. Passes of so many days from
    `origin` are judged by what was read in each; a segment belongs to the pass in which it
    starts. The clock is measured for each source and pass. A gap at a segment's ends counts
    as a gap of its own. Guards speak in the order of `verdict`. A car has one source and
    fleet; of several the smallest names are taken.
    """
    pass_of = lambda ts: F.floor(F.datediff(F.to_date(ts), F.lit(origin)) / days).cast("bigint")
    until = F.lit(origin).cast("timestamp_ntz") + F.make_interval(days=((F.col("pass") + 1) * days).cast("int"))
    facts = fixes.groupBy("plate").agg(F.min("source").alias("source"), F.min("fleet_id").alias("fleet_id"))
    boundary = F.greatest(F.coalesce("gap_before", F.lit(0.0)), F.coalesce("gap_after", F.lit(0.0)))
    found = summarised(seat_segments(fixes, rules)).join(edges(fixes, rules), ["plate", "segment"]).withColumn("max_gap", F.greatest("max_gap", boundary))
    found = found.withColumn("kind", seat_class(rules)).withColumn("segment_id", F.xxhash64("plate", "segment")).join(facts, "plate")
    found = found.withColumn("pass", pass_of("start")).withColumn("__until", until)
    timed, booked = fixes.withColumn("pass", pass_of("captured_at")), bookings.withColumn("pass", pass_of("b_start"))
    matched = match_bookings(found, bookings)
    never = uncollected_fleets(booked, declared).withColumn("__never", F.lit(True))
    known = matched.join(clock_lags(timed, ["source", "pass"]), ["source", "pass"], "left").join(unread_channels(booked, found), "pass").join(never, "fleet_id", "left")
    edge = F.col("gap_before").isNull() | F.col("gap_after").isNull()
    unread, missing = F.size("unread") > 0, F.coalesce("__never", F.lit(False))
    judgement = verdict(F.col("kind"), F.col("matched_booking"), F.coalesce("lag", F.lit(0.0)), F.col("end"), F.col("__until"), edge, unread, missing, rules)
    late = minutes_between(F.col("end"), F.col("__until")) < rules.lag_minutes
    reason = (
        F.when(F.col("kind") != "candidate", F.concat(F.lit("classified "), F.col("kind")))
        .when(F.col("matched_booking").isNotNull(), F.concat(F.lit("matched booking "), F.col("matched_booking")))
        .when(F.col("lag") > 60, F.concat(F.lit("clock is behind by minutes: "), F.round("lag").cast("int")))
        .when(late, "bookings may not have arrived")
        .when(edge, "runs past the edge of the record")
        .when(unread, F.concat(F.lit("no bookings read from "), F.array_join("unread", ",")))
        .when(missing, "the fleet's hotel account was never read")
        .otherwise("no booking on any channel")
    )
    return known.select("plate", "segment", "source", "fleet_id", "pass", "start", "end", "gap_before", "gap_after", "kind", "matched_booking", judgement.alias("verdict"), reason.alias("reason"))
