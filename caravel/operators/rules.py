"""Findings: rules as frames of (code, entity, severity, figure), stacked and kept latest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finding(rows: DataFrame, code: str, entity: str, severity, figure: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.col(entity).cast("string").alias("entity"), severity.alias("severity"), F.round(F.col(figure).cast("double"), 4).alias("figure"))


def cancellations(norm: DataFrame) -> DataFrame:
    """People of over 50 jobs who lose a tenth; over 15 % is critical."""
    per = norm.filter("is_booking and person_key is not null").groupBy("person_key").agg(F.count("outcome").alias("jobs"), F.count(F.when(F.col("outcome") == "not_completed", 1)).alias("lost"))
    rate = per.withColumn("rate", F.col("lost") / F.nullif("jobs", F.lit(0))).filter("jobs > 50 and rate >= 0.10")
    return finding(rate, "cancellations", "person_key", F.when(F.col("rate") > 0.15, "critical").otherwise("warning"), "rate")


def idle_vehicles(norm: DataFrame, days: int = 14) -> DataFrame:
    """Cars without a booking in the last days of the record that were seen before."""
    last = norm.agg(F.max("local_day").alias("today"))
    cars = norm.groupBy("plate").agg(F.max(F.when(F.col("is_booking"), F.col("local_day"))).alias("last_day"))
    idle = cars.crossJoin(F.broadcast(last)).withColumn("idle_days", F.datediff("today", "last_day")).filter(F.coalesce(F.col("idle_days"), F.lit(9999)) >= days)
    return finding(idle, "idle_vehicle", "plate", F.lit("warning"), "idle_days")


def partner_concentration(norm: DataFrame) -> DataFrame:
    """A product that holds 40 % or more of the bookings."""
    every = norm.filter("is_booking").groupBy("product").agg(F.count("*").alias("n"))
    share = every.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).filter("share >= 0.4")
    return finding(share, "partner_concentration", "product", F.lit("info"), "share")


def volume_trend(norm: DataFrame) -> DataFrame:
    """Platforms whose last 28 days differ from the 28 before by a fifth or more."""
    last = norm.filter("is_booking").agg(F.max("local_day").alias("today"))
    rows = norm.filter("is_booking").crossJoin(F.broadcast(last)).withColumn("age", F.datediff("today", "local_day")).filter("age < 56")
    per = rows.groupBy("platform").agg(F.count(F.when(F.col("age") < 28, 1)).alias("now"), F.count(F.when(F.col("age") >= 28, 1)).alias("before"))
    moved = per.withColumn("change", (F.col("now") - F.col("before")) / F.nullif("before", F.lit(0))).filter("abs(change) >= 0.2")
    return finding(moved, "volume_trend", "platform", F.when(F.col("change") < 0, "warning").otherwise("info"), "change")


def unsafe_driving(events: DataFrame, key: str, km: str, n: str) -> DataFrame:
    """Twice the fleet's median events per 100 km over more than 50 km."""
    rate = events.filter(F.col(km) > 50).withColumn("rate", 100 * F.col(n) / F.col(km))
    median = rate.agg(F.percentile("rate", F.lit(0.5)).alias("median"))
    high = rate.crossJoin(F.broadcast(median)).filter("rate >= 2 * median and median > 0").withColumn("times", F.col("rate") / F.col("median"))
    return finding(high, "unsafe_driving", key, F.when(F.col("times") >= 4, "critical").otherwise("warning"), "times")


def tracker_dark(fixes: DataFrame, source: str, plate: str, at: str, crowd: int = 5) -> DataFrame:
    """Sources that lose five or more cars within an hour gap of each other: an outage."""
    from caravel.operators.intervals import gap_islands

    last = fixes.groupBy(source, plate).agg(F.max(at).alias("last_at"))
    runs = gap_islands(last, [source], "last_at", 60).filter(F.col("n") >= crowd)
    return finding(runs, "tracker_feed_dark", source, F.lit("critical"), "n")


def stale_trackers(fixes: DataFrame, source: str, plate: str, at: str, hours: float = 24, dark: float = 72, crowd: int = 5) -> DataFrame:
    """Cars whose last fix of a source is `hours` or more before the source's newest, critical
    beyond `dark`; those that went dark together with a crowd are the feed's fault and are
    left to `tracker_dark`.
    """
    from caravel.operators.intervals import gap_islands

    last = fixes.groupBy(source, plate).agg(F.max(at).alias("last_at"))
    newest = last.groupBy(source).agg(F.max("last_at").alias("now"))
    runs = gap_islands(last, [source], "last_at", 60).filter(F.col("n") >= crowd).select(source, F.col("first").alias("__first"), F.col("last").alias("__last"))
    alone = last.join(runs, [last[source] == runs[source], last["last_at"] >= runs["__first"], last["last_at"] <= runs["__last"]], "left_anti")
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 3_600_000_000
    old = alone.join(newest, source).withColumn("age", age).filter(F.col("age") >= hours)
    return finding(old, "stale_tracker", plate, F.when(F.col("age") > dark, "critical").otherwise("warning"), "age")


def dormant_vehicles(fixes: DataFrame, plate: str, day: str, days: int = 36, gone: int = 180) -> DataFrame:
    """Cars silent for `days` or more at the end of the record; `gone` says they have left."""
    last = fixes.groupBy(plate).agg(F.max(day).alias("last_day"))
    today = fixes.agg(F.max(day).alias("today"))  # one row
    silent = last.crossJoin(F.broadcast(today)).withColumn("silent", F.datediff("today", "last_day")).filter(F.col("silent") >= days)
    return finding(silent, "vehicle_dormant", plate, F.when(F.col("silent") >= gone, "critical").otherwise("warning"), "silent")


def deadhead(trips: DataFrame, plate: str, empty_km: str, paid_km: str, least_km: float = 30, share: float = 0.3) -> DataFrame:
    """Cars that drive `share` km or more empty for each km paid, over enough paid km."""
    per = trips.filter(F.col(empty_km).isNotNull() & F.col(plate).isNotNull()).groupBy(plate).agg(F.sum(empty_km).alias("empty"), F.sum(paid_km).alias("paid"))
    wasted = per.filter(F.col("paid") > least_km).withColumn("ratio", F.col("empty") / F.col("paid")).filter(F.col("ratio") >= share)
    return finding(wasted, "deadhead_waste", plate, F.lit("warning"), "ratio")


def low_utilisation(hours: DataFrame, plate: str, online: str, on_trip: str, least: float = 0.2) -> DataFrame:
    """Cars on a trip for less than `least` of their online hours."""
    poor = hours.filter(F.col(online) > 0).withColumn("share", F.col(on_trip) / F.col(online)).filter(F.col("share") < least)
    return finding(poor, "low_utilisation", plate, F.lit("warning"), "share")


def online_without_trips(days: DataFrame, person: str, online_min: str, completed: str, closed: str) -> DataFrame:
    """People online on a day without completing a trip; only a warning while the day is open."""
    idle = days.filter((F.col(online_min) > 0) & (F.col(completed) == 0)).withColumn("__h", F.col(online_min) / 60)
    return finding(idle, "online_no_trips", person, F.when(F.col(closed), "critical").otherwise("warning"), "__h")


def expiring_documents(documents: DataFrame, entity: str, days_left: str, code: str = "vehicle_doc") -> DataFrame:
    """Documents that have expired or do within 30 days; critical from 7 days on."""
    due = documents.filter(F.col(days_left) <= 30)
    found = finding(due, code, entity, F.when(F.col(days_left) <= 7, "critical").otherwise("warning"), days_left)
    return found.withColumn("code", F.when(F.col("figure") < 0, f"{code}_expired").otherwise(f"{code}_expiring"))


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def latest(findings: DataFrame, run_at: str = "run_at") -> DataFrame:
    """The latest finding of each code and entity, if its code's last run found it (within
    ten minutes).
    """
    order = Window.partitionBy("code", "entity").orderBy(F.desc(run_at))
    ranked = findings.withColumn("__n", F.row_number().over(order)).withColumn("__last", F.max(run_at).over(Window.partitionBy("code")))
    return ranked.filter((F.col("__n") == 1) & (F.col(run_at) >= F.col("__last") - F.expr("INTERVAL '10' MINUTE"))).drop("__n", "__last")


def low_performers(days: DataFrame) -> DataFrame:
    """Per person of `days` (person, day, active, hours, money, trips): measures over three
    or more driven days, and causes against the medians of all.
    """
    per = days.groupBy("person").agg(
        F.count(F.when(F.col("active"), 1)).alias("driven"),
        F.count(F.when(~F.col("active"), 1)).alias("off"),
        F.sum("hours").alias("hours"), F.sum("money").alias("money"), F.sum("trips").alias("trips"),
    ).filter("driven >= 3")
    per = per.withColumn("off_share", F.col("off") / (F.col("off") + F.col("driven"))).withColumn("hours_day", F.col("hours") / F.col("driven"))
    per = per.withColumn("money_hour", F.col("money") / F.nullif("hours", F.lit(0.0))).withColumn("trips_day", F.col("trips") / F.col("driven"))
    names = ["off_share", "hours_day", "money_hour", "trips_day"]
    medians = per.agg(*[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in names])  # one row
    joined = per.crossJoin(F.broadcast(medians))
    causes = F.array_compact(F.array(
        F.when(F.col("off_share") >= F.greatest(F.lit(0.25), 2 * F.col("m_off_share")), "days_off"),
        F.when(F.col("hours_day") < 0.75 * F.col("m_hours_day"), "short_days"),
        F.when(F.col("money_hour") < 0.85 * F.col("m_money_hour"), "low_rate"),
        F.when(F.col("trips_day") < 0.75 * F.col("m_trips_day"), "few_trips"),
    ))
    return joined.withColumn("causes", causes).filter("size(causes) > 0").select("person", "driven", *names, "causes")


def unusual_days(days: DataFrame, day: str, value: str) -> DataFrame:
    """Days outside the range of the same weekday in the four weeks before, and a tenth or
    more off their median.
    """
    weekday = Window.partitionBy(F.weekday(day)).orderBy(day).rowsBetween(-4, -1)
    past = F.array_sort(F.collect_list(value).over(weekday))
    rows = days.withColumn("past", past).filter("size(past) = 4")
    median = (F.get("past", F.lit(1)) + F.get("past", F.lit(2))) / 2
    rows = rows.withColumn("median", median)
    outside = (F.col(value) < F.get("past", F.lit(0))) | (F.col(value) > F.get("past", F.lit(3)))
    return rows.filter(outside & (F.abs(F.col(value) - F.col("median")) >= 0.1 * F.col("median"))).select(day, value, "median", (F.col(value) > F.col("median")).alias("above"))
