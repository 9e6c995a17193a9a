"""The findings of a day, held against the same weekday of the four weeks before.

Every day of the record gets its report at once: a day's aggregate is sent to the four days
of the same weekday that look back on it, so what is compared meets in one aggregation and
no day is looked up from another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the report."""

    unusual_pct: float = 10
    idle_days: int = 2
    idle_lookback: int = 14
    drop_pct: float = 50
    min_usual: float = 200
    regular_of_4: int = 3
    open_min: int = 5
    open_pct: float = 30
    channel_points: float = 15
    channel_min: int = 10
    hour_min: float = 15
    hour_share: float = 0.2


COLUMNS = ["day", "kind", "entity", "today", "usual"]


def median_of(values: Column) -> Column:
    """The median of an array of numbers; null of an empty one."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, at((n - 1) / 2)).otherwise((at(n / 2 - 1) + at(n / 2)) / 2))


def looked_back(daily: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, day, today and past (k from 1 to 4 to struct of values) for each day of `daily`
    (keys, day, values; a row a day) and each of the four same weekdays after it.
    """
    spread = daily.select(*keys, F.struct(*values).alias("v"), F.explode(F.array(*[F.struct(F.date_add("day", 7 * k).alias("day"), F.lit(k).alias("k")) for k in range(5)])).alias("to"))
    entries = F.collect_list(F.when(F.col("to.k") > 0, F.struct(F.col("to.k").alias("k"), "v")))  # four at most
    return spread.groupBy(*keys, F.col("to.day").alias("day")).agg(F.max(F.when(F.col("to.k") == 0, F.col("v"))).alias("today"), F.map_from_entries(entries).alias("past"))


def usable_days(trips: DataFrame) -> DataFrame:
    """day and usable: which of the four weeks before (1 to 4) have any booking, for every
    day with one. A day without any was not collected, not quiet.
    """
    days = trips.select("day").distinct().withColumn("one", F.lit(1))
    found = looked_back(days, [], ["one"]).filter("today is not null")
    return found.select("day", F.array_sort(F.map_keys("past")).alias("usable"))


def day_findings(trips: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """day, kind, entity, today and usual of every finding on `trips` (day, hour, platform,
    plate, person, completed, lost, fare; bookings only):

    measure: bookings, completed, fares, cars or people outside the range of the usable weeks
    (two or more) and so far off their median; channel: completion, in per cent, fallen by so
    many points (days of enough bookings only); hours_less, hours_more: the three-hour window
    furthest below and above its usual; driver_down and driver_absent: regulars (on so many
    of the usable days) who earned half or less of their usual or did not drive; open_jobs:
    people who left so many bookings uncompleted; car_idle: cars without a booking for so
    many days, with one within the lookback (today: days).
    """
    count = lambda p: F.count(F.when(p, 1))
    usable = usable_days(trips)
    earning = F.col("fare") > 0
    names = ["bookings", "completed", "fares", "cars", "people"]
    totals = trips.groupBy("day").agg(
        F.count("*").cast("double").alias("bookings"), count(F.col("completed")).cast("double").alias("completed"), F.coalesce(F.sum("fare"), F.lit(0)).cast("double").alias("fares"),
        F.countDistinct("plate").cast("double").alias("cars"), F.countDistinct(F.when(earning, F.col("person"))).cast("double").alias("people"),
    )
    stacked = totals.select("day", F.explode(F.array(*[F.struct(F.lit(c).alias("entity"), F.col(c).alias("y")) for c in names])).alias("m")).select("day", "m.entity", "m.y")
    seen = looked_back(stacked, ["entity"], ["y"]).filter("today is not null")
    past = F.transform(F.map_values("past"), lambda v: v["y"])
    usual, y = median_of(past), F.col("today.y")
    far = ((y < F.array_min(past)) | (y > F.array_max(past))) & (F.abs(y - usual) * 100 >= t.unusual_pct * F.abs(usual)) & (usual != 0)
    measures = seen.filter((F.size(past) >= 2) & far).select("day", F.lit("measure").alias("kind"), "entity", y.alias("today"), usual.alias("usual"))

    per = trips.groupBy("platform", "day").agg(F.count("*").alias("n"), count(F.col("completed")).alias("done"))
    full = looked_back(per.filter(F.col("n") >= t.channel_min).withColumn("pct", 100 * F.col("done") / F.col("n")), ["platform"], ["pct"]).filter("today is not null")
    usual, y = median_of(F.transform(F.map_values("past"), lambda v: v["pct"])), F.col("today.pct")
    channels = full.filter(usual - y >= t.channel_points).select("day", F.lit("channel").alias("kind"), F.col("platform").alias("entity"), y.alias("today"), usual.alias("usual"))

    # a booking counts in the three windows that hold its hour
    hours = trips.select("day", F.explode(F.array(*[F.pmod(F.col("hour") - i, F.lit(24)) for i in range(3)])).alias("window")).groupBy("window", "day").agg(F.count("*").alias("n"))
    every = usable.select("day", "usable", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("window"))
    held = every.join(looked_back(hours, ["window"], ["n"]), ["day", "window"], "left").filter(F.size("usable") >= 2)
    was = F.transform("usable", lambda k: F.coalesce(F.try_element_at(F.col("past"), k)["n"], F.lit(0)))
    held = held.select("day", F.lpad(F.col("window").cast("string"), 2, "0").alias("entity"), F.coalesce("today.n", F.lit(0)).cast("double").alias("today"), median_of(was).cast("double").alias("usual"))
    moved = held.withColumn("by", F.col("today") - F.col("usual"))
    worst = moved.groupBy("day").agg(F.min(F.struct("by", "entity", "today", "usual")).alias("less"), F.max_by(F.struct("by", "entity", "today", "usual"), F.struct("by", -F.col("entity").cast("int"))).alias("more"))
    pick = lambda c: worst.select("day", F.lit(f"hours_{c}").alias("kind"), f"{c}.*")
    windows = pick("less").unionByName(pick("more")).filter((F.abs("by") >= t.hour_min) & (F.col("usual") > 0) & (F.abs("by") >= t.hour_share * F.col("usual"))).select(*COLUMNS)

    people = trips.filter("person is not null").groupBy(F.col("person").cast("string").alias("entity"), "day").agg(F.count("*").alias("n"), count(F.col("lost")).alias("lost"), F.coalesce(F.sum("fare"), F.lit(0)).cast("double").alias("fares"))
    back = looked_back(people, ["entity"], ["fares"]).join(usable.select("day"), "day").withColumn("past", F.transform(F.map_values("past"), lambda v: v["fares"]))
    regular = back.filter(F.size("past") >= t.regular_of_4).withColumn("usual", median_of(F.col("past"))).withColumn("y", F.col("today.fares"))
    down = regular.filter((F.col("usual") >= t.min_usual) & (F.col("y") <= F.col("usual") * (1 - t.drop_pct / 100))).select("day", F.lit("driver_down").alias("kind"), "entity", F.col("y").alias("today"), "usual")
    absent = regular.filter("y is null").select("day", F.lit("driver_absent").alias("kind"), "entity", F.lit(None).cast("double").alias("today"), "usual")
    open_ = people.filter((F.col("n") >= t.open_min) & (100 * F.col("lost") >= t.open_pct * F.col("n"))).select("day", F.lit("open_jobs").alias("kind"), "entity", F.col("lost").cast("double").alias("today"), F.col("n").cast("double").alias("usual"))

    order = Window.partitionBy("plate").orderBy("day")
    booked = trips.filter("plate is not null").select("plate", "day").distinct().withColumn("next", F.lead("day").over(order))
    last = F.date_add("day", t.idle_lookback)
    until = F.least(last, F.coalesce(F.date_sub("next", 1), last))
    idle = booked.filter(until >= F.date_add("day", t.idle_days)).select("plate", F.col("day").alias("since"), F.explode(F.sequence(F.date_add("day", t.idle_days), until)).alias("day"))
    idle = idle.join(usable.select("day"), "day").select("day", F.lit("car_idle").alias("kind"), F.col("plate").alias("entity"), F.datediff("day", "since").cast("double").alias("today"), F.lit(None).cast("double").alias("usual"))
    found = measures
    for part in (channels, windows, down, absent, open_, idle):
        found = found.unionByName(part)
    return found
