"""People held against everyone else: medians and sums without the person's own figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def middles(rows: DataFrame, values: list[str]) -> DataFrame:
    """value, n and the three values around the middle (v0, v1, v2: of rank (n - 1) // 2 and
    the two after it, null where there is none) for each column in `values`; nulls are left out.

    Values are counted in equal buckets between the least and the largest; only the buckets
    that hold the wanted ranks are looked at value by value. No column is sorted as a whole.
    """
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("value"), F.col(c).cast("double").alias("x")) for c in values])).alias("v"))
    stacked = stacked.select("v.value", "v.x").filter("x is not null")
    # a row for each column
    bounds = stacked.groupBy("value").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    width = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    placed = stacked.join(F.broadcast(bounds), "value").withColumn("bucket", F.coalesce(F.floor((F.col("x") - F.col("low")) / width * BUCKETS), F.lit(0)))
    counts = placed.groupBy("value", "n", "bucket").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("value").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.floor((F.col("n") - 1) / 2)
    near = counts.withColumn("upto", upto).filter((F.col("upto") >= first) & (F.col("upto") - F.col("k") < first + 2)).select("value", "bucket", (F.col("upto") - F.col("k")).alias("before"))
    exact = placed.join(F.broadcast(near), ["value", "bucket"]).groupBy("value", "n", "bucket", "before", "x").agg(F.count("*").alias("k"))
    within = F.sum("k").over(Window.partitionBy("value", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = exact.withColumn("upto", F.col("before") + within).withColumn("first", first)
    at = lambda i: F.min(F.when((F.col("first") + i >= 1) & (F.col("first") + i <= F.col("n")) & (F.col("upto") >= F.col("first") + i), F.col("x"))).alias(f"v{i}")
    return ranked.groupBy("value", "n").agg(at(0), at(1), at(2))


def median_of_others(x: Column, n: Column, v0: Column, v1: Column, v2: Column) -> Column:
    """The median of all values but one `x` of them; of all if `x` is null, null if there is
    no other.
    """
    even, odd = F.when(x <= v1, v2).otherwise(v1), F.when(x <= v0, (v1 + v2) / 2).when(x >= v2, (v0 + v1) / 2).otherwise((v0 + v2) / 2)
    everyone = F.when(n % 2 == 0, (v1 + v2) / 2).otherwise(v1)
    return F.when(x.isNull(), everyone).when(n > 1, F.when(n % 2 == 0, even).otherwise(odd))


MEASURES = ["off_share", "hours_day", "money_hour", "trips_day", "start", "abandon_share"]


def low_performers(days: DataFrame, target: float, end: Column, least_days: int = 3, points: float = 10) -> DataFrame:
    """Per person of `days` (person, day, active, hours, money, trips, start, accepted,
    abandoned): measures, others' medians (rest_...), causes, and the trend.

    Rates are of people with `least_days` driven days. A cause is named where a measure is
    plainly off what the median of everyone else is. The trend compares the week up to `end`
    with the week before, in per cent of a target for each active day, less the change of
    everyone else: improving, slipping or steady from `points` on; null where the person was
    active on fewer than `least_days` days of a week, or nobody else was.
    """
    count = lambda p: F.count(F.when(p, 1))
    age = F.datediff(end, "day")
    week = lambda lo, what: F.sum(F.when((age >= lo) & (age < lo + 7) & F.col("active"), what))
    per = days.groupBy("person").agg(
        count(F.col("active")).alias("driven"), count(~F.col("active")).alias("off"), *[F.sum(c).alias(c) for c in ("hours", "money", "trips", "accepted", "abandoned")],
        F.percentile(F.when(F.col("active"), F.col("start")), F.lit(0.5)).alias("start"),
        *[F.coalesce(week(lo, what), F.lit(0)).alias(f"{name}_{i}") for i, lo in ((1, 0), (0, 7)) for name, what in (("gross", F.col("money")), ("days", F.lit(1)))],
    )
    enough = F.col("driven") >= least_days
    per = per.withColumns({
        "off_share": 100 * F.col("off") / (F.col("off") + F.col("driven")), "hours_day": F.when(enough, F.col("hours") / F.col("driven")), "money_hour": F.when(enough & (F.col("hours") > 0), F.col("money") / F.col("hours")),
        "trips_day": F.when(enough, F.col("trips") / F.col("driven")), "start": F.when(enough, F.col("start")), "abandon_share": F.when(F.col("accepted") > 0, 100 * F.col("abandoned") / F.col("accepted")),
    })
    whole = per.agg(*[F.sum(f"{c}_{i}").alias(f"all_{c}_{i}") for c in ("gross", "days") for i in (0, 1)])  # one row
    mid = middles(per, MEASURES).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("n", "v0", "v1", "v2")))).alias("mid"))  # one row of six
    joined = per.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(mid))
    rest = {f"rest_{m}": median_of_others(F.col(m), *[F.col("mid")[m][c] for c in ("n", "v0", "v1", "v2")]) for m in MEASURES}
    rows = joined.withColumns(rest)
    c = F.col
    short = c("hours_day") < 0.75 * c("rest_hours_day")
    causes = F.array_compact(F.array(
        F.when((c("driven") == 0) | (c("off_share") >= F.greatest(F.lit(25.0), 2 * F.coalesce(c("rest_off_share"), F.lit(0.0)))), "days_off"),
        F.when(short, "short_days"),
        F.when(c("money_hour") < 0.85 * c("rest_money_hour"), "low_rate"),
        F.when(short & (c("start") >= c("rest_start") + 120), "late_start"),
        F.when(c("trips_day") < 0.75 * c("rest_trips_day"), "few_trips"),
        F.when((c("abandoned") >= 3) & (c("abandon_share") >= F.greatest(F.lit(5.0), 2 * F.coalesce(c("rest_abandon_share"), F.lit(0.0)))), "abandons"),
    ))
    pct = lambda gross, n: 100 * gross / F.nullif(target * n, F.lit(0.0))
    own = [pct(c(f"gross_{i}"), c(f"days_{i}")) for i in (0, 1)]
    others = [pct(c(f"all_gross_{i}") - c(f"gross_{i}"), c(f"all_days_{i}") - c(f"days_{i}")) for i in (0, 1)]
    said = (c("days_0") >= least_days) & (c("days_1") >= least_days)
    relative = F.when(said, (own[1] - own[0]) - (others[1] - others[0]))
    trend = F.when(relative >= points, "improving").when(relative <= -points, "slipping").when(relative.isNotNull(), "steady")
    return rows.select("person", "driven", *MEASURES, *rest, causes.alias("causes"), relative.alias("relative"), trend.alias("trend"))
