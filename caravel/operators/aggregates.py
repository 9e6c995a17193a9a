"""Roll-ups at several grains, folds, allocation of periods to days, cohorts, ageing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions import time



def trip_measures() -> list[Column]:
    """The measures of every roll-up. Distinct counts are taken at the grain, never summed."""
    booking = F.col("is_booking")
    only = lambda c: F.when(booking, c)
    count_if = lambda p: F.count(F.when(p, 1))
    money = F.sum(F.when(booking & F.col("has_fare"), F.col("price")))
    km = F.sum(F.when(booking & F.col("has_distance"), F.col("distance_km")))
    return [
        F.count("*").alias("trips"),
        count_if(booking).alias("bookings"),
        count_if(~booking).alias("telematics"),
        F.countDistinct(only(F.nullif("person_key", F.lit("")))).alias("drivers"),
        F.countDistinct("plate").alias("vehicles"),
        F.countDistinct(F.when(booking & F.col("has_fare") & (F.col("price") > 0), F.col("plate"))).alias("earning_vehicles"),
        count_if(booking & (F.col("person_key") != "")).alias("attributed_trips"),
        F.round(money, 2).cast("double").alias("revenue"),
        count_if(booking & F.col("has_fare")).alias("priced_trips"),
        F.round(km.cast("decimal(20,4)"), 1).cast("double").alias("km"),
        count_if(booking & F.col("has_distance")).alias("measured_trips"),
        count_if(F.col("outcome") == "completed").alias("completed"),
        count_if(F.col("outcome") == "not_completed").alias("not_completed"),
        F.count("outcome").alias("outcome_n"),
    ]


#: Of bucket, platform and fleet, what a roll-up's rows are taken over.
GRAINS = [["bucket", "platform", "fleet_id"], ["bucket", "platform"], ["bucket", "fleet_id"], ["bucket"]]


def grain_rollup(norm: DataFrame, grain: str, sets: list[list[str]] = GRAINS) -> DataFrame:
    """The measures by each of `sets`: bucket x platform x fleet, bucket x platform, bucket
    x fleet, and bucket. `*` is all of a dimension, `unknown` a real null in it.

    Rows are summed once by bucket, platform, fleet, person and car. Sums roll up from
    there; people and cars are made distinct at each set from those narrow rows.
    """
    keys = ["bucket", "platform", "fleet_id"]
    booking = F.col("is_booking")
    count_if = lambda p: F.count(F.when(p, 1))
    fare = booking & F.col("has_fare")
    rows = norm.filter("requested_at is not null").withColumn("bucket", time.bucket(grain, F.col("requested_at")))
    person = F.when(booking, F.nullif("person_key", F.lit(""))).alias("person")
    base = rows.groupBy(*keys, person, "plate").agg(
        F.count("*").alias("trips"),
        count_if(booking).alias("bookings"),
        count_if(~booking).alias("telematics"),
        count_if(booking & (F.col("person_key") != "")).alias("attributed_trips"),
        F.sum(F.when(fare, F.col("price"))).alias("revenue"),
        count_if(fare).alias("priced_trips"),
        F.sum(F.when(booking & F.col("has_distance"), F.col("distance_km"))).alias("km"),
        count_if(booking & F.col("has_distance")).alias("measured_trips"),
        count_if(F.col("outcome") == "completed").alias("completed"),
        count_if(F.col("outcome") == "not_completed").alias("not_completed"),
        F.count("outcome").alias("outcome_n"),
        F.max((fare & (F.col("price") > 0)).cast("int")).alias("earning"),
    )
    counts = [c for c in base.columns if c not in (*keys, "person", "plate", "revenue", "km", "earning")]
    which = (F.grouping("platform") * 2 + F.grouping("fleet_id")).alias("set")

    def at_sets(df: DataFrame, extra: list[str], *measures: Column) -> DataFrame:
        return df.groupingSets([[F.col(c) for c in [*s, *extra]] for s in sets], *keys, *extra).agg(which, *measures)

    fine = base.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in [*counts, "revenue", "km"]])
    sums = at_sets(fine, [], *[F.sum(c).alias(c) for c in counts], F.round(F.sum("revenue"), 2).cast("double").alias("revenue"), F.round(F.sum("km").cast("decimal(20,4)"), 1).cast("double").alias("km"))
    people = at_sets(base.filter("person is not null").select(*keys, "person").distinct(), ["person"]).groupBy(*keys, "set").agg(F.count("*").alias("drivers"))
    cars = base.filter("plate is not null").groupBy(*keys, "plate").agg(F.max("earning").alias("earning"))
    cars = at_sets(cars, ["plate"], F.max("earning").alias("earning")).groupBy(*keys, "set").agg(F.count("*").alias("vehicles"), F.sum("earning").alias("earning_vehicles"))
    found = sums
    for part in (people, cars):
        own = [F.col(c).alias(f"__{c}") for c in [*keys, "set"]]
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*keys, "set"]]
        found = found.join(part.select(*own, *part.columns[4:]), same, "left").drop(*[f"__{c}" for c in [*keys, "set"]])
    distinct = [F.coalesce(c, F.lit(0)).alias(c) for c in ("drivers", "vehicles", "earning_vehicles")]
    platform = F.when(F.col("set") >= 2, "*").otherwise(F.coalesce("platform", F.lit("unknown"))).alias("platform")
    fleet = F.when(F.col("set") % 2 == 1, "*").otherwise(F.coalesce("fleet_id", F.lit("unknown"))).alias("fleet")
    return found.select("bucket", platform, fleet, *counts, "revenue", "km", *distinct)


def fold_grain(days: DataFrame, grain: str, day: str = "bucket", by: tuple[str, ...] = ("platform", "fleet")) -> DataFrame:
    """Day rows as weeks or months: sums that stay null where every part is, the largest
    day for people (a floor: people are never summed), and whether days are missing.
    """
    first = F.to_date(F.date_trunc(grain, day))
    whole = F.lit(7) if grain == "week" else F.dayofmonth(F.last_day(first))
    sums = [F.sum(c).alias(c) for c in ("trips", "completed", "not_completed", "telematics", "priced_trips")]
    money = [F.round(F.sum(F.col(c).cast("decimal(24,2)")), 2).cast("double").alias(c) for c in ("km", "revenue")]
    found = days.groupBy(first.alias("first_day"), *by).agg(*sums, *money, F.max("drivers").alias("drivers_floor"), F.countDistinct(day).alias("days"))
    return found.withColumn("partial", F.col("days") < whole.cast("bigint") if grain == "week" else F.col("days") < F.dayofmonth(F.last_day("first_day")))


def period_to_days(periods: DataFrame, by: list[str], start: str, end: str, amount: str, newest: str) -> DataFrame:
    """An amount over a period as equal shares of its days. A day that several periods of
    the same `by` cover takes the shortest, then the newest, then the earliest one.

    Of the filings of one and the same period only the newest can be taken, so the others go
    in a hashed aggregate before any day is spread out.
    """
    latest = F.when(F.max(newest).isNull(), F.max(amount)).otherwise(F.max_by(amount, newest))
    spans = periods.groupBy(*by, start, end).agg(latest.alias(amount), F.max(newest).alias(newest))
    n = F.datediff(end, start) + 1
    days = spans.withColumn("period_days", n).withColumn("day", F.explode(F.sequence(start, end)))
    order = Window.partitionBy(*by, "day").orderBy("period_days", F.desc_nulls_last(newest), start)
    best = days.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return best.select(*by, "day", "period_days", (F.col(amount) / F.col("period_days")).alias("day_amount"))


def without_coarse(days: DataFrame, by: list[str]) -> DataFrame:
    """Longer periods' amounts go null with a reason where any one-day filing of the same
    `by` exists for that day; hours and rates beside them stay.
    """
    keys = [*by, "day"]
    daily = days.filter("period_days = 1").select(*[F.col(c).alias(f"__{c}") for c in keys]).distinct().withColumn("__daily", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    coarse = (F.col("period_days") > 1) & F.col("__daily").isNotNull()
    joined = days.join(daily, same, "left").select(*days.columns, "__daily")
    return joined.withColumn("reason", F.when(coarse, "daily_filing_exists")).withColumn("day_amount", F.when(~coarse, F.col("day_amount"))).drop("__daily")


def weighted_shares(rows: DataFrame, period: list[str], weight: str, amount: str) -> DataFrame:
    """An amount of a period shared by weight, evenly where all weights are zero. Shares
    are of the whole period: filter days afterwards.
    """
    all_ = Window.partitionBy(*period)
    total, n = F.sum(weight).over(all_), F.count("*").over(all_)
    share = F.when(total > 0, F.col(weight) / total).otherwise(1 / n)
    return rows.withColumn("share", share).withColumn("allocated", F.col(amount) * F.col("share")).withColumn("basis", F.when(total > 0, "trips").otherwise("even"))


def cohorts(activity: DataFrame, person: str, month: str) -> DataFrame:
    """cohort (first month), offset, retained people; the first cohort is left-censored."""
    active = activity.select(F.col(person).alias("person"), F.col(month).alias("month")).filter("person is not null").distinct()
    first = active.groupBy("person").agg(F.min("month").alias("cohort"))
    joined = active.join(first, "person").withColumn("offset", F.months_between("month", "cohort").cast("int"))
    found = joined.groupBy("cohort", "offset").agg(F.count("*").alias("retained"))
    began = activity.agg(F.min(month).alias("began"))  # one row
    return found.crossJoin(F.broadcast(began)).select("cohort", "offset", "retained", (F.col("cohort") == F.col("began")).alias("left_censored"))


def flow(activity: DataFrame, person: str, month: str) -> DataFrame:
    """People who joined (first month), returned (after a gap), stayed and left (not in
    the next month) by month.
    """
    active = activity.select(F.col(person).alias("person"), F.col(month).alias("month")).filter("person is not null").distinct()
    order = Window.partitionBy("person").orderBy("month")
    seen = active.withColumn("before", F.lag("month").over(order)).withColumn("after", F.lead("month").over(order))
    count_if = lambda p: F.count(F.when(p, 1))
    gap = F.col("before") < F.add_months("month", -1)
    return seen.groupBy("month").agg(
        F.count("*").alias("active"),
        count_if(F.col("before").isNull()).alias("joined"),
        count_if(gap).alias("returned"),
        count_if(F.col("after").isNull() | (F.col("after") > F.add_months("month", 1))).alias("left"),
    )


def ageing(rows: DataFrame, at: Column, day: str, amount: str, party: list[str]) -> DataFrame:
    """Open amounts by age in days: 0-30, 31-60, 61-90, 91+."""
    age = F.datediff(at, day)
    bucket = F.when(age <= 30, "0-30").when(age <= 60, "31-60").when(age <= 90, "61-90").otherwise("91+")
    return rows.filter(age >= 0).groupBy(bucket.alias("age")).agg(
        F.count("*").alias("trips"), F.round(F.sum(amount), 2).cast("double").alias("amount"), F.countDistinct(F.struct(*party)).alias("parties")
    )


def source_coverage(events: DataFrame, source: str, day: str) -> DataFrame:
    """For each calendar day in a source's span: its rows, and whether it was silent (no
    rows although its median day has some). Days all of whose sources are silent are
    `uncollected`.
    """
    counts = events.groupBy(F.col(source).alias("source"), F.col(day).alias("day")).agg(F.count("*").alias("n"))
    spans = counts.groupBy("source").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.percentile("n", F.lit(0.5)).alias("median"))
    spine = spans.withColumn("day", F.explode(F.sequence("first", "last")))
    joined = spine.join(counts, ["source", "day"], "left").select("source", "day", F.coalesce("n", F.lit(0)).alias("n"), "median")
    silent = (F.col("n") == 0) & (F.col("median") > 0)
    return joined.withColumn("silent", silent).withColumn("uncollected", F.min("silent").over(Window.partitionBy("day")))


def modal(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of each key (ties by value), its votes, all votes and the
    number of distinct values.
    """
    tally = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("votes"))
    best = Window.partitionBy(*key).orderBy(F.desc("votes"), value)
    all_ = Window.partitionBy(*key)
    named = tally.withColumn("n", F.sum("votes").over(all_)).withColumn("distinct_names", F.count("*").over(all_))
    return named.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")


def statement_fold(components: DataFrame, period: list[str]) -> DataFrame:
    """Earnings components (category, parent, amount) as one row a period: net, gross,
    tips, tolls, cash, fees; root_priced says whether its root has an amount. Missing
    categories are null, not zero.
    """
    of = lambda *names: F.sum(F.when(F.col("category").isin(*names), F.col("amount")))
    inside = lambda name: F.sum(F.when((F.col("category") == name) & (F.col("parent") == "your_earnings"), F.col("amount")))
    net = F.coalesce(of("your_earnings") - F.coalesce(inside("tip"), F.lit(0)) - F.coalesce(inside("taxes"), F.lit(0)), of("net_fare"))
    return components.groupBy(*period).agg(
        net.alias("net"), of("fare").alias("gross"), of("tip").alias("tips"), of("toll").alias("tolls"), (-of("cash_collected")).alias("cash"), (-of("service_fee")).alias("fees"),
        of("your_earnings").isNotNull().alias("root_priced"),
    )
