"""Monthly forecasts: a recent regime, its trend, a seasonal ratio, and their back-test.

A series has one row a month. Everything is windows and aggregates over (series, month),
so a series is never gathered and thousands run side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions.stats import t95

SCATTER, LEAST_MONTHS, BEATS_FLAT, K = 0.35, 3, 0.5, 3


def regimes(months: DataFrame, by: list[str], month: str, value: str) -> DataFrame:
    """`by` and n, how many of the newest months of each series one line describes: three,
    and further back month by month until the scatter around the line is over 0.35 of the
    mean. Series of fewer than three months have none.
    """
    newest = Window.partitionBy(*by).orderBy(F.desc(month))
    so_far = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, y = F.row_number().over(newest) - 1, F.col(value).cast("double")
    rows = months.select(*by, month, x.alias("x"), y.alias("y"))
    n, sy = F.col("x") + 1, F.sum("y").over(so_far)
    sxx = n * (n * n - 1) / 12
    sxy = F.sum(F.col("x") * F.col("y")).over(so_far) - F.col("x") / 2 * sy
    syy = F.sum(F.col("y") * F.col("y")).over(so_far) - sy * sy / n
    off = F.sqrt(F.greatest(syy - sxy * sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0)) / F.nullif(n - 2, F.lit(0)))
    scatter = F.when((n > 2) & (sy > 0), off * n / sy)
    breaks = (n > LEAST_MONTHS) & (scatter.isNull() | (scatter > SCATTER))
    found = rows.select(*by, n.alias("n"), F.when(breaks, n).alias("broken"))
    lengths = found.groupBy(*by).agg(F.coalesce(F.min("broken") - 1, F.max("n")).alias("n"))
    return lengths.filter(F.col("n") >= LEAST_MONTHS)


def hundred(v: Column) -> Column:
    return F.floor(v / 100 + 0.5) * 100.0


def fits(months: DataFrame, by: list[str], month: str, value: str) -> DataFrame:
    """The line through each series' regime: n, base (its first month), slope, intercept, r2,
    s (residual error), x_mean, sxx (x: months since base), flat (mean of its last three).
    """
    newest = Window.partitionBy(*by).orderBy(F.desc(month))
    ranked = months.select(*by, month, F.col(value).cast("double").alias("y"), F.row_number().over(newest).alias("__r"))
    used = ranked.join(regimes(months, by, month, value), by).filter(F.col("__r") <= F.col("n"))
    used = used.withColumn("base", F.min(month).over(Window.partitionBy(*by))).withColumn("x", F.round(F.months_between(month, "base")))
    line = used.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("base").alias("base"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.avg("x").alias("x_mean"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"),
        F.avg(F.when(F.col("__r") <= 3, F.col("y"))).alias("flat"),
    )
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.nullif("sxx", F.lit(0.0)), F.lit(0.0))
    return line.withColumn("s", F.sqrt(left / F.nullif(F.col("n") - 2, F.lit(0))))


def forecasts(months: DataFrame, by: list[str], month: str, value: str, horizon: int = 6, usable: Column | None = None) -> DataFrame:
    """The next `horizon` months after each series' newest: value, low, high and flat in
    hundreds (value and low at least 0), kind (forecast for three months, then
    extrapolation), beats_flat, regime_months. Months that are not `usable` (partial, no
    data) are neither fitted nor forecast.
    """
    whole = months if usable is None else months.filter(usable)
    anchor = months.groupBy(*by).agg(F.max(month).alias("__last"))
    ahead = fits(whole, by, month, value).join(anchor, by).withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = ahead.withColumn("month", F.add_months("__last", F.col("ahead"))).withColumn("x", F.round(F.months_between("month", "base")))
    point = F.greatest(F.col("intercept") + F.col("slope") * F.col("x"), F.lit(0.0))
    half = t95(F.col("n") - 2) * F.col("s") * F.sqrt(1 + 1 / F.col("n") + F.pow(F.col("x") - F.col("x_mean"), 2) / F.col("sxx"))
    return ahead.select(
        *by,
        "month",
        hundred(point).alias("value"),
        F.greatest(hundred(point - half), F.lit(0.0)).alias("low"),
        hundred(point + half).alias("high"),
        hundred(F.col("flat")).alias("flat"),
        F.when(F.col("ahead") <= 3, "forecast").otherwise("extrapolation").alias("kind"),
        F.coalesce((F.col("s").isNotNull()) & (F.col("r2") >= BEATS_FLAT), F.lit(False)).alias("beats_flat"),
        F.col("n").alias("regime_months"),
    )


def back_test(months: DataFrame, by: list[str], month: str, value: str, steps: int = 6) -> DataFrame:
    """For each series and model, tests and mae (mean absolute error) over the last `steps`
    months, each forecast from the months before it alone: trend, seasonal (last year's
    month times the mean of the last three year-on-year ratios), naive (the month before).
    """
    newest = Window.partitionBy(*by).orderBy(F.desc(month))
    tested = months.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= steps).select(*by, F.col(month).alias("__cut"), F.col(value).alias("actual"))
    # each series once for each of `steps` cuts
    past = months.join(tested.select(*by, "__cut"), by).filter(F.col(month) < F.col("__cut"))
    line = forecasts(past, [*by, "__cut"], month, value, 1).select(*by, "__cut", F.col("value").alias("trend"))
    order = Window.partitionBy(*by).orderBy(month)
    ratio = F.col(value) / F.nullif(F.lag(value, 12).over(order), F.lit(0.0))
    rated = months.withColumn("__ratio", ratio).withColumn("__year", F.lag(value, 12).over(order)).withColumn("naive", F.lag(value).over(order))
    recent = order.rowsBetween(-K, -1)
    seasonal = F.greatest(F.when(F.count("__ratio").over(recent) == K, F.col("__year") * F.avg("__ratio").over(recent)), F.lit(0.0))
    seasonal = F.when(F.count("__ratio").over(recent) == K, seasonal)
    others = rated.select(*by, F.col(month).alias("__cut"), "naive", seasonal.alias("seasonal"))
    all_models = tested.join(others, [*by, "__cut"]).join(line, [*by, "__cut"], "left")
    models = ("trend", "seasonal", "naive")
    error = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.abs(F.col(m) - F.col("actual")).alias("error")) for m in models])).alias("e")
    return all_models.select(*by, error).groupBy(*by, F.col("e.model").alias("model")).agg(F.count("e.error").alias("tests"), F.avg("e.error").alias("mae"))


def seasonal_ratio(months: DataFrame, by: list[str], month: str, value: str) -> DataFrame:
    """Year-on-year ratio of each month to the same month of the year before, and the mean
    of the last three ratios. Months are matched by date, so holes stay holes.
    """
    before = months.select(*by, F.add_months(month, 12).alias(month), F.col(value).alias("last_year"))
    ratio = months.join(before, [*by, month], "left").withColumn("ratio", F.col(value) / F.nullif("last_year", F.lit(0)))
    recent = Window.partitionBy(*by).orderBy(month).rowsBetween(-(K - 1), 0)
    return ratio.withColumn("mean_ratio", F.when(F.count("ratio").over(recent) == K, F.avg("ratio").over(recent)))


def weekday_weights(days: DataFrame, day: str, value: str, until, weeks: int = 8, least: int = 4) -> DataFrame:
    """dow (0 is Monday), weight: mean share of each weekday over the last whole weeks
    that end two days before `until` or earlier, normalised to mean 1 (4 dp). A week with
    a day under 40 % of its mean is left out; fewer than four weeks give no rows.
    """
    monday = F.to_date(F.date_trunc("week", day))
    rows = days.withColumn("week", monday).filter(F.date_add("week", 6) <= F.date_sub(until, 2)).filter(F.col("week") > F.date_sub(until, 7 * (weeks + 1) + 2))
    whole = rows.groupBy("week").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.avg(value).alias("mean")).filter("n = 7 and low >= 0.4 * mean")
    used = rows.join(F.broadcast(whole.select("week", "mean")), "week")  # at most `weeks` rows
    shares = used.groupBy(F.weekday(day).alias("dow")).agg(F.avg(F.col(value) / F.nullif("mean", F.lit(0))).alias("w"), F.count("*").alias("weeks"))
    every = Window.partitionBy("__all")
    scaled = shares.withColumn("__all", F.lit(1)).withColumn("weight", F.round(F.col("w") / F.avg("w").over(every), 4))
    return scaled.filter(F.col("weeks") >= least).select("dow", "weight", "weeks")


def target_month(days: DataFrame, day: str, earned: str, target: str, weight: str) -> DataFrame:
    """Each day of a month with its plan (target by weekday weight), what is earned so far,
    what the days left need, and the pace (earned so far over planned so far).
    """
    month = Window.partitionBy(F.date_trunc("month", day))
    so_far = month.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = days.withColumn("plan", F.col(target) * F.col(weight) / F.sum(weight).over(month))
    rows = rows.withColumn("earned_so_far", F.sum(earned).over(so_far)).withColumn("plan_so_far", F.sum("plan").over(so_far))
    left = F.sum(weight).over(month) - F.sum(weight).over(so_far)
    need = F.greatest(F.col(target) - F.col("earned_so_far"), F.lit(0.0))
    return rows.withColumn("needed_per_weight", need / F.nullif(left, F.lit(0.0))).withColumn("pace", F.col("earned_so_far") / F.nullif("plan_so_far", F.lit(0.0)))


def breaks(months: DataFrame, by: list[str], month: str, trips: str, drivers: str, least_change: float = 0.30, least_trips: int = 20) -> DataFrame:
    """Months of a series whose trips differ from the month's before by `least_change` or
    more, if either has `least_trips`: change, driver_change, productivity_change and cause.

    The cause is supply if the number of drivers changed over twice as much as the trips of
    each, demand if it is the other way round, else mixed; unattributable if a month has no
    known driver. Months that do not follow each other are no break.
    """
    order = Window.partitionBy(*by).orderBy(month)
    before = lambda c: F.lag(c).over(order)
    rows = months.withColumns({"__month": before(month), "__trips": before(trips), "__drivers": before(drivers)})
    change = (F.col(trips) - F.col("__trips")) / F.col("__trips")
    known = (F.col("__drivers") > 0) & (F.col(drivers) > 0)
    moved = F.when(known, (F.col(drivers) - F.col("__drivers")) / F.col("__drivers"))
    each = F.when(known, (F.col(trips) / F.col(drivers)) / (F.col("__trips") / F.col("__drivers")) - 1)
    rows = rows.filter(F.col(month) == F.add_months("__month", 1)).filter((F.col(trips) >= least_trips) | (F.col("__trips") >= least_trips))
    rows = rows.withColumns({"change": change, "driver_change": moved, "productivity_change": each}).filter(F.abs("change") >= least_change)
    demand, supply = F.abs("productivity_change"), F.abs("driver_change")
    cause = F.when(supply.isNull(), "unattributable").when(demand > 2 * supply, "demand").when(supply > 2 * demand, "supply").otherwise("mixed")
    return rows.withColumn("cause", cause).drop("__month", "__trips", "__drivers")


def like_for_like(months: DataFrame, by: list[str], month: str, channel: str, value: str, horizon: int = 12, k: int = 3) -> DataFrame:
    """The next `horizon` months of each series of whole `months` (by, month, channel, value;
    a row where a channel ran), from the same months a year before: base, base_like, carry,
    value, low and high (hundreds, at least 0), ratio, base_after (the base month is one of
    the newest year's already compared months).

    A month over the month a year before is a ratio of the channels that ran in both; the
    mean of the newest `k` ratios, with its 95 % t-interval for a new one, is applied to the
    base's channels that still run. A channel that runs now but not in the base month adds
    the mean of all months it ran, rounded, as `carry`. Series of fewer than `k` ratios have
    no rows; a month whose base is missing has null figures.
    """
    rows = months.groupBy(*by, F.col(month).alias("month"), F.col(channel).alias("channel")).agg(F.sum(value).cast("double").alias("y")).filter("y > 0")
    year = rows.select(*by, F.add_months("month", 12).alias("month"), "channel", F.col("y").alias("before"))
    pairs = rows.join(year, [*by, "month", "channel"]).groupBy(*by, "month").agg((F.sum("y") / F.sum("before")).alias("ratio"))
    newest = Window.partitionBy(*by).orderBy(F.desc("month"))
    used = pairs.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= k)
    fit = used.groupBy(*by).agg(F.avg("ratio").alias("ratio"), F.stddev_samp("ratio").alias("sd"), F.count("*").alias("n"), F.min("month").alias("compared_from")).filter(F.col("n") >= k)
    last = rows.groupBy(*by).agg(F.max("month").alias("last"))
    live = rows.join(last, by).filter("month = last").select(*by, "channel")
    runs = rows.join(live, [*by, "channel"]).groupBy(*by, "channel").agg(F.round(F.avg("y")).alias("mean"))
    ahead = fit.join(last, by).withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    ahead = ahead.withColumn("month", F.add_months("last", F.col("ahead"))).withColumn("base_month", F.add_months("month", -12))
    whole = rows.groupBy(*by, F.col("month").alias("base_month")).agg(F.sum("y").alias("base"))
    like = rows.join(live, [*by, "channel"]).groupBy(*by, F.col("month").alias("base_month")).agg(F.sum("y").alias("base_like"))
    # every running channel beside each month ahead: months x channels of a series
    beside = ahead.select(*by, "base_month").join(runs, by).join(rows.select(*by, F.col("month").alias("base_month"), "channel", F.lit(True).alias("ran")), [*by, "base_month", "channel"], "left")
    carry = beside.groupBy(*by, "base_month").agg(F.coalesce(F.sum(F.when(F.col("ran").isNull(), F.col("mean"))), F.lit(0.0)).alias("carry"))
    for part in (whole, like, carry):
        ahead = ahead.join(part, [*by, "base_month"], "left")
    known = F.col("base").isNotNull()
    like_ = F.coalesce("base_like", F.lit(0.0))
    half = t95(F.col("n") - 1) * F.col("sd") * F.sqrt(1 + 1 / F.col("n"))
    at = lambda r: F.when(known, hundred(F.greatest(like_ * r + F.col("carry"), F.lit(0.0))))
    return ahead.select(
        *by, "month", "base_month", "base", F.when(known, like_).alias("base_like"), F.when(known, F.col("carry")).alias("carry"), at(F.col("ratio")).alias("value"),
        at(F.col("ratio") - half).alias("low"), at(F.col("ratio") + half).alias("high"), "ratio", (F.col("base_month") >= F.col("compared_from")).alias("base_after"),
    )
