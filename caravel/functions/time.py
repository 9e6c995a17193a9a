"""Local time, calendars, periods and hour slices. One clock: UTC+4 without daylight
saving, for every day, hour and week.
"""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OFFSET = "INTERVAL '4' HOUR"


def local(ts: Column) -> Column:
    return ts + F.expr(OFFSET)


def local_day(ts: Column) -> Column:
    return F.to_date(local(ts))


def local_hour(ts: Column) -> Column:
    return F.hour(local(ts))


def local_dow(ts: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(local(ts)) - 1


def bucket(grain: str, ts: Column) -> Column:
    """The first local day of the day, ISO week or month."""
    return F.to_date(F.date_trunc(grain, local(ts)))


def minute_of_day(ts: Column) -> Column:
    return F.hour(local(ts)) * 60 + F.minute(local(ts))


def end_minute(start: Column, end: Column) -> Column:
    """The minute a job ends on its start's local day: 1440 past midnight, never before it."""
    return F.when(local_day(end) > local_day(start), 1440).otherwise(F.greatest(minute_of_day(end), minute_of_day(start)))


def daypart(hour: Column) -> Column:
    return F.when(hour < 5, "night").when(hour < 10, "morning").when(hour < 15, "midday").when(hour < 20, "evening").when(hour.isNotNull(), "late")


def span_filter(ts: Column, lo: date, hi: date) -> Column:
    """Local days lo..hi as a half-open range on the stored instant, which prunes."""
    first, after = f"TIMESTAMP_NTZ '{lo} 00:00:00'", f"TIMESTAMP_NTZ '{hi + timedelta(days=1)} 00:00:00'"
    return (ts >= F.expr(f"{first} - {OFFSET}")) & (ts < F.expr(f"{after} - {OFFSET}"))


def calendar(bounds: DataFrame, lo: str, hi: str, step: str = "1 DAY", out: str = "day") -> DataFrame:
    """One row for each step between two columns of a one-row (or few-row) frame."""
    return bounds.select(F.explode(F.expr(f"sequence({lo}, {hi}, INTERVAL {step})")).alias(out))


def hour_slices(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A span cut at local hours: hour_at and minutes (2 dp); slices under 0.005 go."""
    first = F.date_trunc("hour", F.col(start)).cast("timestamp_ntz")
    last = F.date_trunc("hour", F.col(end)).cast("timestamp_ntz")
    cut = spans.withColumn("hour_at", F.explode(F.sequence(first, last, F.expr("INTERVAL '1' HOUR"))))
    until = F.least(F.col(end), F.col("hour_at") + F.expr("INTERVAL '1' HOUR"))
    minutes = F.unix_micros(until.cast("timestamp")) - F.unix_micros(F.greatest(F.col(start), F.col("hour_at")).cast("timestamp"))
    return cut.withColumn("minutes", F.round(F.least(F.greatest(minutes, F.lit(0)).cast("decimal(20,0)") / 60_000_000, F.lit(60)), 2).cast("double")).filter("minutes >= 0.005")


def period_window(name: str, today: date) -> tuple[date, date]:
    """The days of a named period, no later than today: today, yesterday, week,
    month, quarter, year (all to date; this_week ... mean the same), last_week, last_month,
    last_7_days ..., YYYY, YYYY-MM, YYYY-Qn.
    """
    monday, first = today - timedelta(days=today.weekday()), today.replace(day=1)
    name = name.removeprefix("this_")
    if m := re.fullmatch(r"last_(\d+)_days", name):
        return today - timedelta(days=int(m[1]) - 1), today
    named = {
        "today": (today, today),
        "yesterday": (today - timedelta(days=1),) * 2,
        "week": (monday, today),
        "last_week": (monday - timedelta(days=7), monday - timedelta(days=1)),
        "month": (first, today),
        "last_month": ((first - timedelta(days=1)).replace(day=1), first - timedelta(days=1)),
        "quarter": (date(today.year, (today.month - 1) // 3 * 3 + 1, 1), today),
        "year": (date(today.year, 1, 1), today),
    }
    if name in named:
        return named[name]
    if m := re.fullmatch(r"(\d{4})(?:-(\d{2})|-Q([1-4]))?", name):
        year, month, quarter = int(m[1]), m[2], m[3]
        a = int(month) if month else 3 * int(quarter) - 2 if quarter else 1
        n = 1 if month else 3 if quarter else 12
        end = date(year + (a + n - 1) // 12, (a + n - 1) % 12 + 1, 1) - timedelta(days=1)
        return date(year, a, 1), min(end, today)
    raise ValueError(name)


def resolve_period(said: str, today: date) -> tuple[date, date] | None:
    """Days from plain words: 'last 10 days', 'march 2024', 'since yesterday', 'q2 2023'."""
    words = re.sub(r"\s+", " ", said.lower()).strip()
    months = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    if m := re.search(r"(\d{4}-\d{2}-\d{2})\s*(?:to|until|-|\.\.)\s*(\d{4}-\d{2}-\d{2})", words):
        return date.fromisoformat(m[1]), date.fromisoformat(m[2])
    if m := re.search(r"(?:last|past) (\d+) (day|week|month)s?", words):
        return today - timedelta(days=int(m[1]) * {"day": 1, "week": 7, "month": 30}[m[2]] - 1), today
    if m := re.search(r"q([1-4]) ?(\d{4})", words):
        return period_window(f"{m[2]}-Q{m[1]}", today)
    if m := re.search(rf"({'|'.join(months)})[a-z]* ?(\d{{4}})?", words):
        number = months.index(m[1]) + 1
        year = int(m[2]) if m[2] else today.year - (number > today.month)
        return period_window(f"{year}-{number:02d}", today)
    for phrase in ("this week", "last week", "this month", "last month", "this year", "today", "yesterday"):
        if phrase in words:
            lo, hi = period_window(phrase.replace(" ", "_"), today)
            return (lo, today) if words.startswith("since") else (lo, hi)
    return None


def previous_window(lo: date, hi: date) -> tuple[date, date]:
    """The span of the same length before."""
    n = (hi - lo).days + 1
    return lo - timedelta(days=n), lo - timedelta(days=1)


def auto_grain(lo: date, hi: date) -> str:
    days = (hi - lo).days + 1
    return "day" if days <= 45 else "week" if days <= 300 else "month"


def date_chunks(lo: date, hi: date, days: int = 31) -> list[tuple[date, date]]:
    return [(a, min(a + timedelta(days=days - 1), hi)) for a in (lo + timedelta(days=i) for i in range(0, (hi - lo).days + 1, days))]


def week_chunks(lo: date, hi: date, today: date) -> list[tuple[date, date]]:
    """The closed ISO weeks that the span touches."""
    monday = lo - timedelta(days=lo.weekday())
    weeks = [monday + timedelta(days=7 * i) for i in range((hi - monday).days // 7 + 1)]
    return [(w, w + timedelta(days=6)) for w in weeks if w + timedelta(days=6) < today]


#: A new year of the calendar, from which its months are counted.
HIJRI_ANCHOR = (1446, "2024-07-07")


def hijri_days(spark: SparkSession, years: tuple[int, int] = (1400, 1500)) -> DataFrame:
    """day, year, month, hijri_day of the Umm al-Qura calendar, as the JVM knows it: a month
    has a day 30 if the JVM can name that day.
    """
    lo, hi = years
    months = spark.range(lo * 12, (hi + 1) * 12).select((F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    thirtieth = F.try_reflect(F.lit("java.time.chrono.HijrahDate"), F.lit("of"), F.col("year"), F.col("month"), F.lit(30))
    # a row a month of a hundred years
    order = Window.orderBy("year", "month")
    counted = months.withColumn("days", F.when(thirtieth.isNull(), 29).otherwise(30)).withColumn("after", F.sum("days").over(order))
    year, day = HIJRI_ANCHOR
    zero = F.max(F.when((F.col("year") == year) & (F.col("month") == 1), F.col("after") - F.col("days"))).over(Window.partitionBy(F.lit(1)))
    first = F.date_add(F.to_date(F.lit(day)), (F.col("after") - F.col("days") - zero).cast("int"))
    spread = counted.withColumn("first", first).select("year", "month", "first", F.explode(F.sequence(F.lit(1), F.col("days"))).alias("hijri_day"))
    return spread.select(F.date_add("first", F.col("hijri_day") - 1).alias("day"), "year", "month", "hijri_day")


def calendar_days(spark: SparkSession, lo: date, hi: date) -> DataFrame:
    """The calendar dimension: day, hijri year, month and day, whether it is in Ramadan (month 9)."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(DATE '{lo}', DATE '{hi}')")).alias("day"))
    return days.join(hijri_days(spark), "day", "left").withColumn("is_ramadan", F.col("month") == 9)
