"""Spans from events: islands, merged durations, waits, supersession, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions import time
from caravel.operators.joins import overlaps


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def minutes_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(60_000_000)


BEFORE = (Window.unboundedPreceding, -1)


def merge_spans(spans: DataFrame, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of a key as islands: start, end, pieces."""
    order = Window.partitionBy(*key).orderBy(start, end)
    opens = (F.col(start) > F.max(end).over(order.rowsBetween(*BEFORE))).cast("int")
    marked = spans.withColumn("__opens", F.coalesce(opens, F.lit(1)))
    grouped = marked.withColumn("__island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(*key, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("pieces")).drop("__island")


def gap_islands(events: DataFrame, key: list[str], at: str, gap_minutes: float) -> DataFrame:
    """Runs of events no further apart than the gap: first, last, n."""
    order = Window.partitionBy(*key).orderBy(at)
    breaks = F.coalesce((minutes_between(F.lag(at).over(order), F.col(at)) > gap_minutes).cast("int"), F.lit(1))
    run = F.sum("__break").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    marked = events.withColumn("__break", breaks).withColumn("run", run)
    return marked.groupBy(*key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def waits(jobs: DataFrame, key: list[str], start: str, end: str, *more: Column) -> DataFrame:
    """Minutes of waiting between jobs (number columns): each start less the running
    maximum of the ends before it, so that overlapping jobs don't count as waiting.
    `more` are further aggregates of the jobs of a key.
    """
    order = Window.partitionBy(*key).orderBy(start, end)
    wait = F.greatest(F.col(start) - F.max(end).over(order.rowsBetween(*BEFORE)), F.lit(0))
    each = jobs.withColumn("__wait", wait)
    return each.groupBy(*key).agg(
        F.count("*").alias("jobs"),
        F.coalesce(F.sum("__wait"), F.lit(0)).alias("wait"),
        F.coalesce(F.max("__wait"), F.lit(0)).alias("longest_wait"),
        (F.max(end) - F.min(start)).alias("span"),
        F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0))).alias("on_job"),
        *more,
    )


def online_spans(events: DataFrame, key: list[str], at: str, status: str, online: list[str], close: Column) -> DataFrame:
    """Spans that an online event opens and the next event of any kind closes; the last of
    a key closes at `close`. Overlaps are merged.
    """
    order = Window.partitionBy(*key).orderBy(at)
    spans = events.withColumn("end", F.coalesce(F.lead(at).over(order), close)).filter(F.col(status).isin(*online))
    return merge_spans(spans.select(*key, F.col(at).alias("start"), F.greatest("end", at).alias("end")), key)


def handovers(stints: DataFrame, key: str, person: str, start: str, end: str) -> DataFrame:
    """Gaps at which a car changes hands: minutes after the running maximum of ends; under
    24 hours a handover, else parked.
    """
    order = Window.partitionBy(key).orderBy(start, end, person)
    gap = minutes_between(F.max(end).over(order.rowsBetween(*BEFORE)), F.col(start))
    changed = ~F.lag(person).over(order).eqNullSafe(F.col(person))
    found = stints.withColumn("gap_min", gap).withColumn("__changed", changed).filter("__changed and gap_min > 0")
    return found.select(key, person, start, "gap_min", F.when(F.col("gap_min") < 1440, "handover").otherwise("parked").alias("kind"))


def restated(filings: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """`restated`: another filing of the key overlaps this one, by the running maximum of
    earlier ends and the minimum of later starts.
    """
    order = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(*BEFORE))
    after = F.min(start).over(order.rowsBetween(1, Window.unboundedFollowing))
    return filings.withColumn("restated", F.coalesce(before >= F.col(start), F.lit(False)) | F.coalesce(after <= F.col(end), F.lit(False)))


def count_once(segments: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Without segments that a better source's segment of the same car and verdict
    overlaps. `segments`: plate, source, verdict, start, end; null verdicts are alike.

    Segments meet in the slots of four hours that they share, so a car's life is no group.
    """
    rank = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    named = segments.select("plate", "source", F.coalesce("verdict", F.lit("")).alias("__verdict"), rank[F.col("source")].alias("__rank"), "start", "end").distinct()
    on = ["plate", "__verdict"]
    better = named.select(*on, F.col("__rank").alias("__better"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    met = overlaps(named, better, on, ("start", "end"), ("__start", "__end"), 240)
    beaten = met.filter("__better < __rank and __start < end and __end > start").select("plate", "source", "__verdict", "start", "end").distinct()
    whole = segments.withColumn("__verdict", F.coalesce("verdict", F.lit("")))
    return whole.join(beaten, ["plate", "source", "__verdict", "start", "end"], "left_anti").select(*segments.columns)


def thinned(fixes: DataFrame, key: list[str], at: str, state: list[str], bucket_minutes: int = 15) -> DataFrame:
    """The first row of each bucket, the last row of each key, and each row whose state
    differs from the row before.
    """
    order = Window.partitionBy(*key).orderBy(at)
    slot = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / (60 * bucket_minutes))
    changes = F.lit(False)
    for c in state:
        changes = changes | ~F.lag(c).over(order).eqNullSafe(F.col(c))
    first = ~F.lag("__slot").over(order).eqNullSafe(F.col("__slot"))
    marked = fixes.withColumn("__slot", slot)
    marked = marked.withColumn("__keep", first | changes | F.lead(at).over(order).isNull())
    return marked.filter("__keep").drop("__slot", "__keep")


def supersede_groups(journeys: DataFrame) -> DataFrame:
    """Of overlapping journeys of a car (plate, start, end, ingested_at, distance_km), the
    latest ingested, then longest, farthest, latest: one row a group, with its members.
    Of one start, a journey without an end comes last; one without a start is alone.
    """
    order = Window.partitionBy("plate").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    opens = F.coalesce((F.col("start") >= F.max("end").over(order.rowsBetween(*BEFORE))).cast("int"), F.lit(1))
    grouped = journeys.withColumn("__o", opens).withColumn("__g", F.sum("__o").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = Window.partitionBy("plate", "__g").orderBy(F.desc("ingested_at"), F.desc(minutes_between(F.col("start"), F.col("end"))), F.desc("distance_km"), F.desc("start"))
    all_ = Window.partitionBy("plate", "__g")
    return grouped.withColumn("members", F.count("*").over(all_)).withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__o", "__g", "__n")


def minutes_by_day(spans: DataFrame, key: list[str], start: str = "start", end: str = "end", out: str = "online_min") -> DataFrame:
    """Whole minutes of the spans of a key (which do not overlap) on each local day."""
    a, b = time.local(F.col(start)), time.local(F.col(end))
    days = spans.select(*key, a.alias("__a"), b.alias("__b"), F.explode(F.sequence(F.to_date(a), F.to_date(b))).alias("day"))
    part = micros(F.least("__b", F.date_add("day", 1).cast("timestamp_ntz"))) - micros(F.greatest("__a", F.col("day").cast("timestamp_ntz")))
    return days.groupBy(*key, "day").agg(F.round(F.sum(part) / F.lit(60_000_000)).cast("bigint").alias(out))
