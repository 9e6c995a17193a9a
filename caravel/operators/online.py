"""When drivers were online: spans from status events and jobs, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions import time


def day_end(ts: Column) -> Column:
    """The instant at which the local day of `ts` ends."""
    return F.date_add(time.local_day(ts), 1).cast("timestamp_ntz") - F.expr(time.OFFSET)


def online_spans(statuses: DataFrame, jobs: DataFrame, feeds: DataFrame, now: Column, online: str = "online") -> DataFrame:
    """driver, start, end, open_ended and closed_by of every stretch that a driver was online.

    An online event of `statuses` (driver, fleet_id, at, status) lasts to the driver's next
    event. The last one has none: it lasts to the earliest of its local day's end, `now`, and
    when its fleet's events were last collected (`feeds`: fleet_id, collected_at; a time
    before the event is no bound). A job of `jobs` (driver, job, at) is a stretch from its
    first event to its last. Stretches that overlap or touch are one; closed_by (event,
    collection, now or day) is that of the piece that ends last, an open one first.
    """
    order = Window.partitionBy("driver").orderBy("at")
    collected = feeds.groupBy("fleet_id").agg(F.max("collected_at").alias("collected_at"))
    events = statuses.filter("status <> ''").withColumn("next", F.lead("at").over(order)).filter(F.col("status") == online)
    events = events.join(collected, "fleet_id", "left")
    end = day_end(F.col("at"))
    bound = F.least(now, end)
    limited = F.col("collected_at") > F.col("at")
    last = F.when(limited, F.least("collected_at", bound)).otherwise(bound)
    by = F.when(F.col("next").isNotNull(), "event").when(limited & (F.col("collected_at") < bound), "collection").when(now < end, "now").otherwise("day")
    spans = events.select("driver", F.col("at").alias("start"), F.coalesce("next", last).alias("end"), F.col("next").isNull().alias("open_ended"), by.alias("closed_by"))
    worked = jobs.groupBy("driver", "job").agg(F.min("at").alias("start"), F.max("at").alias("end"))
    pieces = spans.unionByName(worked.select("driver", "start", "end", F.lit(False).alias("open_ended"), F.lit("event").alias("closed_by"))).filter(F.col("end") > F.col("start"))
    order = Window.partitionBy("driver").orderBy("start", "end")
    opens = F.coalesce((F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    marked = pieces.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = marked.groupBy("driver", "__island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("open_ended").alias("open_ended"), F.max_by("closed_by", F.struct("end", F.col("open_ended").cast("int"))).alias("closed_by")
    )
    return merged.drop("__island")
