"""Where cars were: movement between fixes, stays, a day without holes, the night."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions import geo, time
from caravel.operators.intervals import minutes_between

#: Minutes between fixes that a source promises; fixed values.
CADENCE = {"cabman": 70, "fms": 30}
STAY_KM, STAY_MINUTES, SILENT_MINUTES, MOVING_MINUTES = 0.15, 10, 1440, 20


def legs(fixes: DataFrame) -> DataFrame:
    """Each fix with the next of its car: gap, distance and kind of what lies between."""
    order = Window.partitionBy("plate").orderBy("at")
    nxt = fixes.withColumn("next_at", F.lead("at").over(order)).withColumn("next_lat", F.lead("lat").over(order)).withColumn("next_lng", F.lead("lng").over(order))
    gap = minutes_between(F.col("at"), F.col("next_at"))
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("next_lat"), F.col("next_lng"))
    return nxt.withColumn("gap_min", gap).withColumn("km", km).withColumn("kind", leg_kind(F.col("gap_min"), F.col("km"), F.col("source"))).filter("next_at is not null")


def leg_kind(gap: Column, km: Column, source: Column) -> Column:
    cadence = F.create_map(*[F.lit(x) for pair in CADENCE.items() for x in pair])
    promised = F.coalesce(F.try_element_at(cadence, source), F.lit(30))
    return (
        F.when(gap > SILENT_MINUTES, "silent")
        .when(km <= STAY_KM, F.when(gap <= promised, "still").otherwise("parked"))
        .otherwise(F.when(gap <= MOVING_MINUTES, "moving").otherwise("moved"))
    )


def stays(fixes: DataFrame) -> DataFrame:
    """Runs of fixes within 150 m of the run's first, of 10 minutes or more: plate, start,
    end, lat, lng, fixes. The anchor makes it an ordered fold of one car's day.
    """

    def fold(day: pd.DataFrame) -> pd.DataFrame:
        import math

        day = day.sort_values("at", kind="stable")
        out, anchor, first, last, n = [], None, None, None, 0

        def far(a, b) -> bool:
            h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
            return 2 * geo.EARTH_KM * math.asin(min(1.0, math.sqrt(h))) > STAY_KM

        def close() -> None:
            if n and (last - first).total_seconds() >= 60 * STAY_MINUTES:
                out.append((day["plate"].iloc[0], day["local_day"].iloc[0], first, last, anchor[0], anchor[1], n))

        for at, lat, lng in zip(day["at"], day["lat"], day["lng"]):
            if anchor is None or far(anchor, (lat, lng)):
                close()
                anchor, first, n = (lat, lng), at, 0
            last, n = at, n + 1
        close()
        return pd.DataFrame(out, columns=["plate", "local_day", "start", "end", "lat", "lng", "fixes"])

    days = fixes.select("plate", time.local_day(F.col("at")).alias("local_day"), "at", "lat", "lng")
    return days.groupBy("plate", "local_day").applyInPandas(fold, "plate string, local_day date, start timestamp_ntz, end timestamp_ntz, lat double, lng double, fixes bigint")


def day_tiles(fixes: DataFrame) -> DataFrame:
    """Every minute of each local day with fixes typed: the legs cut at midnights, and
    `unknown` before the first and after the last fix. The source with most fixes of the
    day speaks for it.
    """
    local = fixes.withColumn("local_day", time.local_day(F.col("at")))
    best = local.groupBy("plate", "local_day", "source").agg(F.count("*").alias("n"))
    pick = Window.partitionBy("plate", "local_day").orderBy(F.desc("n"), "source")
    best = best.withColumn("__r", F.row_number().over(pick)).filter("__r = 1").drop("__r", "n")
    own = local.join(best, ["plate", "local_day", "source"])
    midnight = F.col("local_day").cast("timestamp_ntz") - F.expr(time.OFFSET)
    order = Window.partitionBy("plate", "local_day").orderBy("at")
    rows = own.withColumn("next_at", F.lead("at").over(order)).withColumn("next_lat", F.lead("lat").over(order)).withColumn("next_lng", F.lead("lng").over(order))
    gap = minutes_between(F.col("at"), F.col("next_at"))
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("next_lat"), F.col("next_lng"))
    inner = rows.filter("next_at is not null").select("plate", "local_day", F.col("at").alias("start"), F.col("next_at").alias("end"), leg_kind(gap, km, F.col("source")).alias("kind"))
    ends = own.groupBy("plate", "local_day").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    head = ends.select("plate", "local_day", midnight.alias("start"), F.col("first").alias("end"), F.lit("unknown").alias("kind"))
    tail = ends.select("plate", "local_day", F.col("last").alias("start"), (midnight + F.expr("INTERVAL '24' HOUR")).alias("end"), F.lit("unknown").alias("kind"))
    return inner.unionByName(head).unionByName(tail).filter("end > start").withColumn("minutes", minutes_between(F.col("start"), F.col("end")))


def night_fixes(fixes: DataFrame, until_hour: int = 5) -> DataFrame:
    """Fixes of 00:00 to 05:00 of each local day with the nearest one on either side."""
    local = fixes.withColumn("local", time.local(F.col("at"))).withColumn("night", F.to_date("local"))
    order = Window.partitionBy("plate").orderBy("at")
    inside = F.hour("local") < until_hour
    marked = local.withColumn("inside", inside)
    before = ~F.col("inside") & F.coalesce(F.lead("inside").over(order), F.lit(False))
    after = ~F.col("inside") & F.coalesce(F.lag("inside").over(order), F.lit(False))
    edge = F.when(F.col("inside"), "night").when(before, "before").when(after, "after")
    return marked.withColumn("edge", edge).filter("edge is not null").drop("local", "inside")


def dwell_spots(fixes: DataFrame, top: int = 60) -> DataFrame:
    """Spots (3 decimals) where a car stood: a still fix holds until the next, at most 7
    days if that is still at the spot, else 5 minutes. Spots of three fixes, top by hours.
    """
    order = Window.partitionBy("plate").orderBy("at")
    rows = fixes.withColumn("spot_lat", F.round("lat", 3)).withColumn("spot_lng", F.round("lng", 3)).withColumn("still", F.col("speed") < 2)
    same = F.lead("still").over(order) & (F.lead("spot_lat").over(order) == F.col("spot_lat")) & (F.lead("spot_lng").over(order) == F.col("spot_lng"))
    hold = F.least(minutes_between(F.col("at"), F.lead("at").over(order)), F.when(same, 7 * 1440).otherwise(5))
    held = rows.withColumn("hold", F.coalesce(hold, F.lit(0))).filter("still")
    return held.groupBy("spot_lat", "spot_lng").agg(F.count("*").alias("fixes"), (F.sum("hold") / 60).alias("hours"), F.countDistinct("plate").alias("cars")).filter("fixes >= 3").orderBy(F.desc("hours"), "spot_lat", "spot_lng").limit(top)
