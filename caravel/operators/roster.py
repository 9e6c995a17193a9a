"""Which cars a provider's polls make members of a fleet, and when they leave it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged_polls(listed: DataFrame, depart: int = 288, ratio: float = 0.8, floor: int = 10) -> DataFrame:
    """fleet_id, polled_at, returned, held, collapsed and n for each poll of `listed`
    (fleet_id, polled_at, plate): how many cars it lists, and the most that any of the
    `depart` polls before it listed, whose cars cannot have left yet. A poll that lists less
    than `ratio` of at least `floor` held cars has collapsed. n numbers a fleet's polls that
    have not, from 1.
    """
    polls = listed.groupBy("fleet_id", "polled_at").agg(F.countDistinct("plate").alias("returned"))
    order = Window.partitionBy("fleet_id").orderBy("polled_at")
    held = F.max("returned").over(order.rowsBetween(-depart, -1))
    rows = polls.withColumn("held", F.coalesce(held, F.lit(0)))
    rows = rows.withColumn("collapsed", (F.col("held") >= floor) & (F.col("returned") < ratio * F.col("held")))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("n", F.when(~F.col("collapsed"), F.sum((~F.col("collapsed")).cast("bigint")).over(so_far)))


def memberships(listed: DataFrame, admit: int = 3, depart: int = 288, ratio: float = 0.8, floor: int = 10) -> DataFrame:
    """fleet_id, plate, first_listed, admitted_at, last_listed and departed_at of each stretch
    in which a car is listed: it is admitted by `admit` polls running and departs with the
    `depart`-th poll running that misses it; then it must be admitted anew. admitted_at is
    null if it never was (then it never departs), departed_at if it is still a member.

    Polls that collapsed admit and remove nobody: they are passed over. Runs are told by the
    numbers of polls, in one sort of a car's polls; a poll has one row, a car a row for each
    poll that lists it.
    """
    polls = judged_polls(listed, depart, ratio, floor)
    good = polls.filter("not collapsed").select("fleet_id", "polled_at", "n")
    seen = listed.select("fleet_id", "plate", "polled_at").distinct().join(good, ["fleet_id", "polled_at"])
    car = Window.partitionBy("fleet_id", "plate").orderBy("n")
    missed = F.col("n") - F.lag("n").over(car) - 1
    so_far = car.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = lambda least: F.coalesce((missed >= least).cast("int"), F.lit(1))
    runs = seen.withColumns({"__new": begins(depart), "__run": begins(1)})
    runs = runs.withColumns({"stretch": F.sum("__new").over(so_far), "run": F.sum("__run").over(so_far)})
    place = F.row_number().over(Window.partitionBy("fleet_id", "plate", "run").orderBy("n"))
    placed = runs.withColumn("__place", place)
    found = placed.groupBy("fleet_id", "plate", "stretch").agg(
        F.min("polled_at").alias("first_listed"), F.min(F.when(F.col("__place") == admit, F.col("polled_at"))).alias("admitted_at"), F.max("polled_at").alias("last_listed"), F.max("n").alias("__last")
    )
    leaving = good.select(F.col("fleet_id").alias("__fleet"), F.col("n").alias("__n"), F.col("polled_at").alias("__left"))
    joined = found.join(leaving, (F.col("fleet_id") == F.col("__fleet")) & (F.col("__last") + depart == F.col("__n")), "left")
    left = F.when(F.col("admitted_at").isNotNull(), F.col("__left")).alias("departed_at")
    return joined.select("fleet_id", "plate", "first_listed", "admitted_at", "last_listed", left)
