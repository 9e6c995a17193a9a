"""As-of, interval and overlap joins, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)


def slots(start: Column, end: Column, minutes: int) -> Column:
    """The numbers of the time slots that a span touches: an equi-join key for ranges."""
    number = lambda ts: F.floor(F.unix_seconds(ts.cast("timestamp")) / (60 * minutes))
    return F.explode(F.sequence(number(start), number(F.greatest(start, end))))


def asof_nearest(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_at: str, right_at: str, within_minutes: int, prefer: list[Column] = []) -> DataFrame:  # noqa: B006
    """Each left row with the nearest right row of the same keys within so many minutes
    either side (`prefer` before nearness; ties by right_at). Rows meet by slot, so a
    key with a long history is no single group.
    """
    reach = F.expr(f"INTERVAL '{within_minutes}' MINUTE")
    a = left.withColumn("__slot", F.floor(F.unix_seconds(F.col(left_at).cast("timestamp")) / (60 * within_minutes)))
    b = right.withColumn("__slot", slots(F.col(right_at) - reach, F.col(right_at) + reach, within_minutes)).withColumnRenamed(right_at, "__at")
    gap = F.abs(seconds(F.col(left_at)) - seconds(F.col("__at")))
    met = a.join(b, [*on, "__slot"]).withColumn("gap_s", gap).filter(F.col("gap_s") <= 60 * within_minutes)
    order = Window.partitionBy(left_id).orderBy(*prefer, "gap_s", "__at")
    return met.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__slot").withColumnRenamed("__at", right_at)


def asof_before(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, take: list[str], strictly: bool = False) -> DataFrame:
    """Each left row with `take` of the latest right row at or (unless `strictly`) before it:
    one sort of both by key and time, the last value carried forward. No range join, no rows
    multiplied.
    """
    return _asof(left, right, on, left_at, right_at, take, F.asc("__at"), strictly)


def asof_after(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """The same of the earliest right row at or after it."""
    return _asof(left, right, on, left_at, right_at, take, F.desc_nulls_first("__at"), False)


def _asof(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, take: list[str], order: Column, strictly: bool) -> DataFrame:
    pick = F.struct(F.col(right_at).alias("at"), *take)
    b = right.select(*on, F.col(right_at).alias("__at"), pick.alias("__right"), F.lit(0).alias("__side"))
    a = left.withColumn("__at", F.col(left_at)).withColumn("__right", F.lit(None).cast(b.schema["__right"].dataType)).withColumn("__side", F.lit(-1 if strictly else 1))
    rows = Window.partitionBy(*on).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__right", True).over(rows)).filter("__side <> 0")
    return both.select(*left.columns, *[F.col(f"__last.{c}").alias(c if c not in left.columns else f"{c}_2") for c in ["at", *take]])


def overlaps(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], slot_minutes: int) -> DataFrame:
    """Pairs of rows of equal keys whose spans overlap or touch, each pair once: rows meet
    in the slots they share, and the pair counts in the later of their first slots.
    """
    left = a.withColumn("__slot", slots(F.col(a_span[0]), F.col(a_span[1]), slot_minutes))
    right = b.withColumn("__slot", slots(F.col(b_span[0]), F.col(b_span[1]), slot_minutes))
    met = left.join(right, [*on, "__slot"]).filter((F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(a_span[1]) >= F.col(b_span[0])))
    first = F.floor(F.unix_seconds(F.greatest(F.col(a_span[0]), F.col(b_span[0])).cast("timestamp")) / (60 * slot_minutes))
    return met.filter(F.col("__slot") == first).drop("__slot")


def match_bookings(segments: DataFrame, bookings: DataFrame, tolerance_minutes: int = 15) -> DataFrame:
    """For each segment (segment_id, plate, start, end) the first booking (booking_id,
    plate, b_start, b_end, outcome) of its plate, completed or unknown, whose window
    overlaps it within the tolerance, in the order of b_start and booking_id; null if none.
    """
    reach = F.expr(f"INTERVAL '{tolerance_minutes}' MINUTE")
    wide = segments.select("segment_id", "plate", (F.col("start") - reach).alias("__a"), (F.col("end") + reach).alias("__b"))
    usable = bookings.filter("outcome is null or outcome = 'completed'").select("plate", "booking_id", "b_start", "b_end")
    met = overlaps(wide, usable, ["plate"], ("__a", "__b"), ("b_start", "b_end"), 240)
    first = met.groupBy("segment_id").agg(F.min(F.struct("b_start", "booking_id")).alias("first"))
    return segments.join(first, "segment_id", "left").select(*segments.columns, F.col("first.booking_id").alias("matched_booking"))


def nearest_trip(sessions: DataFrame, trips: DataFrame, hours: int) -> DataFrame:
    """The plate a charging session (session_id, driver, at, session_plate) belongs to: its
    own, the only car its driver had near it, the car of the nearest trip, or none.
    """
    linked = sessions.join(trips.select("driver").distinct().withColumn("__known", F.lit(True)), "driver", "left")
    asked, reach = ["driver", "at"], F.expr(f"INTERVAL '{hours}' HOUR")
    cars = trips.groupBy("driver", "trip_at").agg(F.min("plate").alias("plate"))
    gap = lambda a, b: F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))
    near = asof_before(sessions.select(*asked).distinct(), cars, ["driver"], "at", "trip_at", ["plate"])
    near = near.select(*asked, F.col("at_2").alias("__t0"), F.col("plate").alias("__p0"))
    near = asof_after(near, cars, ["driver"], "at", "trip_at", ["plate"])
    near = near.select(*asked, "__t0", "__p0", F.col("at_2").alias("__t1"), F.col("plate").alias("__p1"), (F.col("at") + reach).alias("__to"))
    # several cars: the last change of cars before the reach ends lies within it, both trips
    order = Window.partitionBy("driver").orderBy("trip_at", "plate")
    changes = trips.select("driver", "trip_at", "plate").distinct().select("driver", "trip_at", F.lag("trip_at").over(order).alias("since"), (F.lag("plate").over(order) != F.col("plate")).alias("changed"))
    changes = changes.filter("changed").groupBy("driver", "trip_at").agg(F.max("since").alias("since"))
    near = asof_before(near, changes, ["driver"], "__to", "trip_at", ["since"])
    most = 3_600_000_000 * hours
    before, after = F.when(gap("__t0", "at") <= most, gap("__t0", "at")), F.when(gap("at", "__t1") <= most, gap("at", "__t1"))
    plate = F.when(after.isNull() | (before <= after), F.col("__p0")).otherwise(F.col("__p1"))
    near = near.select(*asked, F.coalesce(before, after).isNotNull().alias("__any"), F.when(F.coalesce(before, after).isNotNull(), plate).alias("near_plate"), F.coalesce(gap("since", "at") <= most, F.lit(False)).alias("__several"))
    joined = linked.join(near, asked, "left")
    basis = F.when(F.col("session_plate").isNotNull(), "session_plate").when(F.col("__known").isNull(), "no_link").when(~F.coalesce("__any", F.lit(False)), "no_trip").when(~F.col("__several"), "only_car").otherwise("nearest_trip")
    return joined.select("session_id", F.coalesce("session_plate", "near_plate").alias("plate"), basis.alias("basis"))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Only
    a session on one machine may leave that unset; it gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = sc.getCheckpointDir()
    return f"{folder}/{sc.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of an undirected graph.

    Every round each node hangs on the neighbour that comes first in an order dealt anew,
    if that comes before itself; the links between what they hang on are the next round's.
    About half of the nodes go each round, so all rounds together move a few times the links,
    however long a chain is. Then the roots are handed back from the last round to the first.
    """
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    links = written(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    hung, n = [], 0
    while not links.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(n), F.col(c))  # noqa: E731, B023
        ends = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")
        both = links.select(ends).select("e.x", "e.y").withColumn("rank", rank("y"))
        # equal ranks of different nodes would need equal hashes; they then hang on neither
        first = both.groupBy("x").agg(F.min("rank").alias("rank"), F.min_by("y", "rank").alias("y"))
        up = written(first.select(F.col("x").alias("node"), F.when(F.col("rank") < rank("x"), F.col("y")).otherwise(F.col("x")).alias("up")), "hung")
        of = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"of_{c}"))  # noqa: E731, B023
        between = links.filter("x <> y").join(of("x"), "x").join(of("y"), "y").filter("of_x <> of_y")
        links = written(between.select(F.least("of_x", "of_y").alias("x"), F.greatest("of_x", "of_y").alias("y")).distinct(), "links")
        hung, n = [*hung, up], n + 1
    if not hung:
        return links.select(F.col("x").alias("node"), F.col("y").alias("component"))
    roots = hung[-1].withColumnRenamed("up", "root")
    for up in reversed(hung[:-1]):
        above = roots.select(F.col("node").alias("up"), "root")
        roots = written(up.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return written(roots.join(least, "root").select("node", "component"), "labels")


def status_at(candidates: DataFrame, accounts: DataFrame, events: DataFrame) -> DataFrame:
    """segment_id, person, status and at: the newest status of any of the candidate's
    accounts at or before the segment's start, null where there is none.

    `candidates`: segment_id, person, started_at. `accounts`: person, account. `events`:
    account, at, status. The accounts' events become their person's, so one as-of pass goes
    over candidates and events, however many accounts a person has.
    """
    theirs = events.join(accounts.distinct(), "account").groupBy("person", "at").agg(F.max("status").alias("status"))
    found = asof_before(candidates.select("segment_id", "person", "started_at"), theirs, ["person"], "started_at", "at", ["status"])
    return found.select("segment_id", "person", "status", "at")
