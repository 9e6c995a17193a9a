"""Whom an unexplained segment belongs to, as far as the record can say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravel.operators.intervals import micros, minutes_between
from caravel.operators.joins import asof_after, asof_before

# Fixed values, in minutes: how far a bracket may reach, when a last trip is too old to say
# anything, and how far a clock may be out.
BRACKET, STALE, SKEWED = 240, 31_631, 60


def latest_ends(trips: DataFrame) -> DataFrame:
    """plate, t_start, and of the trips that begin by then: `until`, the latest end (of a
    trip without one, its start), its person `whose`, and `rivals`, the latest end of
    anybody else's.

    `rivals` never falls: where `whose` changes it becomes the end before.
    """
    each = trips.groupBy("plate", "t_start", "person").agg(F.max(F.coalesce("t_end", "t_start")).alias("__end"))
    order = Window.partitionBy("plate").orderBy("t_start", "person")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = each.withColumn("__top", F.max(F.struct("__end", "person")).over(so_far))
    rows = rows.withColumns({"__before": F.lag("__top").over(order), "__n": F.row_number().over(order)})
    taken_over = F.col("__top.person") != F.col("__before.person")
    rival = F.when(taken_over, F.col("__before.__end")).when(F.col("person") != F.col("__top.person"), F.col("__end"))
    rows = rows.withColumn("__rivals", F.max(rival).over(so_far))
    # of people who begin at once, the row that has seen them all
    last = rows.groupBy("plate", "t_start").agg(F.max_by(F.struct(F.col("__top.__end").alias("until"), F.col("__top.person").alias("whose"), F.col("__rivals").alias("rivals")), "__n").alias("e"))
    return last.select("plate", "t_start", "e.*")


def on_both_sides(spans: DataFrame, trips: DataFrame, bracket: int) -> DataFrame:
    """The distinct `spans` (plate, start, end) before which somebody's trip ends and after
    which one of the same person's begins, both within `bracket` minutes.

    Time is cut into slots of `bracket` minutes. Of a person's ends in the slot of the start
    only the first matters, of those in the slot before it only the last; of the begins
    likewise. So a person makes one point (u, v) for each pair of slots, and a span is such a
    point too, with somebody on both sides if some u is at most its own and that v at least.
    One sort of both tells; no span meets a trip.
    """
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (60 * bracket))
    reach = 60_000_000 * bracket
    ends = trips.filter("t_end is not null").groupBy("plate", "person", slot("t_end").alias("__e")).agg(F.min(micros(F.col("t_end"))).alias("__e0"), F.max(micros(F.col("t_end"))).alias("__e1"))
    begins = trips.groupBy("plate", "person", slot("t_start").alias("__b")).agg(F.min(micros(F.col("t_start"))).alias("__b0"), F.max(micros(F.col("t_start"))).alias("__b1"))
    placed = spans.select("plate", "start", "end", slot("start").alias("i"), slot("end").alias("j"))
    either = lambda name: F.explode(F.array(F.lit(0), F.lit(1))).alias(name)
    cells = placed.select("plate", "i", "j").distinct().select("*", either("early")).withColumn("__e", F.col("i") - F.col("early"))
    cells = cells.join(ends, ["plate", "__e"]).select("*", either("late")).withColumn("__b", F.col("j") + F.col("late"))
    cell = ["plate", "i", "j", "early", "late"]
    u = F.when(F.col("early") == 0, F.col("__e0")).otherwise(-(F.col("__e1") + reach))
    v = F.when(F.col("late") == 0, F.col("__b1")).otherwise(-(F.col("__b0") - reach))
    people = cells.join(begins, ["plate", "person", "__b"]).groupBy(*cell, u.alias("u")).agg(F.max(v).alias("v"))
    u = F.when(F.col("early") == 0, micros(F.col("start"))).otherwise(-micros(F.col("start")))
    v = F.when(F.col("late") == 0, micros(F.col("end"))).otherwise(-micros(F.col("end")))
    asked = placed.select("*", either("early")).select("*", either("late")).select("start", "end", *cell, u.alias("u"), v.alias("__v"))
    so_far = Window.partitionBy(*cell).orderBy("u", F.col("start").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = asked.unionByName(people, allowMissingColumns=True).withColumn("__most", F.max("v").over(so_far))
    return met.filter("start is not null and __most >= __v").select("plate", "start", "end").distinct()


def brackets(spans: DataFrame, trips: DataFrame, bracket: int = BRACKET) -> DataFrame:
    """plate, start and end of the distinct `spans` (each lasts some time), and of the people
    whose trips (plate, person, t_start, t_end: not before t_start) on the car end within
    `bracket` minutes before the span and begin within as many after it: arrived, the last
    such end, resumed, the first such begin, both (somebody is on both sides), clear (how
    many people have nobody else's trip between their two) and the person that is clear.

    A trip without an end ends nothing; as someone else's between, it counts at its start.
    Whoever ended later or began earlier stands between, so only those who end at `arrived`
    and begin at `resumed` can be clear. That and what lies between depend on these two times
    alone, which are found by sorting: spans and trips are never paired.
    """
    reach = F.make_interval(mins=F.lit(bracket))
    ended = trips.filter("t_end is not null")
    sides = asof_before(spans.select("plate", "start", "end").distinct(), ended.select("plate", "t_end").distinct(), ["plate"], "start", "t_end", [])
    sides = sides.select("plate", "start", "end", F.when(F.col("at") >= F.col("start") - reach, F.col("at")).alias("arrived"))
    sides = asof_after(sides, trips.select("plate", "t_start").distinct(), ["plate"], "end", "t_start", [])
    sides = sides.select("plate", "start", "end", "arrived", F.when(F.col("at") <= F.col("end") + reach, F.col("at")).alias("resumed"))
    two = sides.filter("arrived is not null and resumed is not null")
    gap = ["plate", "arrived", "resumed"]
    gaps = asof_before(two.select(*gap).distinct(), latest_ends(trips), ["plate"], "resumed", "t_start", ["until", "whose", "rivals"], strictly=True)
    free = F.coalesce(F.col("until") <= F.col("arrived"), F.lit(True))
    own = (F.col("person") == F.col("whose")) & F.coalesce(F.col("rivals") <= F.col("arrived"), F.lit(True))
    around = gaps.join(ended.select("plate", F.col("t_end").alias("arrived"), "person").distinct(), ["plate", "arrived"])
    around = around.join(trips.select("plate", F.col("t_start").alias("resumed"), "person").distinct(), ["plate", "resumed", "person"])
    clear = around.filter(free | own).groupBy(*gap).agg(F.count("*").alias("clear"), F.min("person").alias("person"))
    both = on_both_sides(two, trips, bracket).withColumn("both", F.lit(True))
    found = sides.join(clear, gap, "left").join(both, ["plate", "start", "end"], "left")
    return found.select("plate", "start", "end", "arrived", "resumed", F.coalesce("both", F.lit(False)).alias("both"), F.coalesce("clear", F.lit(0)).alias("clear"), F.when(F.col("clear") == 1, F.col("person")).alias("person"))


def holders(spans: DataFrame, custody: DataFrame) -> DataFrame:
    """plate, start, end, and the smallest and largest person (custodian, other) that
    `custody` (plate, day, person) has for the car on the days of each of the distinct `spans`.
    """
    daily = custody.groupBy("plate", "day").agg(F.min("person").alias("__least"), F.max("person").alias("__most"))
    days = spans.select("plate", "start", "end").distinct().select("*", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("day"))
    return days.join(daily, ["plate", "day"]).groupBy("plate", "start", "end").agg(F.min("__least").alias("custodian"), F.max("__most").alias("other"))


def attributed(segments: DataFrame, trips: DataFrame, custody: DataFrame, bracket: int = BRACKET, stale: int = STALE) -> DataFrame:
    """segment_id, plate, basis, person, before_min, after_min, stale_min and not_bracketed of
    each of `segments` (segment_id, plate, start, end, lag: the clock's, in minutes).

    The ladder: bracketed (exactly one person's trips clearly bracket it), last_trip (the
    last trip to end before it, at most `stale` minutes old), sole_custodian (`custody`:
    plate, day, person; one holds the car on its days), ambiguous (several do), unknown. A
    clock that is out by over an hour leaves custody alone to speak. not_bracketed says why
    it is not: clock, contradiction, someone_between, handover, only_before, only_after,
    nothing_near.
    """
    span = ["plate", "start", "end"]
    ended = trips.filter("t_end is not null").groupBy("plate", "t_end").agg(F.min("person").alias("last_person"))
    last = asof_before(segments.select(*span).distinct(), ended, ["plate"], "start", "t_end", ["last_person"])
    last = last.select(*span, "last_person", minutes_between(F.col("at"), F.col("start")).alias("stale_min"))
    known = last.join(brackets(segments, trips, bracket), span, "left").join(holders(segments, custody), span, "left")
    rows = segments.join(known, span, "left")
    skewed = F.coalesce(F.abs("lag") > SKEWED, F.lit(False))
    c = F.col
    is_bracket = ~skewed & F.coalesce(c("clear") == 1, F.lit(False))
    is_last = ~skewed & F.coalesce(c("stale_min") <= stale, F.lit(False))
    one, several = c("custodian") == c("other"), c("custodian") != c("other")
    basis = F.when(is_bracket, "bracketed").when(is_last, "last_trip").when(one, "sole_custodian").when(several, "ambiguous").otherwise("unknown")
    person = F.when(is_bracket, c("person")).when(is_last, c("last_person")).when(one, c("custodian"))
    reason = (
        F.when(is_bracket, None).when(skewed, "clock").when(c("clear") > 1, "contradiction").when(c("both"), "someone_between")
        .when(c("arrived").isNotNull() & c("resumed").isNotNull(), "handover").when(c("arrived").isNotNull(), "only_before").when(c("resumed").isNotNull(), "only_after").otherwise("nothing_near")
    )
    gap = lambda a, b, name: F.when(is_bracket, minutes_between(c(a), c(b))).alias(name)
    return rows.select("segment_id", "plate", basis.alias("basis"), person.alias("person"), gap("arrived", "start", "before_min"), gap("end", "resumed", "after_min"), F.when(is_last & ~is_bracket, c("stale_min")).alias("stale_min"), reason.alias("not_bracketed"))
