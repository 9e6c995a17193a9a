"""Streams of the landed events, each with the SQL of what a whole run of it must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.operators import joins, online
from caravel.plans.registry import query
from caravel.streaming import status


def landed(t):
    """The events as a stream; its clock is an instant."""
    stream = status.event_stream(t.spark, f"{t._folder}/event[s].parquet", t.events.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: Files of a landing, which one micro-batch takes together.
FILES = 8


def in_files(t, label: str, times: int = 1):
    """The events as a stream of landings one after another, each of some three days; an
    event comes up to a day late, and `times` times. A landing has as many files at every
    size, so that the micro-batches, each of which goes over the state, do not grow in number.
    """
    folder, slices = joins.shared_path(t.spark, label), joins.shared_path(t.spark, f"{label}-slices")
    hours = (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("bigint")
    late = [(F.col("event_id") * 7 + 11 * k) % 24 for k in range(times)]
    rows = t.events.withColumn("file", F.explode(F.array(*[((hours + h) / 72).cast("bigint") for h in late])))
    rows.write.partitionBy("file").parquet(slices)  # one pass over the events
    landings = t.spark.read.schema(rows.schema).parquet(slices)
    for r in landings.select("file").distinct().sort("file").collect():  # ten of a month
        landings.filter(F.col("file") == r.file).drop("file").repartition(FILES).write.mode("append").parquet(folder)
    return status.event_stream(t.spark, folder, t.events.schema, FILES).withColumn("ts", F.col("ts").cast("timestamp"))


def whole_run(t, stream, label: str, mode: str = "append"):
    """What a stream gives from the first file to the last: in complete mode its last
    result, else all that it appends.
    """
    table, checkpoint = joins.shared_path(t.spark, label), joins.shared_path(t.spark, f"{label}-offsets")

    def write(batch, n: int) -> None:
        batch.write.mode("overwrite").parquet(table if mode == "complete" else f"{table}/batch={n}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(table)


def local(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


@query("T04_tumbling_stream", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(14,4))) AS DOUBLE), 4) AS value FROM events GROUP BY 1, 2")
def _(t):
    rows = landed(t).withColumn("value", F.col("value").cast("decimal(14,4)"))
    found = whole_run(t, status.tumbling(rows, "ts", ["event_type"], "1 hour", "1 day"), "tumbling", "complete")
    return found.select(local("start"), "event_type", "n", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("T06_sliding_stream", "SELECT start, user_id % 10 AS car, count(*) AS n FROM (SELECT user_id, unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR * ((hour(ts)) % 6), date_trunc('hour', ts) - INTERVAL 1 HOUR * (hour(ts) % 6) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2")
def _(t):
    rows = landed(t).withColumn("car", F.col("user_id") % 10)
    return whole_run(t, status.sliding(rows, "ts", ["car"], "12 hours", "6 hours", "1 day"), "sliding", "complete").select(local("start"), "car", "n")


@query("T05_sessions_stream", """WITH g AS (SELECT user_id % 20 AS car, ts, ts >= lag(ts) OVER (PARTITION BY user_id % 20 ORDER BY ts) + INTERVAL 90 MINUTE AS apart FROM events),
s AS (SELECT car, ts, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY car ORDER BY ts) AS run FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 90 MINUTE AS "end", car, count(*) AS n FROM s GROUP BY car, run""")
def _(t):
    rows = landed(t).withColumn("car", F.col("user_id") % 20)
    return whole_run(t, status.sessions(rows, "ts", ["car"], "90 minutes", "1 day"), "sessions", "complete").select(local("start"), local("end"), "car", "n")


@query("T10_once_stream", "SELECT event_id, event_type, ts FROM events")
def _(t):
    twice = in_files(t, "repeated-events", 2)
    return whole_run(t, status.once(twice, "ts", ["event_id"], "4 days"), "once").select("event_id", "event_type", local("ts"))


#: What the watermark has passed in the end; later events wait for more.
PASSED = "(SELECT max(\"at\") FROM e) - INTERVAL 4 DAY"


@query("T05_online_spans_stream", f"""WITH e AS (SELECT user_id % 30 AS driver, date_trunc('milliseconds', ts) AS "at", event_type AS status FROM events),
n AS (SELECT *, lead("at") OVER w AS next, CAST(CAST("at" + INTERVAL 4 HOUR AS DATE) + 1 AS TIMESTAMP) - INTERVAL 4 HOUR AS day_end, {PASSED} AS clock FROM e WINDOW w AS (PARTITION BY driver ORDER BY "at", status))
SELECT driver, "at" AS start, least(coalesce(next, day_end), day_end) AS "end", CASE WHEN next <= day_end THEN 'event' ELSE 'day' END AS closed_by FROM n WHERE status = 'click' AND least(coalesce(next, day_end), day_end) < clock""")
def _(t):
    rows = in_files(t, "status-events").select((F.col("user_id") % 30).alias("driver"), F.date_trunc("millisecond", "ts").alias("at"), F.col("event_type").alias("status"))
    found = whole_run(t, status.online_spans(rows, "click", "4 days"), "online-spans")
    return found.select("driver", local("start"), local("end"), "closed_by")


@query("T14_notices_stream", f"""WITH RECURSIVE e AS (SELECT user_id % 15 AS key, date_trunc('milliseconds', ts) AS "at", CASE WHEN value < 60 THEN 'ok' WHEN value < 90 THEN 'stalled' ELSE 'dark' END AS state FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", state) AS i FROM e WHERE "at" < {PASSED}),
r AS (SELECT key, i, "at", state AS told, CAST(NULL AS VARCHAR) AS pending, CAST(NULL AS TIMESTAMP) AS since, "at" AS noticed, TRUE AS said, CAST(NULL AS VARCHAR) AS was FROM n WHERE i = 1 UNION ALL
  SELECT key, i, "at", CASE WHEN says THEN state ELSE told END, CASE WHEN says OR same THEN NULL ELSE state END, CASE WHEN says OR same THEN NULL ELSE since END, CASE WHEN says THEN "at" ELSE noticed END, says, told FROM (
    SELECT *, NOT same AND (epoch_us("at") - epoch_us(since) >= CASE WHEN state = 'stalled' THEN 540000000 ELSE 3600000000 END OR (state <> 'stalled' AND NOT fresh)) AND epoch_us("at") - epoch_us(noticed) >= 1800000000 AS says FROM (
      SELECT n.key, n.i, n."at", n.state, r.told, r.noticed, n.state = r.told AS same, n.state IS DISTINCT FROM r.pending AS fresh, CASE WHEN n.state IS DISTINCT FROM r.pending THEN n."at" ELSE r.since END AS since FROM r JOIN n ON n.key = r.key AND n.i = r.i + 1)))
SELECT key, "at", was, told AS state FROM r WHERE said""")
def _(t):
    state = F.when(F.col("value") < 60, "ok").when(F.col("value") < 90, "stalled").otherwise("dark")
    rows = in_files(t, "health").select((F.col("user_id") % 15).alias("key"), F.date_trunc("millisecond", "ts").alias("at"), state.alias("state"))
    return whole_run(t, status.notices(rows, "4 days"), "notices").select("key", local("at"), "was", "state")


@query("C05_online_whole", """WITH s AS (SELECT user_id AS driver, 'F' || (user_id % 3) AS fleet_id, ts AS "at", CASE event_type WHEN 'click' THEN 'online' WHEN 'view' THEN 'offline' WHEN 'signup' THEN 'busy' END AS status FROM events WHERE event_type IN ('click', 'view', 'signup')),
f AS (SELECT 'F' || (user_id % 3) AS fleet_id, max(ts) - INTERVAL 7 HOUR AS collected FROM events WHERE event_type = 'error' AND user_id % 3 < 2 GROUP BY 1), c AS (SELECT max(ts) + INTERVAL 10 MINUTE AS now FROM events),
n AS (SELECT s.*, lead("at") OVER (PARTITION BY driver ORDER BY "at") AS next, CAST(CAST("at" + INTERVAL 4 HOUR AS DATE) + 1 AS TIMESTAMP) - INTERVAL 4 HOUR AS day_end FROM s),
p AS (SELECT driver, "at" AS a, coalesce(next, least(now, day_end, CASE WHEN collected > "at" THEN collected ELSE now END)) AS b, next IS NULL AS o, CASE WHEN next IS NOT NULL THEN 'event' WHEN collected > "at" AND collected < least(now, day_end) THEN 'collection' WHEN now < day_end THEN 'now' ELSE 'day' END AS c FROM n JOIN c ON TRUE LEFT JOIN f USING (fleet_id) WHERE status = 'online'
  UNION ALL SELECT user_id, min(ts), max(ts), FALSE, 'event' FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id, event_id // 300),
i AS (SELECT *, sum(k) OVER (PARTITION BY driver ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY driver ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS k FROM p WHERE b > a))
SELECT driver, min(a) AS start, max(b) AS "end", bool_or(o) AS open_ended, arg_max(c, (b, o)) AS closed_by FROM i GROUP BY driver, g""")
def _(t):
    fleet = F.concat(F.lit("F"), F.col("user_id") % 3).alias("fleet_id")
    told = F.when(F.col("event_type") == "click", "online").when(F.col("event_type") == "view", "offline").when(F.col("event_type") == "signup", "busy")
    driver = F.col("user_id").alias("driver")
    statuses = t.events.select(driver, fleet, F.col("ts").alias("at"), told.alias("status")).filter("status is not null")
    jobs = t.events.filter("event_type in ('purchase', 'error')").select(driver, F.floor(F.col("event_id") / 300).alias("job"), F.col("ts").alias("at"))
    feeds = t.events.filter("event_type = 'error' and user_id % 3 < 2").select(fleet, (F.col("ts") - F.expr("INTERVAL '7' HOUR")).alias("collected_at"))
    now = t.events.agg(F.max("ts")).first()[0]
    clock = F.lit(now).cast("timestamp_ntz") + F.expr("INTERVAL '10' MINUTE")
    return online.online_spans(statuses, jobs, feeds, clock)


@query("S06_admitted", """WITH p AS (SELECT event_type AS source, 'U' || (user_id % 70) AS plate, date_trunc('hour', ts) AS captured_at, date_trunc('day', ts) + INTERVAL 1 HOUR * CAST(event_id % 24 AS INT) AS polled_at, event_id AS n FROM events),
a AS (SELECT plate FROM p GROUP BY 1 HAVING count(DISTINCT polled_at) >= 20 UNION SELECT 'U' || s_suppkey FROM supplier)
SELECT source, plate, captured_at, max(polled_at) AS polled_at, max(n) AS n FROM p WHERE plate IN (SELECT plate FROM a) GROUP BY 1, 2, 3""")
def _(t):
    plate = F.concat(F.lit("U"), F.col("user_id") % 70)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    polls = t.events.select(F.col("event_type").alias("source"), plate.alias("plate"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("captured_at"), (day + F.make_interval(hours=(F.col("event_id") % 24).cast("int"))).alias("polled_at"), F.col("event_id").alias("n"))
    # of a fix's polls the last one speaks, so the newest number is taken to it first
    newest = polls.withColumn("n", F.max("n").over(_fix()))
    return status.admitted(newest, t.supplier.select(F.concat(F.lit("U"), "s_suppkey").alias("plate")), 20).select("source", "plate", "captured_at", "polled_at", "n")


def _fix():
    from pyspark.sql import Window

    return Window.partitionBy("source", "plate", "captured_at")
