"""Joins, windows, limits and set operations: groups C, E, F, G."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caravel.operators import intervals, joins
from caravel.plans.registry import query
from caravel.plans.rollups import norm
from caravel.sources.fleet import WITH_TRIPS


@query("J01_J02_equi_outer", "SELECT c_mktsegment, count(*) AS rows, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS people FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def _(t):
    rows = t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("rows"), F.count("o_orderkey").alias("orders"), F.countDistinct("c_custkey").alias("people"))


ORDER_MONTH = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"
SHIP_MONTH = "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS ships FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1"


@query("J03_full_outer", f"SELECT month, orders, ships FROM ({ORDER_MONTH}) FULL JOIN ({SHIP_MONTH}) USING (month)")
def _(t):
    month = lambda c: F.to_date(F.date_trunc("month", c)).alias("month")
    a = t.orders.filter("o_orderstatus = 'F'").groupBy(month("o_orderdate")).agg(F.count("*").alias("orders"))
    b = t.lineitem.filter("l_returnflag = 'R'").groupBy(month("l_shipdate")).agg(F.count("*").alias("ships"))
    return a.join(b, "month", "full_outer")


@query("J04_J05_full_chain", "WITH a AS (SELECT CAST(ts AS DATE) AS day, user_id % 40 AS k, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT CAST(ts AS DATE) AS day, user_id % 40 AS k, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT CAST(ts AS DATE) AS day, user_id % 40 AS k, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1, 2) SELECT day, k, clicks, views, errors FROM a FULL JOIN b USING (day, k) FULL JOIN c USING (day, k)")
def _(t):
    keys = [F.to_date("ts").alias("day"), (F.col("user_id") % 40).alias("k")]
    part = lambda kind, out: t.events.filter(F.col("event_type") == kind).groupBy(*keys).agg(F.count("*").alias(out))
    return part("click", "clicks").join(part("view", "views"), ["day", "k"], "full_outer").join(part("error", "errors"), ["day", "k"], "full_outer")


@query("J06_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def _(t):
    return t.customer.join(t.orders.filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J07_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 45 * c_acctbal)")
def _(t):
    return t.customer.join(t.orders, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 45 * F.col("c_acctbal")), "left_semi").select("c_custkey", "c_name")


@query("J08_containment", "WITH s AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1) SELECT o_orderstatus, count(*) AS n FROM orders JOIN s ON o_orderkey = l_orderkey AND o_orderdate BETWEEN a AND b GROUP BY 1")
def _(t):
    spans = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    rows = t.orders.join(spans, (F.col("o_orderkey") == F.col("l_orderkey")) & F.col("o_orderdate").between(F.col("a"), F.col("b")))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _filings(t):
    return t.orders.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 20).cast("int"))).alias("b"))


FILINGS = "f AS (SELECT o_custkey AS person, o_orderkey AS id, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 20 AS INT)) AS b FROM orders)"


@query("J09_overlap", f"WITH {FILINGS} SELECT x.person, x.id AS id, y.id AS other FROM f x JOIN f y ON x.person = y.person AND x.id < y.id AND x.a <= y.b AND x.b >= y.a")
def _(t):
    x = _filings(t)
    y = x.select("person", F.col("id").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"))
    return joins.overlaps(x, y, ["person"], ("a", "b"), ("c", "d"), 30 * 1440).filter("id < other").select("person", "id", "other")


SEGMENTS = "s AS (SELECT event_id AS segment_id, 'U' || (user_id % 40) AS plate, ts AS start, ts + INTERVAL 20 MINUTE AS \"end\" FROM events WHERE event_type = 'signup')"
BOOKS = "b AS (SELECT event_id AS booking_id, 'U' || (user_id % 40) AS plate, ts AS b_start, ts + INTERVAL 10 MINUTE AS b_end, CASE WHEN event_id % 3 = 0 THEN 'not_completed' WHEN event_id % 3 = 1 THEN 'completed' END AS outcome FROM events WHERE event_type = 'purchase')"


def _segments(t):
    return t.events.filter("event_type = 'signup'").select(F.col("event_id").alias("segment_id"), F.concat(F.lit("U"), F.col("user_id") % 40).alias("plate"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL '20' MINUTE")).alias("end"))


def _books(t):
    outcome = F.when(F.col("event_id") % 3 == 0, "not_completed").when(F.col("event_id") % 3 == 1, "completed").alias("outcome")
    return t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("booking_id"), F.concat(F.lit("U"), F.col("user_id") % 40).alias("plate"), F.col("ts").alias("b_start"), (F.col("ts") + F.expr("INTERVAL '10' MINUTE")).alias("b_end"), outcome)


@query("J10_J11_interval_match", f"WITH {SEGMENTS}, {BOOKS}, m AS (SELECT segment_id, arg_min(booking_id, {{'a': b_start, 'b': booking_id}}) AS matched_booking FROM s JOIN b USING (plate) WHERE coalesce(outcome, 'completed') = 'completed' AND b_start <= \"end\" + INTERVAL 15 MINUTE AND b_end >= start - INTERVAL 15 MINUTE GROUP BY 1) SELECT segment_id, plate, matched_booking FROM s LEFT JOIN m USING (segment_id)")
def _(t):
    return joins.match_bookings(_segments(t), _books(t)).select("segment_id", "plate", "matched_booking")


@query("J12_asof_nearest", "WITH p AS (SELECT event_id, user_id % 50 AS u, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id AS error_id, user_id % 50 AS u, ts AS e_ts FROM events WHERE event_type = 'error') SELECT event_id, error_id FROM p JOIN e USING (u) WHERE abs(epoch_us(ts) - epoch_us(e_ts)) <= 3600000000 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(e_ts)), e_ts) = 1")
def _(t):
    a = t.events.filter("event_type = 'purchase'").select("event_id", (F.col("user_id") % 50).alias("u"), "ts")
    b = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), (F.col("user_id") % 50).alias("u"), F.col("ts").alias("e_ts"))
    return joins.asof_nearest(a, b, ["u"], "event_id", "ts", "e_ts", 60).select("event_id", "error_id")


@query("J13_latest_before", "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(t):
    a = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = t.events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("v_ts"), F.col("event_id").alias("view_id"))
    return joins.asof_before(a, b, ["user_id"], "ts", "v_ts", ["view_id"]).select("event_id", "view_id")


@query("J14_nearest_trip", """WITH s AS (SELECT event_id AS session_id, user_id % 60 AS driver, ts AS "at", CASE WHEN event_id % 4 = 0 THEN 'own' END AS session_plate FROM events WHERE event_type = 'signup'), tr AS (SELECT user_id % 60 AS driver, 'P' || (event_id % 3) AS plate, ts AS trip_at FROM events WHERE event_type = 'purchase'), m AS (SELECT session_id, plate, row_number() OVER (PARTITION BY session_id ORDER BY abs(epoch_us("at") - epoch_us(trip_at)), trip_at, plate) AS n FROM s JOIN tr USING (driver) WHERE abs(epoch_us("at") - epoch_us(trip_at)) <= 14400000000), g AS (SELECT session_id, max(plate) FILTER (WHERE n = 1) AS near, count(DISTINCT plate) AS cars FROM m GROUP BY 1) SELECT session_id, coalesce(session_plate, near) AS plate, CASE WHEN session_plate IS NOT NULL THEN 'session_plate' WHEN driver NOT IN (SELECT driver FROM tr) THEN 'no_link' WHEN cars IS NULL THEN 'no_trip' WHEN cars = 1 THEN 'only_car' ELSE 'nearest_trip' END AS basis FROM s LEFT JOIN g USING (session_id)""")
def _(t):
    driver = (F.col("user_id") % 60).alias("driver")
    s = t.events.filter("event_type = 'signup'").select(F.col("event_id").alias("session_id"), driver, F.col("ts").alias("at"), F.when(F.col("event_id") % 4 == 0, "own").alias("session_plate"))
    tr = t.events.filter("event_type = 'purchase'").select(driver, F.concat(F.lit("P"), F.col("event_id") % 3).alias("plate"), F.col("ts").alias("trip_at"))
    return joins.nearest_trip(s, tr, 4)


@query("J15_top1_lookup", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")
def _(t):
    best = t.orders.groupBy("o_custkey").agg(F.max(F.struct((F.col("o_orderstatus") == "F").alias("f"), "o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("m"))
    return t.customer.join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (-F.col("m.k")).alias("best"))


@query("J17_unnest", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def _(t):
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("J18_J19_cross_scalar", "WITH m AS (SELECT median(s_acctbal) AS med FROM supplier) SELECT s_suppkey, round(s_acctbal - med, 4) AS over_median FROM supplier, m")
def _(t):
    median = t.supplier.agg(F.percentile("s_acctbal", F.lit(0.5)).alias("med"))  # one row
    return t.supplier.crossJoin(F.broadcast(median)).select("s_suppkey", F.round(F.col("s_acctbal") - F.col("med"), 4).alias("over_median"))


@query("J18_calendar_roster", "WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day), c AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT d.day, u.user_id, coalesce(n, 0) AS n FROM d CROSS JOIN (SELECT DISTINCT user_id FROM events) u LEFT JOIN c ON c.day = d.day AND c.user_id = u.user_id")
def _(t):
    rows = t.events
    counts = rows.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    # the roster is exploded over the calendar's days: no cross join
    roster = rows.select("user_id").distinct().withColumn("day", F.explode(F.expr("sequence(DATE '2024-01-01', DATE '2024-01-30')")))
    return roster.join(counts, ["day", "user_id"], "left").select("day", "user_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("J20_next_event", "SELECT event_type, nxt, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) GROUP BY 1, 2")
def _(t):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_type", nxt.alias("nxt")).groupBy("event_type", "nxt").agg(F.count("*").alias("n"))


@query("J23_band", "WITH b AS (SELECT * FROM (VALUES (1, 10, 'small'), (11, 30, 'middle'), (31, 50, 'large')) v(lo, hi, band)) SELECT band, count(*) AS parts FROM part JOIN b ON p_size BETWEEN lo AND hi GROUP BY 1")
def _(t):
    bands = t.spark.createDataFrame([(1, 10, "small"), (11, 30, "middle"), (31, 50, "large")], "lo int, hi int, band string")
    return t.part.join(bands, F.col("p_size").between(F.col("lo"), F.col("hi"))).groupBy("band").agg(F.count("*").alias("parts"))


@query("J25_attribution", """WITH s AS (SELECT event_id AS segment_id, 'U' || (user_id % 40) AS plate, ts AS s0, ts + INTERVAL 20 MINUTE AS s1 FROM events WHERE event_type = 'signup'),
t AS (SELECT 'U' || (user_id % 40) AS plate, user_id AS person, ts AS t0, ts + INTERVAL 10 MINUTE AS t1 FROM events WHERE event_type = 'purchase'),
n AS (SELECT segment_id, s0, s1, t.person, t0, t1 FROM s JOIN t ON s.plate = t.plate AND t0 < s1 + INTERVAL 240 MINUTE AND t1 > s0 - INTERVAL 240 MINUTE),
sides AS (SELECT segment_id, arg_max(person, {'a': t1, 'b': person}) FILTER (WHERE t1 <= s0) AS b, arg_min(person, {'a': t0, 'b': person}) FILTER (WHERE t0 >= s1) AS a, bool_or(t1 > s0 AND t0 < s1) AS inside FROM n GROUP BY 1),
held AS (SELECT segment_id, list(DISTINCT e.user_id) AS c FROM s JOIN events e ON e.event_type = 'view' AND 'U' || (e.user_id % 40) = s.plate AND CAST(e.ts AS DATE) BETWEEN CAST(s0 AS DATE) AND CAST(s1 AS DATE) GROUP BY 1),
old AS (SELECT segment_id, arg_max(person, {'a': t1, 'b': person}) AS p FROM s JOIN t ON s.plate = t.plate AND t1 <= s0 GROUP BY 1)
SELECT segment_id, plate, CASE WHEN b = a AND NOT inside THEN 'bracketed' WHEN p IS NOT NULL THEN 'last_trip' WHEN len(c) = 1 THEN 'sole_custodian' WHEN len(c) > 1 THEN 'ambiguous' ELSE 'unknown' END AS basis, CASE WHEN b = a AND NOT inside THEN b WHEN p IS NOT NULL THEN p WHEN len(c) = 1 THEN c[1] END AS person
FROM s LEFT JOIN sides USING (segment_id) LEFT JOIN held USING (segment_id) LEFT JOIN old USING (segment_id)""")
def _(t):
    from caravel.operators.segments import attributed

    segments = _segments(t)
    done = t.events.filter("event_type = 'purchase'").select(F.concat(F.lit("U"), F.col("user_id") % 40).alias("plate"), F.col("user_id").alias("person"), F.col("ts").alias("t_start"), (F.col("ts") + F.expr("INTERVAL '10' MINUTE")).alias("t_end"))
    custody = t.events.filter("event_type = 'view'").select(F.concat(F.lit("U"), F.col("user_id") % 40).alias("plate"), F.to_date("ts").alias("day"), F.col("user_id").alias("person")).distinct()
    return attributed(segments, done, custody).select("segment_id", "plate", "basis", "person")


@query("J28_J29_components", "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate > lag(o_orderdate) OVER w + INTERVAL 120 DAY AS apart FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), r AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY rn) AS run FROM (SELECT o.*, row_number() OVER (PARTITION BY o.o_custkey ORDER BY p.o_orderdate, o.o_orderkey) AS rn FROM o JOIN orders p USING (o_orderkey))) SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey, run) AS component FROM r QUALIFY count(*) OVER (PARTITION BY o_custkey, run) > 1")
def _(t):
    # chains of a customer's orders, each at most 120 days after the one before
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    linked = t.orders.withColumn("a", F.lag("o_orderkey").over(order)).withColumn("since", F.lag("o_orderdate").over(order))
    edges = linked.filter(F.col("o_orderdate") <= F.col("since") + F.expr("INTERVAL '120' DAY")).select("a", F.col("o_orderkey").alias("b"))
    return joins.connected(edges)


@query("W01_C09_custody", WITH_TRIPS + "SELECT plate, local_day, person_key, trips FROM (SELECT plate, local_day, person_key, count(*) AS trips, min(requested_at) AS f FROM trip_norm WHERE is_booking GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY plate, local_day ORDER BY trips DESC, f, person_key) = 1")
def _(t):
    held = norm(t).filter("is_booking").groupBy("plate", "local_day", "person_key").agg(F.count("*").alias("trips"), F.min("requested_at").alias("f"))
    order = Window.partitionBy("plate", "local_day").orderBy(F.desc("trips"), "f", "person_key")
    return held.withColumn("n", F.row_number().over(order)).filter("n = 1").select("plate", "local_day", "person_key", "trips")


@query("W02_W03_lag_lead", "SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS since_us, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS until_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: intervals.micros(c)
    return t.events.select("event_id", (us(F.col("ts")) - us(F.lag("ts").over(w))).alias("since_us"), (us(F.lead("ts").over(w)) - us(F.col("ts"))).alias("until_us"))


JOBS = "j AS (SELECT plate, local_day, hour(requested_at + INTERVAL 4 HOUR) * 60 + minute(requested_at + INTERVAL 4 HOUR) AS s, CASE WHEN CAST(ended_at + INTERVAL 4 HOUR AS DATE) > local_day THEN 1440 ELSE greatest(hour(ended_at + INTERVAL 4 HOUR) * 60 + minute(ended_at + INTERVAL 4 HOUR), hour(requested_at + INTERVAL 4 HOUR) * 60 + minute(requested_at + INTERVAL 4 HOUR)) END AS e FROM trip_norm WHERE is_booking)"


@query("W04_D11_waits", WITH_TRIPS + f", {JOBS}, g AS (SELECT *, greatest(s - max(e) OVER (PARTITION BY plate, local_day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM j) SELECT plate, local_day, count(*) AS jobs, CAST(coalesce(sum(CASE WHEN s IS NULL THEN NULL ELSE w END), 0) AS BIGINT) AS wait, CAST(coalesce(max(w), 0) AS BIGINT) AS longest_wait, CAST(max(e) - min(s) AS BIGINT) AS span, CAST(sum(greatest(e - s, 0)) AS BIGINT) AS on_job FROM g GROUP BY 1, 2")
def _(t):
    from caravel.functions import time

    rows = norm(t).filter("is_booking").select("plate", "local_day", time.minute_of_day(F.col("requested_at")).alias("s"), time.end_minute(F.col("requested_at"), F.col("ended_at")).alias("e"))
    found = intervals.waits(rows, ["plate", "local_day"], "s", "e")
    return found.select("plate", "local_day", "jobs", *[F.col(c).cast("bigint").alias(c) for c in ("wait", "longest_wait", "span", "on_job")])


SPANS = "s AS (SELECT user_id % 30 AS k, ts AS start, ts + to_minutes(CAST(10 + event_id % 50 AS INT)) AS \"end\" FROM events)"


@query("W05_A29_islands", f"WITH {SPANS}, o AS (SELECT *, CASE WHEN start > max(\"end\") OVER (PARTITION BY k ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS b FROM s), g AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS i FROM o) SELECT k, min(start) AS start, max(\"end\") AS \"end\", count(*) AS pieces FROM g GROUP BY k, i")
def _(t):
    rows = t.events.select((F.col("user_id") % 30).alias("k"), F.col("ts").alias("start"), (F.col("ts") + F.make_interval(mins=(10 + F.col("event_id") % 50).cast("int"))).alias("end"))
    return intervals.merge_spans(rows, ["k"])


@query("W06_T05_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS run FROM o) SELECT user_id, run, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY 1, 2")
def _(t):
    return intervals.gap_islands(t.events.select("user_id", "ts"), ["user_id"], "ts", 30)


@query("W07_C14_restated", f"WITH {FILINGS} SELECT id, coalesce(max(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a, FALSE) OR coalesce(min(a) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= b, FALSE) AS restated FROM f WINDOW w AS (PARTITION BY person ORDER BY a, b, id)")
def _(t):
    return intervals.restated(_filings(t), ["person"], "a", "b").select("id", "restated")


@query("W08_W09_thinned", "WITH s AS (SELECT event_id, user_id, ts, event_type, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) // 900 AS slot FROM events), k AS (SELECT *, slot IS DISTINCT FROM lag(slot) OVER w OR event_type IS DISTINCT FROM lag(event_type) OVER w OR lead(ts) OVER w IS NULL AS keep FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id, user_id FROM k WHERE keep")
def _(t):
    return intervals.thinned(t.events, ["user_id"], "ts", ["event_type"]).select("event_id", "user_id")


@query("W10_W11_totals", "SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS peers, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_mktsegment), 9) AS share FROM customer")
def _(t):
    w = Window.partitionBy("c_mktsegment")
    return t.customer.select("c_custkey", F.count("*").over(w).alias("peers"), F.round(F.col("c_acctbal") / F.sum("c_acctbal").over(w), 9).alias("share"))


@query("W12_handovers", WITH_TRIPS + ", g AS (SELECT plate, person_key, requested_at, (epoch_us(requested_at) - epoch_us(max(ended_at) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 60000000.0 AS gap, person_key IS DISTINCT FROM lag(person_key) OVER w AS changed FROM trip_norm WHERE is_booking WINDOW w AS (PARTITION BY plate ORDER BY requested_at, ended_at, person_key)) SELECT plate, count(*) FILTER (WHERE gap < 1440) AS handovers, count(*) FILTER (WHERE gap >= 1440) AS parked, round(median(gap), 4) AS median_min FROM g WHERE changed AND gap > 0 GROUP BY 1")
def _(t):
    rows = intervals.handovers(norm(t).filter("is_booking"), "plate", "person_key", "requested_at", "ended_at")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    return rows.groupBy("plate").agg(count("handover").alias("handovers"), count("parked").alias("parked"), F.round(F.percentile("gap_min", F.lit(0.5)), 4).alias("median_min"))


@query("W13_idle_chain", WITH_TRIPS + ", g AS (SELECT plate, (epoch_us(lead(requested_at) OVER w) - epoch_us(ended_at)) / 60000000.0 AS idle FROM trip_norm WHERE is_booking WINDOW w AS (PARTITION BY plate ORDER BY requested_at, external_id)) SELECT plate, count(*) AS n, round(avg(idle), 4) AS mean_idle FROM g WHERE idle BETWEEN 0 AND 240 GROUP BY 1")
def _(t):
    w = Window.partitionBy("plate").orderBy("requested_at", "external_id")
    idle = intervals.minutes_between(F.col("ended_at"), F.lead("requested_at").over(w))
    return norm(t).filter("is_booking").select("plate", idle.alias("idle")).filter("idle between 0 and 240").groupBy("plate").agg(F.count("*").alias("n"), F.round(F.avg("idle"), 4).alias("mean_idle"))


@query("W15_position", "SELECT p_partkey, p_brand, round(CAST(rank() OVER w - 1 AS DOUBLE) / nullif(count(*) OVER (PARTITION BY p_brand) - 1, 0), 6) AS position FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)")
def _(t):
    w = Window.partitionBy("p_brand")
    below = (F.rank().over(w.orderBy("p_retailprice")) - 1).cast("double")
    return t.part.select("p_partkey", "p_brand", F.round(below / F.nullif(F.count("*").over(w) - 1, F.lit(0)), 6).alias("position"))


JOURNEYS = "j AS (SELECT 'S' || l_suppkey AS plate, l_shipdate AS start, l_shipdate + to_hours(CAST(l_quantity AS INT)) AS \"end\", l_orderkey * 10 + l_linenumber AS ingested_at, l_quantity AS distance_km FROM lineitem)"


def _journeys(t):
    return t.lineitem.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("plate"), F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.make_interval(hours=F.rint("l_quantity").cast("int"))).alias("end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingested_at"), F.col("l_quantity").alias("distance_km"))


@query("W17_supersede", f"WITH {JOURNEYS}, o AS (SELECT *, CASE WHEN start < max(\"end\") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM j WINDOW w AS (PARTITION BY plate ORDER BY start, \"end\")), g AS (SELECT *, sum(b) OVER (PARTITION BY plate ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS i FROM o) SELECT plate, arg_max(ingested_at, ingested_at) AS ingested_at, count(*) AS members FROM g GROUP BY plate, i")
def _(t):
    return intervals.supersede_groups(_journeys(t)).select("plate", "ingested_at", "members")


@query("L01_L02_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(25)


@query("L03_L04_page", "WITH p AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) > 60 AS truncated FROM p WHERE n BETWEEN 41 AND 60")
def _(t):
    rows = t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(21)  # one more says whether there are more
    n = F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey"))  # over at most 21 rows
    probed = rows.withColumn("n", n).withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > 20)
    return probed.filter("n <= 20").select("c_custkey", "c_acctbal", "truncated")


@query("L05_top_per_group", "SELECT c_mktsegment, c_custkey, n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")
def _(t):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    # Spark keeps only three rows of each group on either side of the shuffle
    return t.customer.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("c_mktsegment", "c_custkey", F.col("n").cast("bigint").alias("n"))


@query("L06_distinct_keys", "SELECT DISTINCT user_id FROM events")
def _(t):
    return t.events.select("user_id").distinct()


@query("U01_U05_stacked", "SELECT kind, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM (SELECT 'order' AS kind, CAST(o_totalprice AS DECIMAL(14,2)) AS amount FROM orders UNION ALL SELECT 'line', CAST(l_extendedprice AS DECIMAL(14,2)) FROM lineitem UNION ALL SELECT 'balance', CAST(c_acctbal AS DECIMAL(14,2)) FROM customer UNION ALL SELECT 'supplier', CAST(s_acctbal AS DECIMAL(14,2)) FROM supplier UNION ALL SELECT 'event', CAST(value AS DECIMAL(14,2)) FROM events) GROUP BY 1")
def _(t):
    parts = [("order", t.orders, "o_totalprice"), ("line", t.lineitem, "l_extendedprice"), ("balance", t.customer, "c_acctbal"), ("supplier", t.supplier, "s_acctbal"), ("event", t.events, "value")]
    stacked = None
    for kind, rows, column in parts:
        one = rows.select(F.lit(kind).alias("kind"), F.col(column).cast("decimal(14,2)").alias("amount"))
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("U02_days", "SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def _(t):
    return t.orders.select(F.to_date("o_orderdate").alias("day")).union(t.lineitem.select(F.to_date("l_shipdate"))).distinct()


@query("U03_intersect", "SELECT o_custkey AS person FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    side = lambda s: t.orders.filter(f"o_orderstatus = '{s}'").select(F.col("o_custkey").alias("person"))
    return side("F").intersect(side("P"))


@query("U04_except", "SELECT l_orderkey FROM lineitem EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    a, b = t.lineitem.select("l_orderkey").distinct(), t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey")
    return a.join(b, "l_orderkey", "left_anti")


@query("U06_channel_sets", "WITH y AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE year(o_orderdate) = 1997) AS a, list(DISTINCT o_orderpriority) FILTER (WHERE year(o_orderdate) = 1998) AS b FROM orders GROUP BY 1) SELECT o_custkey, list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS gone, list_sort(list_filter(coalesce(a, []), lambda x: list_contains(coalesce(b, []), x))) AS shared FROM y")
def _(t):
    of = lambda y: F.collect_set(F.when(F.year("o_orderdate") == y, F.col("o_orderpriority")))
    rows = t.orders.groupBy("o_custkey").agg(of(1997).alias("a"), of(1998).alias("b"))
    return rows.select("o_custkey", F.array_sort(F.array_except("a", "b")).alias("gone"), F.array_sort(F.array_intersect("a", "b")).alias("shared"))
