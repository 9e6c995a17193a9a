"""Composite pipelines: driver days, segments and verdicts, tracks, findings, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caravel.functions import money, stats, time
from caravel.operators import forecast, incremental, intervals, joins, rules, segments, tracks
from caravel.plans.registry import query
from caravel.plans.rollups import norm
from caravel.sources import readers, sinks
from caravel.sources.fleet import WITH_TRIPS


@query("C03_driver_day", WITH_TRIPS + ", j AS (SELECT person_key, local_day, driver_ext_id, hour(requested_at + INTERVAL 4 HOUR) * 60 + minute(requested_at + INTERVAL 4 HOUR) AS s, CASE WHEN CAST(ended_at + INTERVAL 4 HOUR AS DATE) > local_day THEN 1440 ELSE greatest(hour(ended_at + INTERVAL 4 HOUR) * 60 + minute(ended_at + INTERVAL 4 HOUR), hour(requested_at + INTERVAL 4 HOUR) * 60 + minute(requested_at + INTERVAL 4 HOUR)) END AS e, CASE WHEN has_fare THEN price END AS fare FROM trip_norm WHERE is_booking), g AS (SELECT *, greatest(s - max(e) OVER (PARTITION BY person_key, local_day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM j) SELECT person_key, local_day, count(*) AS jobs, CAST(coalesce(sum(w), 0) AS BIGINT) AS wait, CAST(max(e) - min(s) AS BIGINT) AS span, CAST(sum(greatest(e - s, 0)) AS BIGINT) AS on_job, CAST(sum(fare) AS DOUBLE) AS fares, CASE WHEN sum(fare) IS NULL THEN 'none' ELSE 'fares' END AS money_source, mode(driver_ext_id) AS owner FROM g GROUP BY 1, 2")
def _(t):
    jobs = norm(t).filter("is_booking").select("person_key", "local_day", "driver_ext_id", time.minute_of_day(F.col("requested_at")).alias("s"), time.end_minute(F.col("requested_at"), F.col("ended_at")).alias("e"), F.when(F.col("has_fare"), F.col("price")).alias("fare"))
    key = ["person_key", "local_day"]
    work = intervals.waits(jobs, key, "s", "e")
    pay = jobs.groupBy(*key).agg(F.sum("fare").cast("double").alias("fares"))
    owners = jobs.groupBy(*key, "driver_ext_id").agg(F.count("*").alias("n")).groupBy(*key).agg(F.min_by("driver_ext_id", F.struct(-F.col("n"), "driver_ext_id")).alias("owner"))
    source = F.when(F.col("fares").isNull(), "none").otherwise("fares").alias("money_source")
    return work.join(pay, key).join(owners, key).select(*key, "jobs", *[F.col(c).cast("bigint").alias(c) for c in ("wait", "span", "on_job")], "fares", source, "owner")


def _fixes(t):
    n = F.col("event_id")
    return t.events.select(
        F.concat(F.lit("U"), F.col("user_id") % 40).alias("plate"), F.col("ts").alias("captured_at"), F.col("event_type").isin("click", "view", "purchase").alias("seat_occupied"),
        (F.col("value") % 90).alias("speed"), (n % 5 > 0).alias("ignition"), (25 + (n % 50) / 2000.0).alias("lat"), (55 + (n % 37) / 2000.0).alias("lng"), (n * 0.2).alias("odometer"),
    )


KM_SQL = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"
#: Segments `g` of `events`, a row a segment, with their kind.
SEGMENTS_SQL = f"""f AS (SELECT 'U' || (user_id % 40) AS plate, ts, event_type IN ('click', 'view', 'purchase') AS occ, value % 90 AS speed, event_id % 5 > 0 AS ign, 25 + (event_id % 50) / 2000.0 AS lat, 55 + (event_id % 37) / 2000.0 AS lng, event_id * 0.2 AS odo FROM events),
n AS (SELECT *, row_number() OVER w AS i, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM f WINDOW w AS (PARTITION BY plate ORDER BY ts, occ)),
l AS (SELECT *, max(i) FILTER (WHERE occ) OVER (PARTITION BY plate ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM n),
s AS (SELECT *, CAST(sum(CASE WHEN occ AND (prev IS NULL OR i - prev >= 3 OR gap > 600000000) THEN 1 ELSE 0 END) OVER (PARTITION BY plate ORDER BY i) AS BIGINT) AS segment FROM l),
o AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS step FROM s WHERE occ WINDOW w AS (PARTITION BY plate, segment ORDER BY i)),
h AS (SELECT *, {KM_SQL.format(a="lat0", b="lat", c="lng0", d="lng")} AS km FROM o),
a AS (SELECT plate, segment, min(ts) AS start, max(ts) AS "end", (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 AS minutes, CASE WHEN max(odo) - min(odo) > 0 AND max(odo) - min(odo) < 500 THEN max(odo) - min(odo) ELSE coalesce(sum(km), 0) END AS km, coalesce(max(speed), 0) AS top_speed, avg(CAST(ign AS DOUBLE)) AS ignition_ratio, coalesce(max(step) / 60000000.0, 0) AS max_gap, count(*) AS fixes FROM h GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN minutes > 480 OR (minutes >= 30 AND ignition_ratio < 0.2 AND top_speed < 5) THEN 'sensor_suspect' WHEN max_gap > 15 THEN 'partial' WHEN minutes < 5 OR km < 1 OR top_speed < 5 THEN 'stationary' ELSE 'candidate' END AS kind FROM a)"""


def _segments(t):
    return segments.summarised(segments.seat_segments(_fixes(t))).withColumn("kind", segments.seat_class())


@query("W18_W19_seat_segments", f"""WITH {SEGMENTS_SQL} SELECT plate, segment, start, "end", round(minutes, 4) AS minutes, round(km, 6) AS km, round(top_speed, 6) AS top_speed, round(ignition_ratio, 6) AS ignition_ratio, round(max_gap, 4) AS max_gap, fixes, kind FROM g""")
def _(t):
    rounded = [F.round(c, n).alias(c) for c, n in (("minutes", 4), ("km", 6), ("top_speed", 6), ("ignition_ratio", 6), ("max_gap", 4))]
    return _segments(t).select("plate", "segment", "start", "end", *rounded, "fixes", "kind")


@query("W17_C10_journey_verdicts", "WITH j AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS start, CASE WHEN l_linenumber <> 7 THEN l_shipdate + to_minutes(CAST(l_quantity * 12 AS INT)) END AS \"end\", l_extendedprice / 200 AS km FROM lineitem) SELECT id, CASE WHEN \"end\" IS NULL THEN 'unverifiable' WHEN epoch_us(\"end\") - epoch_us(start) > 28800000000 THEN 'suspect' WHEN km < 0 OR km >= 500 THEN 'unverifiable' WHEN epoch_us(\"end\") - epoch_us(start) < 300000000 OR km < 1 OR km < 5 * ((epoch_us(\"end\") - epoch_us(start)) / 60000000.0) / 60 THEN 'stationary' ELSE 'candidate' END AS kind FROM j")
def _(t):
    end = F.col("l_shipdate") + F.make_interval(mins=(F.col("l_quantity") * 12).cast("int"))
    rows = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("start"), F.when(F.col("l_linenumber") != 7, end).alias("end"), (F.col("l_extendedprice") / 200).alias("distance_km"))
    return rows.select("id", segments.journey_class().alias("kind"))


@query("C10_T08_reconcile", f"""WITH {SEGMENTS_SQL}, b AS (SELECT event_id, 'U' || (user_id % 40) AS plate, ts AS b0, ts + INTERVAL 10 MINUTE AS b1 FROM events WHERE event_type = 'purchase')
SELECT plate, segment, start, "end", kind, CASE WHEN kind <> 'candidate' THEN kind WHEN EXISTS (SELECT 1 FROM b WHERE b.plate = g.plate AND b0 <= g."end" + INTERVAL 15 MINUTE AND b1 >= g.start - INTERVAL 15 MINUTE) THEN 'authorized' WHEN g."end" > TIMESTAMP '2024-01-30 22:00:00' THEN 'pending' ELSE 'unauthorized' END AS verdict FROM g""")
def _(t):
    marked = _segments(t).withColumn("segment_id", F.xxhash64("plate", "segment"))
    books = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("booking_id"), F.concat(F.lit("U"), F.col("user_id") % 40).alias("plate"), F.col("ts").alias("b_start"), (F.col("ts") + F.expr("INTERVAL '10' MINUTE")).alias("b_end"), F.lit("completed").alias("outcome"))
    matched = joins.match_bookings(marked, books)
    no = F.lit(False)
    judged = segments.verdict(F.col("kind"), F.col("matched_booking"), F.lit(0), F.col("end"), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"), no, no, no)
    return matched.select("plate", "segment", "start", "end", "kind", judged.alias("verdict"))


@query("C11_count_once", "WITH s AS (SELECT event_id, 'U' || (user_id % 40) AS plate, CASE event_id % 3 WHEN 0 THEN 'fms_trip' WHEN 1 THEN 'cabman' ELSE 'fms_live' END AS source, event_id % 3 AS r, event_type AS verdict, ts AS a, ts + INTERVAL 25 MINUTE AS b FROM events) SELECT event_id, plate, source FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.plate = x.plate AND y.verdict = x.verdict AND y.r < x.r AND y.a < x.b AND y.b > x.a)")
def _(t):
    source = F.when(F.col("event_id") % 3 == 0, "fms_trip").when(F.col("event_id") % 3 == 1, "cabman").otherwise("fms_live")
    rows = t.events.select("event_id", F.concat(F.lit("U"), F.col("user_id") % 40).alias("plate"), source.alias("source"), F.col("event_type").alias("verdict"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL '25' MINUTE")).alias("end"))
    return intervals.count_once(rows, {"fms_trip": 0, "cabman": 1, "fms_live": 2}).select("event_id", "plate", "source")


def _points(t):
    n = F.col("event_id")
    return t.events.select(F.lit("fms").alias("source"), F.concat(F.lit("U"), F.col("user_id") % 25).alias("plate"), F.col("ts").alias("at"), (25 + F.floor(n / 40) % 9 / 300.0).alias("lat"), (55 + F.floor(n / 60) % 7 / 300.0).alias("lng"), (F.col("value").cast("decimal(12,2)") % 6).cast("double").alias("speed"))


@query("W20_legs", "WITH f AS (SELECT 'U' || (user_id % 25) AS plate, ts, 25 + (event_id // 40) % 9 / 300.0 AS lat, 55 + (event_id // 60) % 7 / 300.0 AS lng FROM events), l AS (SELECT *, lead(ts) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM f WINDOW w AS (PARTITION BY plate ORDER BY ts)), d AS (SELECT plate, (epoch_us(t2) - epoch_us(ts)) / 60000000.0 AS gap, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng) / 2), 2), 1.0))) AS km FROM l WHERE t2 IS NOT NULL) SELECT plate, CASE WHEN gap > 1440 THEN 'silent' WHEN km <= 0.15 THEN CASE WHEN gap <= 30 THEN 'still' ELSE 'parked' END WHEN gap <= 20 THEN 'moving' ELSE 'moved' END AS kind, count(*) AS n FROM d GROUP BY 1, 2")
def _(t):
    return tracks.legs(_points(t)).groupBy("plate", "kind").agg(F.count("*").alias("n"))


@query("W21_stays", f"""WITH RECURSIVE f AS (SELECT 'U' || (user_id % 25) AS plate, CAST(ts + INTERVAL 4 HOUR AS DATE) AS day, ts, 25 + (event_id // 40) % 9 / 300.0 AS lat, 55 + (event_id // 60) % 7 / 300.0 AS lng FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY plate, day ORDER BY ts) AS i FROM f),
r AS (SELECT plate, day, i, ts, lat AS alat, lng AS alng, 1 AS run FROM n WHERE i = 1 UNION ALL
  SELECT n.plate, n.day, n.i, n.ts, CASE WHEN {KM_SQL.format(a="alat", b="n.lat", c="alng", d="n.lng")} > 0.15 THEN n.lat ELSE alat END, CASE WHEN {KM_SQL.format(a="alat", b="n.lat", c="alng", d="n.lng")} > 0.15 THEN n.lng ELSE alng END,
    run + CASE WHEN {KM_SQL.format(a="alat", b="n.lat", c="alng", d="n.lng")} > 0.15 THEN 1 ELSE 0 END FROM r JOIN n ON n.plate = r.plate AND n.day = r.day AND n.i = r.i + 1)
SELECT plate, day AS local_day, min(ts) AS start, max(ts) AS "end", round(any_value(alat), 6) AS lat, round(any_value(alng), 6) AS lng, count(*) AS fixes FROM r GROUP BY plate, day, run HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 600000000""")
def _(t):
    return tracks.stays(_points(t)).withColumn("lat", F.round("lat", 6)).withColumn("lng", F.round("lng", 6))


@query("W22_C20_day_tiles", f"""WITH f AS (SELECT 'U' || (user_id % 25) AS plate, CAST(ts + INTERVAL 4 HOUR AS DATE) AS day, ts, 25 + (event_id // 40) % 9 / 300.0 AS lat, 55 + (event_id // 60) % 7 / 300.0 AS lng FROM events),
l AS (SELECT *, lead(ts) OVER w AS t2, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM f WINDOW w AS (PARTITION BY plate, day ORDER BY ts)),
d AS (SELECT *, (epoch_us(t2) - epoch_us(ts)) / 60000000.0 AS gap, {KM_SQL.format(a="lat", b="lat2", c="lng", d="lng2")} AS km FROM l WHERE t2 IS NOT NULL),
a AS (SELECT plate, day, ts AS start, t2 AS "end", CASE WHEN gap > 1440 THEN 'silent' WHEN km <= 0.15 THEN CASE WHEN gap <= 30 THEN 'still' ELSE 'parked' END WHEN gap <= 20 THEN 'moving' ELSE 'moved' END AS kind FROM d
  UNION ALL SELECT plate, day, CAST(day AS TIMESTAMP) - INTERVAL 4 HOUR, min(ts), 'unknown' FROM f GROUP BY 1, 2 UNION ALL SELECT plate, day, max(ts), CAST(day AS TIMESTAMP) + INTERVAL 20 HOUR, 'unknown' FROM f GROUP BY 1, 2)
SELECT plate, day AS local_day, start, "end", kind, round((epoch_us("end") - epoch_us(start)) / 60000000.0, 4) AS minutes FROM a WHERE "end" > start""")
def _(t):
    return tracks.day_tiles(_points(t)).withColumn("minutes", F.round("minutes", 4))


@query("W23_C21_night", "WITH f AS (SELECT 'U' || (user_id % 25) AS plate, ts, hour(ts + INTERVAL 4 HOUR) < 5 AS i FROM events), m AS (SELECT *, lead(i) OVER w AS a, lag(i) OVER w AS b FROM f WINDOW w AS (PARTITION BY plate ORDER BY ts)) SELECT plate, CASE WHEN i THEN 'night' WHEN coalesce(a, FALSE) THEN 'before' ELSE 'after' END AS edge, count(*) AS n FROM m WHERE i OR coalesce(a, FALSE) OR coalesce(b, FALSE) GROUP BY 1, 2")
def _(t):
    return tracks.night_fixes(_points(t)).groupBy("plate", "edge").agg(F.count("*").alias("n"))


@query("W14_dwell_spots", "WITH f AS (SELECT 'U' || (user_id % 25) AS plate, ts, round(25 + (event_id // 40) % 9 / 300.0, 3) AS a, round(55 + (event_id // 60) % 7 / 300.0, 3) AS b, CAST(value AS DECIMAL(12,2)) % 6 < 2 AS still FROM events), l AS (SELECT *, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 60000000.0 AS gap, lead(still) OVER w AND lead(a) OVER w = a AND lead(b) OVER w = b AS same FROM f WINDOW w AS (PARTITION BY plate ORDER BY ts)) SELECT a AS spot_lat, b AS spot_lng, count(*) AS fixes, round(sum(coalesce(least(gap, CASE WHEN same THEN 10080 ELSE 5 END), 0)) / 60, 4) AS hours FROM l WHERE still GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY hours DESC LIMIT 60")
def _(t):
    return tracks.dwell_spots(_points(t)).select("spot_lat", "spot_lng", "fixes", F.round("hours", 4).alias("hours"))


@query("C12_findings", WITH_TRIPS + ", p AS (SELECT person_key, count(outcome) AS jobs, count(*) FILTER (WHERE outcome = 'not_completed') / CAST(nullif(count(outcome), 0) AS DOUBLE) AS rate FROM trip_norm WHERE is_booking AND person_key IS NOT NULL GROUP BY 1) SELECT 'cancellations' AS code, person_key AS entity, CASE WHEN rate > 0.15 THEN 'critical' ELSE 'warning' END AS severity, round(rate, 4) AS figure FROM p WHERE jobs > 50 AND rate >= 0.10 UNION ALL SELECT 'partner_concentration', product, 'info', round(n / CAST(total AS DOUBLE), 4) FROM (SELECT product, count(*) AS n, sum(count(*)) OVER () AS total FROM trip_norm WHERE is_booking GROUP BY 1) WHERE n >= 0.4 * total UNION ALL SELECT 'idle_vehicle', plate, 'warning', CAST(date_diff('day', last_day, today) AS DOUBLE) FROM (SELECT plate, max(local_day) FILTER (WHERE is_booking) AS last_day, (SELECT max(local_day) FROM trip_norm) AS today FROM trip_norm GROUP BY 1) WHERE coalesce(date_diff('day', last_day, today), 9999) >= 14 UNION ALL SELECT 'volume_trend', platform, CASE WHEN now < before THEN 'warning' ELSE 'info' END, round((now - before) / CAST(before AS DOUBLE), 4) FROM (SELECT platform, count(*) FILTER (WHERE age < 28) AS now, count(*) FILTER (WHERE age BETWEEN 28 AND 55) AS before FROM (SELECT platform, date_diff('day', local_day, (SELECT max(local_day) FROM trip_norm WHERE is_booking)) AS age FROM trip_norm WHERE is_booking) GROUP BY 1) WHERE before > 0 AND abs(now - before) / CAST(before AS DOUBLE) >= 0.2")
def _(t):
    rows = norm(t)
    return rules.all_findings([rules.cancellations(rows), rules.partner_concentration(rows), rules.idle_vehicles(rows), rules.volume_trend(rows)])


@query("C17_supply_balance", "WITH d AS (SELECT CAST(dayofweek(ts + INTERVAL 4 HOUR) AS INT) AS dow, CAST(hour(ts + INTERVAL 4 HOUR) AS INT) AS hour, event_type, user_id FROM events) SELECT dow, hour, count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS supply, count(*) FILTER (WHERE event_type = 'purchase') AS demand, round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(CAST(count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS DOUBLE), 0), 6) AS pressure FROM d GROUP BY 1, 2")
def _(t):
    rows = t.events.select(time.local_dow(F.col("ts")).alias("dow"), time.local_hour(F.col("ts")).alias("hour"), "event_type", "user_id")
    supply, demand = F.countDistinct(F.when(F.col("event_type") == "view", F.col("user_id"))), F.count(F.when(F.col("event_type") == "purchase", 1))
    return rows.groupBy("dow", "hour").agg(supply.alias("supply"), demand.alias("demand"), F.round(demand / F.nullif(supply, F.lit(0)), 6).alias("pressure"))


@query("C18_low_performers", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS trips, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS money, count(*) / 4.0 AS hours FROM events GROUP BY 1, 2),
p AS (SELECT user_id AS person, count(*) FILTER (WHERE trips > 0) AS driven, count(*) FILTER (WHERE trips = 0) AS off, sum(hours) AS hours, sum(money) AS money, sum(trips) AS trips FROM d GROUP BY 1 HAVING driven >= 3),
m AS (SELECT person, driven, CAST(off AS DOUBLE) / (off + driven) AS off_share, CAST(hours AS DOUBLE) / driven AS hours_day, money / nullif(CAST(hours AS DOUBLE), 0) AS money_hour, CAST(trips AS DOUBLE) / driven AS trips_day FROM p),
q AS (SELECT quantile_cont(off_share, 0.5) AS a, quantile_cont(hours_day, 0.5) AS b, quantile_cont(money_hour, 0.5) AS c, quantile_cont(trips_day, 0.5) AS d FROM m),
r AS (SELECT m.*, list_filter([CASE WHEN off_share >= greatest(0.25, 2 * a) THEN 'days_off' END, CASE WHEN hours_day < 0.75 * b THEN 'short_days' END, CASE WHEN money_hour < 0.85 * c THEN 'low_rate' END, CASE WHEN trips_day < 0.75 * d THEN 'few_trips' END], lambda x: x IS NOT NULL) AS causes FROM m, q)
SELECT person, driven, round(off_share, 6) AS off_share, round(hours_day, 6) AS hours_day, round(money_hour, 4) AS money_hour, round(trips_day, 6) AS trips_day, causes FROM r WHERE len(causes) > 0""")
def _(t):
    days = t.events.groupBy(F.col("user_id").alias("person"), F.to_date("ts").alias("day")).agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("trips"), F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("money"), (F.count("*") / 4).alias("hours"))
    low = rules.low_performers(days.withColumn("active", F.col("trips") > 0))
    return low.select("person", "driven", *[F.round(c, n).alias(c) for c, n in (("off_share", 6), ("hours_day", 6), ("money_hour", 4), ("trips_day", 6))], "causes")


@query("C19_target_month", "WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS earned FROM events GROUP BY 1) SELECT day, round(100000.0 * 1 / count(*) OVER (), 4) AS plan, round(sum(earned) OVER (ORDER BY day), 2) AS earned_so_far, round(sum(earned) OVER (ORDER BY day) / (100000.0 / count(*) OVER () * row_number() OVER (ORDER BY day)), 4) AS pace FROM d")
def _(t):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("earned")).withColumn("target", F.lit(100000.0)).withColumn("weight", F.lit(1.0))
    rows = forecast.target_month(days, "day", "earned", "target", "weight")
    return rows.select("day", F.round("plan", 4).alias("plan"), F.round("earned_so_far", 2).alias("earned_so_far"), F.round("pace", 4).alias("pace"))


@query("C24_weekly_rebuild", "SELECT l_suppkey AS driver, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS fares, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS fees FROM lineitem GROUP BY 1, 2")
def _(t):
    part = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice").cast("decimal(14,2)"))).cast("double")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("driver"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")).agg(part("A").alias("fares"), part("R").alias("fees"))


@query("C25_two_way_match", "WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS other, o_custkey AS c, o_orderdate AS d FROM orders WHERE o_orderstatus <> 'F'), j AS (SELECT o_orderkey, other, count(*) OVER (PARTITION BY o_orderkey) AS x, count(*) OVER (PARTITION BY other) AS y FROM a JOIN b ON o_orderdate = d AND o_custkey % 50 = c % 50) SELECT o_orderkey, other, x = 1 AND y = 1 AS matched FROM j")
def _(t):
    a = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 50).alias("k"))
    b = t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("other"), "o_orderdate", (F.col("o_custkey") % 50).alias("k"))
    # an order's counterparts are those of its day and k: counted there, not over the pairs
    on = ["o_orderdate", "k"]
    alone = a.groupBy(*on).agg(F.count("*").alias("x")).join(b.groupBy(*on).agg(F.count("*").alias("y")), on).select(*on, ((F.col("x") == 1) & (F.col("y") == 1)).alias("matched"))
    return a.join(alone, on).join(b, on).select("o_orderkey", "other", "matched")


@query("C26_set_audit", "WITH ours AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority <> '1-URGENT'), theirs AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority <> '5-LOW') SELECT coalesce(o.day, t.day) AS day, count(*) FILTER (WHERE o.k IS NULL) AS missing, count(*) FILTER (WHERE t.k IS NULL) AS extra, round(100.0 * count(*) FILTER (WHERE o.k IS NOT NULL AND t.k IS NOT NULL) / count(*), 1) AS agreement_pct FROM ours o FULL JOIN theirs t ON o.k = t.k GROUP BY 1")
def _(t):
    side = lambda rest, n: t.orders.filter(F.col("o_orderpriority") != rest).select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias(f"{n}_day"), F.lit(True).alias(n))
    both = side("1-URGENT", "ours").join(side("5-LOW", "theirs"), "k", "full_outer")
    count = lambda p: F.count(F.when(p, 1))
    ours, theirs = F.col("ours").isNotNull(), F.col("theirs").isNotNull()
    return both.groupBy(F.coalesce("ours_day", "theirs_day").alias("day")).agg(count(~ours).alias("missing"), count(~theirs).alias("extra"), F.round(100 * count(ours & theirs) / F.count("*"), 1).alias("agreement_pct"))


@query("C27_document_expiry", "SELECT CASE WHEN d < 0 THEN 'expired' WHEN d <= 30 THEN 'd30' WHEN d <= 45 THEN 'd45' WHEN d <= 90 THEN 'd90' ELSE 'ok' END AS status, count(*) AS n FROM (SELECT date_diff('day', DATE '2001-07-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem) GROUP BY 1")
def _(t):
    left = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("2001-07-01")))
    return t.lineitem.groupBy(money.document_status(left).alias("status")).agg(F.count("*").alias("n"))


@query("C28_unusual_days", "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, list_sort(list(n) OVER (PARTITION BY isodow(day) ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS past FROM d) SELECT day, n, (past[2] + past[3]) / 2.0 AS median, n > (past[2] + past[3]) / 2.0 AS above FROM p WHERE len(past) = 4 AND (n < past[1] OR n > past[4]) AND abs(n - (past[2] + past[3]) / 2.0) >= 0.1 * (past[2] + past[3]) / 2.0")
def _(t):
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return rules.unusual_days(days, "day", "n")


@query("S03_csv_payments", "WITH r AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS trip_id, CASE l_returnflag WHEN 'A' THEN 'fare adjustment' WHEN 'N' THEN 'trip' ELSE 'payout' END AS kind, CAST(l_extendedprice AS DECIMAL(14,2)) AS v FROM lineitem) SELECT trip_id, CAST(sum(v) FILTER (WHERE kind = 'trip') AS DOUBLE) AS earnings, CAST(sum(v) FILTER (WHERE kind = 'fare adjustment') AS DOUBLE) AS adjustments FROM r WHERE trip_id IS NOT NULL AND kind <> 'payout' GROUP BY 1")
def _(t):
    v = F.col("l_extendedprice").cast("decimal(14,2)")
    rows = t.lineitem.select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey").cast("string")).alias("trip_id"), F.when(F.col("l_returnflag") == "A", "fare adjustment").when(F.col("l_returnflag") == "N", "trip").otherwise("payout").alias("kind"),
        *[v.alias(c) for c in ("fare", "earnings", "fee", "cash", "tip")],
    )
    paid, _settled = readers.csv_payments(rows)
    return paid.select(F.col("trip_id").cast("bigint").alias("trip_id"), F.col("earnings").cast("double").alias("earnings"), F.col("adjustments").cast("double").alias("adjustments"))


@query("S13_plan_days", "WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day), a AS (SELECT unnest(['OMDB', 'OMDW']) AS airport), c AS (SELECT CASE WHEN event_type = 'signup' THEN 'OMDW' ELSE 'OMDB' END AS airport, CAST(ts AS DATE) AS day, max(value) > CASE WHEN event_type = 'signup' THEN 200 ELSE 300 END AS complete FROM events GROUP BY event_type = 'signup', 1, 2, event_type) SELECT day, airport FROM d, a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.day = d.day AND c.airport = a.airport AND complete)")
def _(t):
    from datetime import date

    # a day of an airport is complete once some of its landings are large
    airport = F.when(F.col("event_type") == "signup", "OMDW").otherwise("OMDB").alias("airport")
    covered = t.events.groupBy(airport, F.to_date("ts").alias("day"), "event_type").agg((F.max("value") > F.when(F.col("event_type") == "signup", 200).otherwise(300)).alias("complete")).drop("event_type")
    return readers.plan_days(t.spark, date(2024, 1, 1), date(2024, 1, 30), ["OMDB", "OMDW"], covered)


@query("S22_S23_upsert", "WITH b AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey + 10000000, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0) SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey, round(coalesce(b.c_acctbal, c.c_acctbal), 2) AS c_acctbal, coalesce(b.c_mktsegment, c.c_mktsegment) AS c_mktsegment, b.c_custkey IS NOT NULL AS changed FROM customer c FULL JOIN b ON c.c_custkey = b.c_custkey")
def _(t):
    table = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    batch = table.filter("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(table.filter("c_acctbal < 0").withColumn("c_custkey", F.col("c_custkey") + 10000000))
    return sinks.upserted(table, batch.withColumn("seen", F.lit(1)), ["c_custkey"], "seen").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("S24_replace_window", "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS money FROM (SELECT o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') UNION ALL SELECT o_orderstatus, 1.0 FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01') GROUP BY 1")
def _(t):
    inside = (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")) & (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
    table = sinks.replaced_window(t.orders, t.orders.filter(inside).withColumn("o_totalprice", F.lit(1.0)), inside)
    return table.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("money"))


@query("S25_fitting_days", "SELECT day, n, CAST(running AS BIGINT) AS running FROM (SELECT day, n, sum(n) OVER (ORDER BY day DESC) AS running FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)) WHERE running <= 2000")
def _(t):
    return sinks.fitting_days(t.events.withColumn("day", F.to_date("ts")), "day", 2000)


@query("S28_replace_day", "WITH l AS (SELECT event_id AS icao24, ts AS landed_at FROM events), f AS (SELECT icao24, landed_at FROM l WHERE CAST(landed_at AS DATE) = DATE '2024-01-05' AND icao24 % 2 = 0) SELECT CAST(landed_at AS DATE) AS day, count(*) AS n FROM (SELECT * FROM l WHERE CAST(landed_at AS DATE) <> DATE '2024-01-05' UNION ALL SELECT * FROM f) GROUP BY 1")
def _(t):
    landings = t.events.select(F.col("event_id").alias("icao24"), F.col("ts").alias("landed_at"))
    day = F.to_date(F.lit("2024-01-05"))
    fresh = landings.filter((F.to_date("landed_at") == day) & (F.col("icao24") % 2 == 0))
    return sinks.replaced_day(landings, fresh, day).groupBy(F.to_date("landed_at").alias("day")).agg(F.count("*").alias("n"))


@query("T04_T06_windows", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    grouped = t.events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("T06_sliding_days", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, CAST(sum(n) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS last7 FROM d")
def _(t):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))  # one row a day
    w = Window.partitionBy(F.lit(1)).orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return days.withColumn("last7", F.sum("n").over(w))


@query("T07_T12_refresh", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, CASE WHEN o_orderdate < TIMESTAMP '1999-03-01' THEN 'old' ELSE 'fresh' END AS of, count(*) AS n FROM orders GROUP BY 1, 2")
def _(t):
    from datetime import date

    rows = t.orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("bucket")).agg(F.count("*").alias("n"))
    since = incremental.snap(date(1999, 3, 17), "month")
    return incremental.refreshed(rows.withColumn("of", F.lit("old")), rows.withColumn("of", F.lit("fresh")), "bucket", since).select("bucket", "of", "n")


@query("T12_swept", "WITH s AS (SELECT event_id, user_id % 40 AS plate, date_trunc('hour', ts) AS a, date_trunc('hour', ts) + to_minutes(CAST(event_id % 9 * 20 AS INT)) AS b FROM events) SELECT event_id FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.plate = x.plate AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b))")
def _(t):
    start = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = t.events.select("event_id", (F.col("user_id") % 40).alias("plate"), start.alias("start"), (start + F.make_interval(mins=(F.col("event_id") % 9 * 20).cast("int"))).alias("end"))
    return sinks.swept(rows).select("event_id")


@query("T09_supersede", "WITH l AS (SELECT event_id AS id, event_type AS airport, user_id % 20 AS icao24, ts FROM events WHERE value < 50), c AS (SELECT event_id AS confirmed_id, event_type AS airport, user_id % 20 AS icao24, ts AS c_at FROM events WHERE value >= 50), n AS (SELECT id, confirmed_id FROM l JOIN c USING (airport, icao24) WHERE abs(epoch_us(ts) - epoch_us(c_at)) <= 1800000000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(epoch_us(ts) - epoch_us(c_at)), c_at) = 1), d AS (SELECT DISTINCT airport, CAST(c_at AS DATE) AS day FROM c) SELECT l.id, d.day IS NOT NULL AS superseded, CASE WHEN d.day IS NOT NULL THEN confirmed_id END AS confirmed_id FROM l LEFT JOIN d ON l.airport = d.airport AND CAST(ts AS DATE) = d.day LEFT JOIN n USING (id)")
def _(t):
    rows = t.events.select("event_id", "value", F.col("event_type").alias("airport"), (F.col("user_id") % 20).alias("icao24"), F.col("ts").alias("landed_at"))
    live = rows.filter("value < 50").withColumnRenamed("event_id", "id")
    confirmed = rows.filter("value >= 50").withColumnRenamed("event_id", "confirmed_id")
    return incremental.superseded(live, confirmed).select("id", "superseded", "confirmed_id")


@query("T10_T11_latest_state", "SELECT user_id, max(ts) AS at, arg_max(event_type, {'a': ts, 'b': event_type}) AS status FROM events GROUP BY 1")
def _(t):
    from caravel.streaming.status import latest_state

    rows = t.events.select("user_id", F.col("ts").alias("at"), F.col("event_type").alias("status")).dropDuplicates(["user_id", "at", "status"])
    return latest_state(rows, ["user_id"], "at")


@query("T13_retention", "WITH s AS (SELECT event_id, user_id, ts, event_type, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) // 900 AS slot FROM events), k AS (SELECT *, slot IS DISTINCT FROM lag(slot) OVER w OR event_type IS DISTINCT FROM lag(event_type) OVER w OR lead(ts) OVER w IS NULL AS keep FROM s WHERE ts < TIMESTAMP '2024-01-20' WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT event_id FROM k WHERE keep UNION ALL SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def _(t):
    return incremental.retained(t.events, ["user_id"], "ts", ["event_type"], F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")).select("event_id")


@query("M12_bonferroni", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT user_id, avg(n) AS e, stddev_samp(n) AS sd, max(n) AS m FROM d GROUP BY 1),
z AS (SELECT user_id, (m - e) / nullif(greatest(sqrt(e), sd), 0) AS surprise FROM g), t AS (SELECT count(surprise) AS tests, sqrt(-2 * ln(0.05 / count(surprise) / 2)) AS q FROM z)
SELECT user_id, tests, round(surprise, 6) AS surprise, round(abs((((((-7.784894002430293e-03 * q - 3.223964580411365e-01) * q - 2.400758277161838) * q - 2.549732539343734) * q + 4.374664141464968) * q + 2.938163982698783) / ((((7.784695709041462e-03 * q + 3.224671290700398e-01) * q + 2.445134137142996) * q + 3.754408661907416) * q + 1)), 6) AS bound,
  surprise > abs((((((-7.784894002430293e-03 * q - 3.223964580411365e-01) * q - 2.400758277161838) * q - 2.549732539343734) * q + 4.374664141464968) * q + 2.938163982698783) / ((((7.784695709041462e-03 * q + 3.224671290700398e-01) * q + 2.445134137142996) * q + 3.754408661907416) * q + 1)) AS surprising FROM z, t""")
def _(t):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    per = days.groupBy("user_id").agg(F.avg("n").alias("e"), F.stddev_samp("n").alias("sd"), F.max("n").alias("m"))
    found = per.select("user_id", stats.surprise(F.col("m"), F.col("e"), F.col("sd")).alias("surprise"))
    tests = found.agg(F.count("surprise").alias("tests")).withColumn("bound", stats.family_z(F.col("tests")))  # one row
    rows = found.crossJoin(F.broadcast(tests))
    return rows.select("user_id", "tests", F.round("surprise", 6).alias("surprise"), F.round("bound", 6).alias("bound"), (F.col("surprise") > F.col("bound")).alias("surprising"))
