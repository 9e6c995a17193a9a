"""Segments judged with all their guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.operators import attribution, reconcile
from caravel.plans.domain import KM_SQL
from caravel.plans.registry import query

CARS_SQL = """e AS (SELECT *, event_id // 700 AS car, event_id % 700 AS k FROM events),
f AS (SELECT 'U' || car AS plate, CASE WHEN car % 5 < 3 THEN 'cabman' WHEN car % 5 = 3 THEN 'fms' ELSE 'beacon' END AS source, 'F' || (car % 3) AS fleet_id, car, event_id, event_type,
  TIMESTAMP '2024-01-01' + to_days(CAST(car % 28 AS INT)) + to_minutes(CAST(k * 4 + event_id % 3 + CASE WHEN k >= 350 THEN 25 ELSE 0 END AS INT)) AS ts, (event_id // 5) % 3 <> 0 AS occ, value % 90 AS speed, event_id % 5 > 0 AS ign, 25 + (event_id % 50) / 2000.0 AS lat, 55 + (event_id % 37) / 2000.0 AS lng, event_id * 0.6 AS odo FROM e),
p AS (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 10) AS BIGINT) AS pass, CASE WHEN event_id % 11 > 0 THEN ts + to_minutes(CAST(CASE WHEN event_id % 50 = 0 THEN -90 WHEN source = 'beacon' THEN 61 + event_id % 30 ELSE event_id % 7 END AS INT)) END AS polled FROM f)"""


def moving_fixes(t):
    """Events as fixes every four minutes of cars that each have 700 of them."""
    key = F.col("event_id")
    car, k = F.floor(key / 700), key % 700
    minutes = k * 4 + key % 3 + F.when(k >= 350, 25).otherwise(0)
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_interval(days=(car % 28).cast("int"), mins=minutes.cast("int"))
    source = F.when(car % 5 < 3, "cabman").when(car % 5 == 3, "fms").otherwise("beacon")
    lag = F.when(key % 50 == 0, -90).when(car % 5 == 4, 61 + key % 30).otherwise(key % 7)
    return t.events.select(
        F.concat(F.lit("U"), car).alias("plate"), source.alias("source"), F.concat(F.lit("F"), car % 3).alias("fleet_id"), at.alias("captured_at"), F.when(key % 11 > 0, at + F.make_interval(mins=lag.cast("int"))).alias("polled_at"),
        (F.floor(key / 5) % 3 != 0).alias("seat_occupied"), (F.col("value") % 90).alias("speed"), (key % 5 > 0).alias("ignition"), (25 + (key % 50) / 2000.0).alias("lat"), (55 + (key % 37) / 2000.0).alias("lng"), (key * 0.6).alias("odometer"),
        "event_id", "event_type", F.floor(F.datediff(F.to_date(at), F.lit("2024-01-01")) / 10).cast("bigint").alias("pass"),
    )


@query("C10_T08_guarded_verdicts", f"""WITH {CARS_SQL},
n AS (SELECT *, row_number() OVER w AS i, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0 AS gap FROM p WINDOW w AS (PARTITION BY plate ORDER BY ts, occ)),
l AS (SELECT *, max(i) FILTER (WHERE occ) OVER (PARTITION BY plate ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, CASE WHEN lead(occ) OVER w THEN lead(gap) OVER w ELSE lead(gap, 2) OVER w END AS gap_to FROM n WINDOW w AS (PARTITION BY plate ORDER BY i)),
s AS (SELECT *, CAST(sum(CASE WHEN occ AND (prev IS NULL OR i - prev >= 3 OR gap > 10) THEN 1 ELSE 0 END) OVER (PARTITION BY plate ORDER BY i) AS BIGINT) AS segment FROM l),
o AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60000000.0 AS step FROM s WHERE occ WINDOW w AS (PARTITION BY plate, segment ORDER BY i)),
a AS (SELECT plate, any_value(source) AS source, any_value(fleet_id) AS fleet_id, segment, min(ts) AS start, max(ts) AS "end", (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 AS minutes, CASE WHEN max(odo) - min(odo) > 0 AND max(odo) - min(odo) < 500 THEN max(odo) - min(odo) ELSE coalesce(sum({KM_SQL.format(a="lat0", b="lat", c="lng0", d="lng")}), 0) END AS km,
  max(speed) AS top_speed, avg(CAST(ign AS DOUBLE)) AS ratio, coalesce(max(step), 0) AS gap, arg_min(gap, i) FILTER (WHERE gap IS NOT NULL OR i = 1) AS g0, min(i) AS i0, max(i) AS i1 FROM o GROUP BY plate, segment),
b AS (SELECT a.*, x.gap AS gap_before, y.gap_to AS gap_after FROM a JOIN l x ON x.plate = a.plate AND x.i = i0 JOIN l y ON y.plate = a.plate AND y.i = i1),
k AS (SELECT *, greatest(gap, coalesce(gap_before, 0), coalesce(gap_after, 0)) AS max_gap, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(start AS DATE)) / 10) AS BIGINT) AS pass FROM b),
c AS (SELECT *, CASE WHEN minutes > 480 OR (minutes >= 30 AND ratio < 0.2 AND top_speed < 5) THEN 'sensor_suspect' WHEN max_gap > 15 THEN 'partial' WHEN minutes < 5 OR km < 1 OR top_speed < 5 THEN 'stationary' ELSE 'candidate' END AS kind, TIMESTAMP '2024-01-01' + to_days(CAST(10 * (pass + 1) AS INT)) AS until FROM k),
bk AS (SELECT event_id AS id, plate, pass, ts AS b0, ts + INTERVAL 10 MINUTE AS b1, (event_id // 15) % 4 = 0 AS done, fleet_id, CASE WHEN pass = 0 AND event_id % 4 = 0 THEN 'yango' WHEN event_id % 3 = 0 AND fleet_id <> 'F2' THEN 'hotel' WHEN event_id % 3 = 1 THEN 'bolt' ELSE 'uber' END AS platform FROM p WHERE event_type = 'purchase'),
lg AS (SELECT source, pass, list_sort(list(lag))[count(*) // 2 + 1] AS lag FROM (SELECT source, pass, (epoch_us(polled) - epoch_us(ts)) / 60000000.0 AS lag FROM p) WHERE lag > -60 GROUP BY 1, 2),
un AS (SELECT pass, list_sort(list(platform)) AS unread FROM (SELECT pass, platform FROM (SELECT DISTINCT pass FROM p), (SELECT DISTINCT platform FROM bk) EXCEPT SELECT pass, platform FROM bk) GROUP BY 1),
m AS (SELECT c.plate, segment, arg_min(id, (b0, id)) AS booking FROM c JOIN bk ON bk.plate = c.plate AND done AND b0 <= c."end" + INTERVAL 15 MINUTE AND b1 >= c.start - INTERVAL 15 MINUTE GROUP BY 1, 2),
j AS (SELECT c.*, booking, lag, coalesce(unread, []) AS unread, gap_before IS NULL OR gap_after IS NULL AS edge, (epoch_us(until) - epoch_us("end")) / 60000000.0 < 120 AS late, c.fleet_id IN ('F0', 'F1', 'F2') AND c.fleet_id NOT IN (SELECT fleet_id FROM bk WHERE platform = 'hotel') AND EXISTS (SELECT 1 FROM bk WHERE platform = 'hotel') AS never FROM c LEFT JOIN m USING (plate, segment) LEFT JOIN lg USING (source, pass) LEFT JOIN un USING (pass))
SELECT plate, segment, source, fleet_id, pass, start, "end", round(gap_before, 4) AS gap_before, round(gap_after, 4) AS gap_after, kind, booking AS matched_booking,
  CASE WHEN kind <> 'candidate' THEN kind WHEN booking IS NOT NULL THEN 'authorized' WHEN lag > 60 THEN 'unverifiable' WHEN late THEN 'pending' WHEN edge OR len(unread) > 0 OR never THEN 'unverifiable' ELSE 'unauthorized' END AS verdict,
  CASE WHEN kind <> 'candidate' THEN 'classified ' || kind WHEN booking IS NOT NULL THEN 'matched booking ' || booking WHEN lag > 60 THEN 'clock is behind by minutes: ' || CAST(round(lag) AS INT) WHEN late THEN 'bookings may not have arrived' WHEN edge THEN 'runs past the edge of the record' WHEN len(unread) > 0 THEN 'no bookings read from ' || array_to_string(unread, ',') WHEN never THEN 'the fleet''s hotel account was never read' ELSE 'no booking on any channel' END AS reason FROM j""")
def _(t):
    fixes = moving_fixes(t)
    platform = F.when((F.col("pass") == 0) & (F.col("event_id") % 4 == 0), "yango").when((F.col("event_id") % 3 == 0) & (F.col("fleet_id") != "F2"), "hotel").when(F.col("event_id") % 3 == 1, "bolt").otherwise("uber")
    outcome = F.when(F.floor(F.col("event_id") / 15) % 4 == 0, "completed").otherwise("not_completed")
    bookings = fixes.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("booking_id"), "plate", platform.alias("platform"), "fleet_id", "pass", F.col("captured_at").alias("b_start"), (F.col("captured_at") + F.expr("INTERVAL '10' MINUTE")).alias("b_end"), outcome.alias("outcome")
    )
    found = reconcile.judged(fixes, bookings, fixes.select("fleet_id").distinct(), 10, "2024-01-01")
    return found.withColumns({c: F.round(c, 4) for c in ("gap_before", "gap_after")})


@query("J25_ladder", """WITH s AS (SELECT event_id AS segment_id, 'U' || (user_id % 40) AS plate, ts AS s0, ts + INTERVAL 20 MINUTE AS s1, CASE WHEN event_id % 9 = 0 THEN 90 ELSE event_id % 7 END AS lag FROM events WHERE event_type = 'signup'),
t AS (SELECT 'U' || (user_id % 40) AS plate, user_id // 80 AS person, ts AS t0, CASE WHEN event_id % 13 > 0 THEN ts + INTERVAL 10 MINUTE END AS t1 FROM events WHERE event_type IN ('purchase', 'view')),
n AS (SELECT segment_id, s0, s1, t.* FROM s JOIN t ON s.plate = t.plate AND t0 <= s1 + INTERVAL 240 MINUTE AND coalesce(t1, t0) >= s0 - INTERVAL 240 MINUTE),
p AS (SELECT segment_id, s0, s1, person, max(t1) FILTER (WHERE t1 <= s0 AND t1 >= s0 - INTERVAL 240 MINUTE) AS b, min(t0) FILTER (WHERE t0 >= s1 AND t0 <= s1 + INTERVAL 240 MINUTE) AS a FROM n GROUP BY ALL),
k AS (SELECT segment_id, count(b) AS before_people, count(a) AS after_people, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS "both" FROM p GROUP BY 1),
q AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n x WHERE x.segment_id = p.segment_id AND x.person <> p.person AND coalesce(x.t1, x.t0) > p.b AND x.t0 < p.a)),
c AS (SELECT segment_id, count(*) AS clear, min(person) AS person, min(epoch_us(s0) - epoch_us(b)) / 60000000.0 AS before_min, min(epoch_us(a) - epoch_us(s1)) / 60000000.0 AS after_min FROM q GROUP BY 1),
l AS (SELECT segment_id, arg_max(person, (t1, -person)) AS last_person, (epoch_us(any_value(s0)) - epoch_us(max(t1))) / 60000000.0 AS stale FROM s JOIN t ON s.plate = t.plate AND t1 <= s0 GROUP BY 1),
h AS (SELECT segment_id, count(DISTINCT e.user_id) AS k, min(e.user_id) AS custodian FROM s JOIN events e ON e.event_type = 'error' AND e.user_id % 40 = CAST(substr(plate, 2) AS INT) AND CAST(e.ts AS DATE) BETWEEN CAST(s0 AS DATE) AND CAST(s1 AS DATE) GROUP BY 1),
j AS (SELECT s.*, coalesce(clear, 0) AS clear, c.person, before_min, after_min, before_people, after_people, "both", last_person, stale, h.k, custodian, lag <= 60 AND coalesce(clear, 0) = 1 AS br, lag <= 60 AND coalesce(stale <= 500, FALSE) AS la FROM s LEFT JOIN c USING (segment_id) LEFT JOIN k USING (segment_id) LEFT JOIN l USING (segment_id) LEFT JOIN h USING (segment_id))
SELECT segment_id, plate, CASE WHEN br THEN 'bracketed' WHEN la THEN 'last_trip' WHEN k = 1 THEN 'sole_custodian' WHEN k > 1 THEN 'ambiguous' ELSE 'unknown' END AS basis, CASE WHEN br THEN person WHEN la THEN last_person WHEN k = 1 THEN custodian END AS person, CASE WHEN br THEN round(before_min, 4) END AS before_min, CASE WHEN br THEN round(after_min, 4) END AS after_min, CASE WHEN la AND NOT br THEN round(stale, 4) END AS stale_min,
  CASE WHEN br THEN NULL WHEN lag > 60 THEN 'clock' WHEN clear > 1 THEN 'contradiction' WHEN "both" > 0 THEN 'someone_between' WHEN before_people > 0 AND after_people > 0 THEN 'handover' WHEN before_people > 0 THEN 'only_before' WHEN after_people > 0 THEN 'only_after' ELSE 'nothing_near' END AS not_bracketed FROM j""")
def _(t):
    key, user = F.col("event_id"), F.col("user_id")
    plate = F.concat(F.lit("U"), user % 40).alias("plate")
    segments = t.events.filter("event_type = 'signup'").select(key.alias("segment_id"), plate, F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL '20' MINUTE")).alias("end"), F.when(key % 9 == 0, 90).otherwise(key % 7).alias("lag"))
    ended = F.when(key % 13 > 0, F.col("ts") + F.expr("INTERVAL '10' MINUTE"))
    trips = t.events.filter("event_type in ('purchase', 'view')").select(plate, F.floor(user / 80).alias("person"), F.col("ts").alias("t_start"), ended.alias("t_end"))
    custody = t.events.filter("event_type = 'error'").select(plate, F.to_date("ts").alias("day"), user.alias("person"))
    found = attribution.attributed(segments, trips, custody, stale=500)
    return found.withColumns({c: F.round(c, 4) for c in ("before_min", "after_min", "stale_min")})
