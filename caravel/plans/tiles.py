"""Days and nights of cars as tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.operators import movement
from caravel.plans.domain import KM_SQL
from caravel.plans.registry import query


def standing_fixes(t):
    """Events as fixes every four minutes of cars that stand, drive on, and go dark for hours and for a day."""
    key = F.col("event_id")
    car, k = F.floor(key / 700), key % 700
    minutes = k * 4 + F.when(k >= 150, 90).otherwise(0) + F.when(k >= 300, 25).otherwise(0) + F.when(k >= 400, 1500).otherwise(0)
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_interval(days=(car % 28).cast("int"), mins=minutes.cast("int"))
    lat = 25 + F.floor(key / 23) % 7 / 200.0 + key % 3 * 0.0004
    return t.events.select(F.concat(F.lit("U"), car).alias("plate"), F.when(key % 5 == 0, "cabman").otherwise("fms").alias("source"), at.alias("at"), lat.alias("lat"), (55 + F.floor(key / 11) % 5 * 0.0009).alias("lng"))


def tiles_sql(hours: int, before: int, after: int) -> str:
    near = lambda a, b: KM_SQL.format(a=f"{a}.lat", b=f"{b}.lat", c=f"{a}.lng", d=f"{b}.lng") + " <= 0.15"
    return f"""WITH RECURSIVE e AS (SELECT event_id // 700 AS car, event_id % 700 AS k, event_id FROM events),
f AS (SELECT 'U' || car AS plate, CASE WHEN event_id % 5 = 0 THEN 'cabman' ELSE 'fms' END AS source, TIMESTAMP '2024-01-01' + to_days(CAST(car % 28 AS INT)) + to_minutes(CAST(k * 4 + CASE WHEN k >= 150 THEN 90 ELSE 0 END + CASE WHEN k >= 300 THEN 25 ELSE 0 END + CASE WHEN k >= 400 THEN 1500 ELSE 0 END AS INT)) AS ts,
  25 + (event_id // 23) % 7 / 200.0 + event_id % 3 * 0.0004 AS lat, 55 + (event_id // 11) % 5 * 0.0009 AS lng FROM e),
w AS (SELECT *, CAST(CAST(ts + INTERVAL 4 HOUR AS DATE) + CAST(o AS INT) AS DATE) AS day FROM f, (SELECT unnest([-1, 0, 1]) AS o)),
h AS (SELECT *, CAST(day AS TIMESTAMP) - INTERVAL 4 HOUR AS w0, CAST(day AS TIMESTAMP) + INTERVAL {hours - 4} HOUR AS w1 FROM w WHERE ts + INTERVAL 4 HOUR >= CAST(day AS TIMESTAMP) - INTERVAL {before} HOUR AND ts + INTERVAL 4 HOUR < CAST(day AS TIMESTAMP) + INTERVAL {hours + after} HOUR),
b AS (SELECT DISTINCT ON (plate, day) plate, day, source FROM (SELECT plate, day, source, count(*) FILTER (WHERE ts >= w0 AND ts < w1) AS n, min(CASE WHEN ts < w0 THEN epoch_us(w0) - epoch_us(ts) WHEN ts >= w1 THEN 3600000000000 + epoch_us(ts) - epoch_us(w1) END) AS d FROM h GROUP BY 1, 2, 3) ORDER BY plate, day, n DESC, d, source),
p AS MATERIALIZED (SELECT h.*, row_number() OVER (PARTITION BY plate, day ORDER BY ts) AS i FROM h SEMI JOIN b USING (plate, day, source)),
c AS MATERIALIZED (SELECT p.plate, p.day, p.i, p.ts, q.ts AS t2, p.lat, p.lng, q.lat AS lat2, q.lng AS lng2, p.source, (epoch_us(q.ts) - epoch_us(p.ts)) / 60000000.0 AS gap, {near("p", "q")} AS close FROM p JOIN p q ON q.plate = p.plate AND q.day = p.day AND q.i = p.i + 1),
-- each interval with the first fix of the run that it goes on
r AS (SELECT plate, day, i, CASE WHEN close AND gap <= 1440 THEN i END AS a, lat AS alat, lng AS alng FROM c WHERE i = 1 UNION ALL
  SELECT plate, day, i, CASE WHEN NOT st THEN NULL WHEN same THEN a ELSE i END, CASE WHEN st AND same THEN alat ELSE lat END, CASE WHEN st AND same THEN alng ELSE lng END FROM (
    SELECT c.*, r.a, r.alat, r.alng, c.close AND c.gap <= 1440 AS st, r.a IS NOT NULL AND {KM_SQL.format(a="r.alat", b="c.lat2", c="r.alng", d="c.lng2")} <= 0.15 AS same FROM r JOIN c ON c.plate = r.plate AND c.day = r.day AND c.i = r.i + 1)),
x AS (SELECT c.*, a FROM c JOIN r USING (plate, day, i)),
y AS (SELECT plate, day, a AS i, max(i) + 1 AS j, min(ts) AS a0, max(t2) AS b0, CASE WHEN epoch_us(max(t2)) - epoch_us(min(ts)) >= 600000000 THEN 'stay' WHEN bool_or(gap > CASE source WHEN 'cabman' THEN 70 ELSE 30 END) THEN 'parked' ELSE 'drive' END AS kind, arg_min(lat, i) AS lat, arg_min(lng, i) AS lng FROM x WHERE a IS NOT NULL GROUP BY plate, day, a
  UNION ALL SELECT plate, day, i, i + 1, ts, t2, CASE WHEN gap > 1440 THEN 'silent' WHEN gap <= 20 THEN 'drive' ELSE 'moved' END, NULL, NULL FROM x WHERE a IS NULL),
z AS (SELECT *, sum(CASE WHEN kind = 'drive' AND before = 'drive' THEN 0 ELSE 1 END) OVER (PARTITION BY plate, day ORDER BY i) AS tile FROM (SELECT *, lag(kind) OVER (PARTITION BY plate, day ORDER BY i) AS before FROM y)),
m AS (SELECT plate, day, kind, min(i) AS i, max(j) AS j, min(a0) AS a0, max(b0) AS b0, any_value(lat) AS lat, any_value(lng) AS lng FROM z GROUP BY plate, day, tile, kind),
n AS (SELECT *, lead(kind) OVER (PARTITION BY plate, day ORDER BY i) AS after FROM m),
v AS (SELECT plate, day, any_value(w0) AS w0, any_value(w1) AS w1, min(ts) AS first, max(ts) AS last FROM p GROUP BY 1, 2),
u AS (SELECT n.plate, n.day, kind, a0, b0, w0, w1, CASE WHEN kind = 'stay' THEN lat END AS lat, CASE WHEN kind = 'stay' THEN lng END AS lng, CASE WHEN kind = 'stay' THEN j - i + 1 END AS fixes, CASE WHEN kind = 'stay' THEN i = 1 END AS since_at_least, CASE WHEN kind = 'stay' THEN coalesce(after IN ('moved', 'silent'), TRUE) END AS until_at_least FROM n JOIN v USING (plate, day)
  UNION ALL SELECT plate, day, 'before_first', w0, first, w0, w1, NULL, NULL, NULL, NULL, NULL FROM v UNION ALL SELECT plate, day, 'after_last', last, w1, w0, w1, NULL, NULL, NULL, NULL, NULL FROM v),
tiles AS (SELECT plate, day, kind, greatest(a0, w0) AS start, least(b0, w1) AS "end", (epoch_us(least(b0, w1)) - epoch_us(greatest(a0, w0))) / 60000000.0 AS minutes, lat, lng, CASE WHEN kind = 'stay' THEN a0 END AS from_at, CASE WHEN kind = 'stay' THEN b0 END AS to_at, fixes, since_at_least, until_at_least FROM u WHERE least(b0, w1) > greatest(a0, w0))"""


@query("C20_movement", tiles_sql(24, 6, 6) + """ SELECT plate, day, kind, start, "end", round(minutes, 4) AS minutes, round(lat, 6) AS lat, round(lng, 6) AS lng, from_at, to_at, fixes, since_at_least, until_at_least FROM tiles""")
def _(t):
    return movement.movement(standing_fixes(t)).withColumns({"minutes": F.round("minutes", 4), "lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query("W23_C21_overnight", tiles_sql(5, 6, 7) + """, best AS (SELECT DISTINCT ON (plate, day) * FROM tiles WHERE kind = 'stay' ORDER BY plate, day, minutes DESC, start DESC),
k AS (SELECT plate, day, count(*) FILTER (WHERE kind = 'stay') AS stays, coalesce(sum(minutes) FILTER (WHERE kind = 'drive'), 0) AS driven, coalesce(sum(minutes) FILTER (WHERE kind IN ('moved', 'silent', 'before_first', 'after_last')), 0) AS unknown FROM tiles GROUP BY 1, 2)
SELECT plate, day AS night, round(lat, 6) AS lat, round(lng, 6) AS lng, round(minutes, 4) AS minutes, from_at, to_at, since_at_least, until_at_least, stays, round(driven, 4) AS driven, round(unknown, 4) AS unknown FROM k LEFT JOIN best USING (plate, day)""")
def _(t):
    found = movement.overnight(standing_fixes(t))
    return found.withColumns({c: F.round(c, n) for c, n in (("lat", 6), ("lng", 6), ("minutes", 4), ("driven", 4), ("unknown", 4))})
