"""The report of every day."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.operators import report, rules
from caravel.plans.registry import query

#: Fewer bookings a day than a fleet has: smaller thresholds.
SMALL = report.Thresholds(hour_min=8, min_usual=100, regular_of_4=2, open_min=2, open_pct=50, channel_min=10)


def day_trips(t):
    key, user = F.col("event_id"), F.col("user_id")
    local = F.col("ts") + F.expr("INTERVAL '4' HOUR")
    platform = F.when(user % 3 == 0, "uber").when(user % 3 == 1, "bolt").otherwise("hotel")
    lost = F.when((user % 3 == 1) & (F.dayofmonth(local) % 6 == 0), key % 2 == 0).otherwise(key % 8 == 0)
    return t.events.select(
        F.to_date(local).alias("day"), F.hour(local).alias("hour"), platform.alias("platform"), F.concat(F.lit("U"), user % 137).alias("plate"), user.alias("person"), (~lost).alias("completed"), lost.alias("lost"),
        F.when(key % 10 > 0, F.col("value").cast("decimal(12,2)")).alias("fare"),
    )


@query("C28_report", """WITH t AS (SELECT CAST(l AS DATE) AS day, hour(l) AS hour, CASE user_id % 3 WHEN 0 THEN 'uber' WHEN 1 THEN 'bolt' ELSE 'hotel' END AS platform, 'U' || (user_id % 137) AS plate, user_id AS person, CASE WHEN user_id % 3 = 1 AND day(l) % 6 = 0 THEN event_id % 2 = 0 ELSE event_id % 8 = 0 END AS lost, CASE WHEN event_id % 10 > 0 THEN CAST(value AS DECIMAL(12,2)) END AS fare FROM (SELECT *, ts + INTERVAL 4 HOUR AS l FROM events)),
d AS (SELECT DISTINCT day FROM t), u AS (SELECT d.day, p.day AS past FROM d JOIN d p ON date_diff('day', p.day, d.day) IN (7, 14, 21, 28)),
tot AS (SELECT day, count(*)::DOUBLE AS bookings, count(*) FILTER (WHERE NOT lost)::DOUBLE AS completed, coalesce(sum(fare), 0)::DOUBLE AS fares, count(DISTINCT plate)::DOUBLE AS cars, count(DISTINCT person) FILTER (WHERE fare > 0)::DOUBLE AS people FROM t GROUP BY 1),
st AS (UNPIVOT tot ON bookings, completed, fares, cars, people INTO NAME entity VALUE y),
me AS (SELECT a.day, a.entity, a.y, median(b.y) AS usual, min(b.y) AS lo, max(b.y) AS hi, count(*) AS n FROM st a JOIN u ON u.day = a.day JOIN st b ON b.day = u.past AND b.entity = a.entity GROUP BY 1, 2, 3),
ch AS (SELECT platform, day, 100.0 * count(*) FILTER (WHERE NOT lost) / count(*) AS pct FROM t GROUP BY 1, 2 HAVING count(*) >= 10),
cf AS (SELECT a.day, a.platform, a.pct, median(b.pct) AS usual FROM ch a JOIN u ON u.day = a.day JOIN ch b ON b.day = u.past AND b.platform = a.platform GROUP BY 1, 2, 3),
hr AS (SELECT day, (hour - o + 24) % 24 AS w, count(*) AS n FROM t, (SELECT unnest([0, 1, 2]) AS o) GROUP BY 1, 2),
hw AS (SELECT d.day, w.w, coalesce((SELECT n FROM hr WHERE hr.day = d.day AND hr.w = w.w), 0)::DOUBLE AS today, (SELECT median(coalesce(hr.n, 0)) FROM u LEFT JOIN hr ON hr.day = u.past AND hr.w = w.w WHERE u.day = d.day)::DOUBLE AS usual FROM d, range(24) w(w) WHERE (SELECT count(*) FROM u WHERE u.day = d.day) >= 2),
hx AS (SELECT day, 'hours_less' AS kind, arg_min({'w': w, 't': today, 'u': usual}, (today - usual, w)) AS x FROM hw GROUP BY 1 UNION ALL SELECT day, 'hours_more', arg_max({'w': w, 't': today, 'u': usual}, (today - usual, -w)) FROM hw GROUP BY 1),
pe AS (SELECT CAST(person AS VARCHAR) AS entity, day, count(*) AS n, count(*) FILTER (WHERE lost) AS lost, coalesce(sum(fare), 0)::DOUBLE AS fares FROM t GROUP BY 1, 2),
pr AS (SELECT u.day, b.entity, median(b.fares) AS usual FROM u JOIN pe b ON b.day = u.past GROUP BY 1, 2 HAVING count(*) >= 2), pp AS (SELECT pr.*, pe.fares AS y FROM pr LEFT JOIN pe USING (entity, day)),
bk AS (SELECT plate, day AS since, lead(day) OVER (PARTITION BY plate ORDER BY day) AS next FROM (SELECT DISTINCT plate, day FROM t)),
id AS (SELECT plate, since, CAST(since + CAST(i AS INT) AS DATE) AS day, next FROM bk, range(2, 15) r(i))
SELECT day, 'measure' AS kind, entity, y AS today, usual FROM me WHERE n >= 2 AND (y < lo OR y > hi) AND abs(y - usual) * 100 >= 10 * usual AND usual <> 0
UNION ALL SELECT day, 'channel', platform, pct, usual FROM cf WHERE usual - pct >= 15
UNION ALL SELECT day, kind, lpad(CAST(x.w AS VARCHAR), 2, '0'), x.t, x.u FROM hx WHERE abs(x.t - x.u) >= 8 AND x.u > 0 AND abs(x.t - x.u) >= 0.2 * x.u
UNION ALL SELECT day, 'driver_down', entity, y, usual FROM pp WHERE usual >= 100 AND y <= usual * 0.5 UNION ALL SELECT day, 'driver_absent', entity, NULL, usual FROM pp WHERE y IS NULL
UNION ALL SELECT day, 'open_jobs', entity, lost, n FROM pe WHERE n >= 2 AND 100 * lost >= 50 * n
UNION ALL SELECT day, 'car_idle', plate, date_diff('day', since, day), NULL FROM id WHERE day < coalesce(next, DATE '9999-01-01') AND day IN (SELECT day FROM d)""")
def _(t):
    return report.day_findings(day_trips(t), SMALL)


#: Fixes of cars: most report to the end, some fall silent one by one, one source's cars all at once; others take over.
FIXES_SQL = """y AS (SELECT *, ts <= CASE WHEN user_id % 4 = 3 THEN TIMESTAMP '2024-01-20 12:00:00' WHEN user_id % 7 = 0 THEN TIMESTAMP '2024-01-02' + to_days(CAST(user_id % 28 AS INT)) ELSE TIMESTAMP '2024-02-01' END AS own FROM events),
x AS (SELECT CASE WHEN own THEN 'S' || (user_id % 4) ELSE 'S9' END AS source, CASE WHEN own THEN 'U' ELSE 'R' END || user_id AS plate, ts, value, event_type FROM y)"""


@query("C12_fleet_findings", f"""WITH {FIXES_SQL}, la AS (SELECT source, plate, max(ts) AS l FROM x GROUP BY 1, 2), nw AS (SELECT source, max(l) AS now FROM la GROUP BY 1),
rn AS (SELECT source, g, min(l) AS a, max(l) AS b, count(*) AS n FROM (SELECT *, sum(o) OVER (PARTITION BY source ORDER BY l) AS g FROM (SELECT *, CASE WHEN epoch_us(l) - epoch_us(lag(l) OVER (PARTITION BY source ORDER BY l)) <= 3600000000 THEN 0 ELSE 1 END AS o FROM la)) GROUP BY 1, 2 HAVING count(*) >= 5),
st AS (SELECT plate, (epoch_us(now) - epoch_us(l)) / 3600000000.0 AS age FROM la JOIN nw USING (source) WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.source = la.source AND l BETWEEN a AND b)),
un AS (SELECT plate, 100 * count(*) FILTER (WHERE event_type = 'error') / sum(value) AS rate FROM x GROUP BY 1 HAVING sum(value) > 50), um AS (SELECT quantile_cont(rate, 0.5) AS m FROM un),
dh AS (SELECT plate, sum(CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(14,2)) END) AS e, sum(CAST(value AS DECIMAL(14,2))) AS p FROM x WHERE event_type = 'view' OR event_type = 'purchase' GROUP BY 1)
SELECT 'tracker_feed_dark' AS code, source AS entity, 'critical' AS severity, CAST(n AS DOUBLE) AS figure FROM rn
UNION ALL SELECT 'stale_tracker', plate, CASE WHEN age > 72 THEN 'critical' ELSE 'warning' END, round(age, 4) FROM st WHERE age >= 24
UNION ALL SELECT 'vehicle_dormant', plate, CASE WHEN d >= 20 THEN 'critical' ELSE 'warning' END, d FROM (SELECT plate, date_diff('day', CAST(max(ts) AS DATE), (SELECT CAST(max(ts) AS DATE) FROM x)) AS d FROM x GROUP BY 1) WHERE d >= 9
UNION ALL SELECT 'unsafe_driving', plate, CASE WHEN rate / m >= 4 THEN 'critical' ELSE 'warning' END, round(rate / m, 4) FROM un, um WHERE rate >= 2 * m AND m > 0
UNION ALL SELECT 'deadhead_waste', plate, 'warning', round(CAST(e AS DOUBLE) / CAST(p AS DOUBLE), 4) FROM dh WHERE e IS NOT NULL AND p > 30 AND CAST(e AS DOUBLE) / CAST(p AS DOUBLE) >= 0.7
UNION ALL SELECT 'low_utilisation', plate, 'warning', round(u, 4) FROM (SELECT plate, count(*) FILTER (WHERE event_type = 'purchase') / CAST(count(*) AS DOUBLE) AS u FROM x GROUP BY 1) WHERE u < 0.15
UNION ALL SELECT 'online_no_trips', plate || '@' || CAST(day AS VARCHAR), CASE WHEN day < (SELECT CAST(max(ts) AS DATE) FROM x) THEN 'critical' ELSE 'warning' END, round(m / 60.0, 4) FROM (SELECT plate, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'click') * 90 AS m, count(*) FILTER (WHERE event_type = 'purchase') AS c FROM x GROUP BY 1, 2) WHERE m >= 270 AND c = 0
UNION ALL SELECT CASE WHEN d < 0 THEN 'vehicle_doc_expired' ELSE 'vehicle_doc_expiring' END, plate, CASE WHEN d <= 7 THEN 'critical' ELSE 'warning' END, d FROM (SELECT plate, date_diff('day', DATE '2024-01-10', CAST(min(ts) AS DATE)) + CAST(substr(plate, 2) AS INT) % 90 AS d FROM x GROUP BY 1) WHERE d <= 30""")
def _(t):
    user, kind = F.col("user_id"), F.col("event_type")
    until = F.when(user % 4 == 3, F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'")).when(user % 7 == 0, F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'") + F.make_interval(days=(user % 28).cast("int"))).otherwise(F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    own = F.col("ts") <= until
    source, plate = F.when(own, F.concat(F.lit("S"), user % 4)).otherwise("S9"), F.concat(F.when(own, "U").otherwise("R"), user)
    x = t.events.select(source.alias("source"), plate.alias("plate"), "ts", F.to_date("ts").alias("day"), "value", "event_type", user.alias("number"))
    count = lambda k: F.count(F.when(kind == k, 1))
    per = x.groupBy("plate").agg(F.sum("value").alias("km"), count("error").alias("n"), F.count("*").alias("online"), count("purchase").alias("on_trip"), F.min("day").alias("first"), F.max("number").alias("number"))
    paid = x.filter("event_type in ('view', 'purchase')").withColumn("paid", F.col("value").cast("decimal(14,2)"))
    paid = paid.withColumn("empty", F.when(kind == "view", F.col("paid"))).groupBy("plate").agg(F.sum("empty").cast("double").alias("empty"), F.sum("paid").cast("double").alias("paid"))
    days = x.groupBy(F.concat_ws("@", "plate", F.col("day").cast("string")).alias("who"), "day").agg((count("click") * 90).alias("online_min"), count("purchase").alias("done"))
    today = x.agg(F.max("day").alias("today"))  # one row
    days = days.filter("online_min >= 270").crossJoin(F.broadcast(today)).withColumn("closed", F.col("day") < F.col("today"))
    left = per.withColumn("left", F.datediff("first", F.lit("2024-01-10")) + (F.col("number") % 90).cast("int"))
    return rules.all_findings([
        rules.tracker_dark(x, "source", "plate", "ts"), rules.stale_trackers(x, "source", "plate", "ts"), rules.dormant_vehicles(x, "plate", "day", 9, 20), rules.unsafe_driving(per, "plate", "km", "n"),
        rules.deadhead(paid, "plate", "empty", "paid", share=0.7), rules.low_utilisation(per, "plate", "online", "on_trip", 0.15), rules.online_without_trips(days, "who", "online_min", "done", "closed"), rules.expiring_documents(left, "plate", "left"),
    ])


@query("C12_latest", """WITH f AS (SELECT event_type AS code, 'U' || (user_id % 40) AS entity, ts AS run_at, event_id AS n FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY code, entity ORDER BY run_at DESC) AS i, max(run_at) OVER (PARTITION BY code) AS last FROM f) SELECT code, entity, run_at, n FROM l WHERE i = 1 AND run_at >= last - INTERVAL 10 MINUTE""")
def _(t):
    found = t.events.select(F.col("event_type").alias("code"), F.concat(F.lit("U"), F.col("user_id") % 40).alias("entity"), F.col("ts").alias("run_at"), F.col("event_id").alias("n"))
    return rules.latest(found)
