"""Filings, statement days and the driver's day from all of its sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.functions import time
from caravel.operators import aggregates as agg
from caravel.operators import filings, intervals
from caravel.plans.registry import query
from caravel.plans.rollups import norm
from caravel.sources.fleet import WITH_TRIPS

MONEY_SQL = """money AS (SELECT 'F' || (l_suppkey % 2) AS fleet_id, CASE l_linestatus WHEN 'O' THEN 'uber' ELSE 'bolt' END AS platform, 'export' AS source,
  CASE l_returnflag WHEN 'A' THEN 'payout' WHEN 'N' THEN 'component' ELSE 'adjustment' END AS kind, 'c' || (l_linenumber % 2) AS category,
  CASE WHEN l_suppkey % 10 = 9 THEN '' ELSE 'd' || (l_suppkey % 10) END AS driver, 'p' || (l_suppkey % 3) AS person, CASE WHEN l_partkey % 5 > 0 THEN 'r' END AS reference,
  CAST(l_shipdate AS DATE) AS period_start, CAST(l_shipdate AS DATE) + ([0, 3, 6, 27])[CAST(l_orderkey % 4 AS INT) + 1] AS period_end,
  CAST(CASE WHEN l_tax > 0.06 THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(14,2)) AS amount,
  CASE WHEN l_partkey % 7 > 0 THEN CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_days(CAST(l_partkey % 40 AS INT)) END AS ingested_at FROM lineitem)"""


def money_events(t):
    day = F.to_date("l_shipdate")
    length = F.array(*map(F.lit, (0, 3, 6, 27)))[(F.col("l_orderkey") % 4).cast("int")]
    return t.lineitem.select(
        F.concat(F.lit("F"), F.col("l_suppkey") % 2).alias("fleet_id"), F.when(F.col("l_linestatus") == "O", "uber").otherwise("bolt").alias("platform"), F.lit("export").alias("source"),
        F.when(F.col("l_returnflag") == "A", "payout").when(F.col("l_returnflag") == "N", "component").otherwise("adjustment").alias("kind"),
        F.concat(F.lit("c"), F.col("l_linenumber") % 2).alias("category"), F.when(F.col("l_suppkey") % 10 == 9, "").otherwise(F.concat(F.lit("d"), F.col("l_suppkey") % 10)).alias("driver"),
        F.concat(F.lit("p"), F.col("l_suppkey") % 3).alias("person"), F.when(F.col("l_partkey") % 5 > 0, "r").alias("reference"), day.alias("period_start"), F.date_add(day, length).alias("period_end"),
        F.when(F.col("l_tax") > 0.06, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("decimal(14,2)").alias("amount"),
        F.when(F.col("l_partkey") % 7 > 0, F.date_add(day, (F.col("l_partkey") % 40).cast("int")).cast("timestamp_ntz")).alias("ingested_at"),
    )


@query("C14_receipts", f"""WITH {MONEY_SQL}, f AS (SELECT source, platform, kind, category, driver, reference, period_start AS a, period_end AS b, coalesce(max(ingested_at), TIMESTAMP '1970-01-01') AS seen FROM money WHERE kind <> 'adjustment' GROUP BY ALL),
o AS (SELECT x.*, coalesce(bool_or(y.a IS NOT NULL), FALSE) AS restated, coalesce(bool_or(y.b - y.a > x.b - x.a OR (y.b - y.a = x.b - x.a AND y.seen > x.seen)), FALSE) AS superseded
  FROM f x LEFT JOIN f y ON x.platform = y.platform AND x.kind = y.kind AND x.category = y.category AND x.driver = y.driver AND x.reference IS NOT DISTINCT FROM y.reference AND y.a <= x.b AND y.b >= x.a AND (y.a <> x.a OR y.b <> x.b) GROUP BY ALL),
m AS (SELECT money.*, coalesce(restated, FALSE) AS restated, coalesce(superseded, FALSE) AS superseded FROM money LEFT JOIN o ON money.platform = o.platform AND money.kind = o.kind AND money.category = o.category AND money.driver = o.driver AND money.reference IS NOT DISTINCT FROM o.reference AND period_start = a AND period_end = b)
SELECT source, platform, fleet_id, kind, period_start, period_end, CAST(period_end - period_start + 1 AS INT) AS days, count(*) AS lines, count(DISTINCT person) FILTER (WHERE driver <> '') AS people, count(DISTINCT driver) FILTER (WHERE driver <> '') AS accounts, count(DISTINCT category) AS categories,
  CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(amount) FILTER (WHERE amount > 0) AS DOUBLE) AS credits, CAST(sum(amount) FILTER (WHERE amount < 0) AS DOUBLE) AS debits, bool_or(restated) AS restated, bool_and(superseded) AS superseded,
  CAST(sum(amount) FILTER (WHERE superseded) AS DOUBLE) AS superseded_amount, CAST(sum(amount) FILTER (WHERE NOT superseded) AS DOUBLE) AS counted_amount, min(ingested_at) AS first_seen, max(ingested_at) AS last_seen,
  CAST(date_trunc('month', period_end) AS DATE) AS month, date_trunc('month', period_start) <> date_trunc('month', period_end) AS straddles_month FROM m GROUP BY source, platform, fleet_id, kind, period_start, period_end""")
def _(t):
    found = filings.receipts(money_events(t))
    return found.withColumns({c: F.col(c).cast("double") for c in ("amount", "credits", "debits", "superseded_amount", "counted_amount")})


STATEMENT_SQL = """c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'uber' ELSE 'bolt' END AS platform, 'F' || (o_custkey % 2) AS fleet_id, o_custkey % 60 AS driver, CASE WHEN o_custkey % 60 < 50 THEN 'Driver  ' || (o_custkey % 60 // 2) END AS driver_name,
  CASE o_orderkey % 5 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(date_trunc('week', o_orderdate) AS DATE) + 2 WHEN 2 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(date_trunc('week', o_orderdate) AS DATE) END AS a,
  ([0, 3, 27, 6, 6])[CAST(o_orderkey % 5 AS INT) + 1] AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'your_earnings' WHEN o_orderkey % 3 = 1 THEN 'net_fare' ELSE 'tip' END AS category, CASE WHEN o_orderkey % 4 < 2 THEN 'your_earnings' END AS parent, CAST(o_totalprice AS DECIMAL(14,2)) AS amount FROM orders),
per AS (SELECT platform, fleet_id, driver, driver_name, a, a + n AS b, n + 1 AS days, coalesce(sum(amount) FILTER (WHERE category = 'your_earnings') - coalesce(sum(amount) FILTER (WHERE category = 'tip' AND parent = 'your_earnings'), 0), sum(amount) FILTER (WHERE category = 'net_fare')) AS net,
  sum(amount) FILTER (WHERE category = 'tip') AS tips, count(*) FILTER (WHERE category = 'your_earnings') > 0 AS root FROM c GROUP BY ALL),
r AS (SELECT DISTINCT ON (platform, fleet_id, driver, day) *, CAST(a + CAST(i AS INT) AS DATE) AS day FROM (SELECT *, unnest(range(days)) AS i FROM per WHERE net IS NOT NULL) ORDER BY platform, fleet_id, driver, day, days > 1, NOT root, days, a),
s AS (SELECT platform, fleet_id, lower(regexp_replace(coalesce(driver_name, CAST(driver AS VARCHAR)), '\\s+', ' ', 'g')) AS person, day, max(driver) AS driver, max(days) AS period_days, round(CAST(sum(CAST(net AS DOUBLE) / days) AS DOUBLE), 4) AS net, round(CAST(sum(CAST(tips AS DOUBLE) / days) AS DOUBLE), 4) AS tips FROM r GROUP BY 1, 2, 3, 4)"""


def statement_days(t):
    """Orders as lines of statements on four grids: days, four-day snapshots, months, weeks."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    week, month = (F.to_date(F.date_trunc(g, "o_orderdate")) for g in ("week", "month"))
    grid, driver = key % 5, F.col("o_custkey") % 60
    rows = t.orders.select(
        F.when(key % 2 == 0, "uber").otherwise("bolt").alias("platform"), F.concat(F.lit("F"), F.col("o_custkey") % 2).alias("fleet_id"), driver.alias("driver"),
        F.when(driver < 50, F.concat(F.lit("Driver  "), F.floor(driver / 2))).alias("driver_name"), F.when(grid == 0, day).when(grid == 1, F.date_add(week, 2)).when(grid == 2, month).otherwise(week).alias("period_start"),
        F.array(*map(F.lit, (0, 3, 27, 6, 6)))[grid.cast("int")].alias("n"), F.when(key % 3 == 0, "your_earnings").when(key % 3 == 1, "net_fare").otherwise("tip").alias("category"),
        F.when(key % 4 < 2, "your_earnings").alias("parent"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"),
    )
    account = ["platform", "fleet_id", "driver"]
    rows = rows.withColumn("period_end", F.expr("date_add(period_start, n)"))
    periods = agg.statement_fold(rows, [*account, "driver_name", "period_start", "period_end"]).filter("net is not null")
    return filings.statement_days(periods.withColumns({c: F.col(c).cast("double") for c in ("net", "tips")}), account, ["net", "tips"])


@query("A24_statement_days", f"WITH {STATEMENT_SQL} SELECT * FROM s")
def _(t):
    found = statement_days(t)
    return found.select("platform", "fleet_id", "person", "day", "driver", "period_days", *[F.round(c, 4).alias(c) for c in ("net", "tips")])


@query("C03_driver_day_sources", WITH_TRIPS + """, j AS (SELECT CAST(driver_ext_id AS VARCHAR) AS driver, person_key AS person, platform, fleet_id, local_day AS day, hour(requested_at + INTERVAL 4 HOUR) * 60 + minute(requested_at + INTERVAL 4 HOUR) AS s,
  CASE WHEN CAST(ended_at + INTERVAL 4 HOUR AS DATE) > local_day THEN 1440 ELSE greatest(hour(ended_at + INTERVAL 4 HOUR) * 60 + minute(ended_at + INTERVAL 4 HOUR), hour(requested_at + INTERVAL 4 HOUR) * 60 + minute(requested_at + INTERVAL 4 HOUR)) END AS e, CASE WHEN has_fare THEN price END AS fare, external_id, requested_at, ended_at FROM trip_norm WHERE is_booking),
g AS (SELECT *, greatest(s - max(e) OVER (PARTITION BY driver, day ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM j),
work AS (SELECT driver, day, min(fleet_id) AS fleet_id, count(*) AS jobs, CAST(coalesce(sum(w), 0) AS BIGINT) AS wait, CAST(max(e) - min(s) AS BIGINT) AS span, CAST(sum(greatest(e - s, 0)) AS BIGINT) AS on_job FROM g GROUP BY 1, 2),
st AS (SELECT person, CASE WHEN external_id % 4 > 0 THEN driver END AS driver, platform, CAST(day + CAST(i AS INT) AS DATE) AS day, CAST(fare AS DOUBLE) * 0.75 / n AS net, CASE WHEN external_id % 6 <> 3 THEN n END AS period_days FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, CASE WHEN external_id % 2 = 0 THEN 1 ELSE 7 END AS n FROM j WHERE external_id % 9 < 4))),
own AS (SELECT DISTINCT ON (person, day) person, day, driver AS owner FROM (SELECT person, day, driver, count(*) AS n FROM j GROUP BY ALL) ORDER BY person, day, n DESC, driver),
f AS (SELECT person, day, platform, CAST(sum(fare) AS DOUBLE) AS fares FROM j GROUP BY ALL), p AS (SELECT person, day, platform, sum(net) AS net, max(driver) AS own, max(period_days) AS period_days, bool_or(net IS NOT NULL AND period_days IS NULL) AS unknown FROM st GROUP BY ALL),
b AS (SELECT person, day, net, fares, period_days, unknown, coalesce(owner, max(own) OVER (PARTITION BY person, day), person) AS driver, net IS NOT NULL AS s, net IS NULL AND fares IS NOT NULL AS f FROM f FULL JOIN p USING (person, day, platform) LEFT JOIN own USING (person, day)),
money AS (SELECT driver, day, round(sum(net), 4) AS statement_net, round(sum(coalesce(net, fares)), 4) AS money, CASE WHEN sum(coalesce(net, fares)) IS NULL THEN 'none' WHEN bool_or(s) AND bool_or(f) THEN 'mixed' WHEN bool_or(s) THEN 'statement' ELSE 'fares' END AS money_source,
  CASE WHEN NOT bool_or(s AND unknown) THEN max(CASE WHEN s THEN period_days WHEN f THEN 1 END) END AS money_period_days FROM b GROUP BY 1, 2),
pay AS (SELECT coalesce(owner, own, person) AS driver, day, round(sum(payout), 4) AS payout, round(sum(cash), 4) AS payout_cash FROM (SELECT person, day + 20 AS day, max(driver) AS own, sum(CAST(fare AS DOUBLE)) AS payout, sum(CASE WHEN external_id % 2 = 0 THEN CAST(fare AS DOUBLE) END) AS cash FROM j WHERE external_id % 7 = 0 GROUP BY 1, 2) LEFT JOIN own USING (person, day) GROUP BY 1, 2),
sp AS (SELECT driver, requested_at - INTERVAL 1 HOUR AS a, ended_at + INTERVAL 30 MINUTE AS b FROM j WHERE external_id % 5 < 2),
isl AS (SELECT driver, min(a) + INTERVAL 4 HOUR AS a, max(b) + INTERVAL 4 HOUR AS b FROM (SELECT *, sum(o) OVER (PARTITION BY driver ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY driver ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM sp)) GROUP BY driver, i),
onl AS (SELECT driver, day, CAST(round(sum(epoch_us(least(b, CAST(day + 1 AS TIMESTAMP))) - epoch_us(greatest(a, CAST(day AS TIMESTAMP)))) / 60000000.0) AS BIGINT) AS online_min FROM (SELECT *, CAST(unnest(generate_series(CAST(a AS DATE), CAST(b AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM isl) GROUP BY 1, 2),
k AS (SELECT driver, day FROM work UNION SELECT driver, day FROM money UNION SELECT driver, day FROM pay UNION SELECT driver, day FROM onl), fl AS (SELECT driver, min(fleet_id) AS own_fleet FROM work GROUP BY 1)
SELECT driver, day, coalesce(fleet_id, own_fleet) AS fleet_id, coalesce(jobs, 0) AS jobs, coalesce(wait, 0) AS wait, span, coalesce(on_job, 0) AS on_job, statement_net, money, coalesce(money_source, 'none') AS money_source, money_period_days, payout, payout_cash, online_min, CASE WHEN online_min IS NOT NULL THEN greatest(0, online_min - coalesce(on_job, 0)) END AS idle_online
FROM k LEFT JOIN work USING (driver, day) LEFT JOIN money USING (driver, day) LEFT JOIN pay USING (driver, day) LEFT JOIN onl USING (driver, day) LEFT JOIN fl USING (driver)""")
def _(t):
    key = F.col("external_id")
    jobs = norm(t).filter("is_booking").select(
        F.col("driver_ext_id").cast("string").alias("driver"), F.col("person_key").alias("person"), "platform", "fleet_id", F.col("local_day").alias("day"), "external_id", "requested_at", "ended_at",
        time.minute_of_day(F.col("requested_at")).alias("s"), time.end_minute(F.col("requested_at"), F.col("ended_at")).alias("e"), F.when(F.col("has_fare"), F.col("price").cast("double")).alias("fare"),
    )
    on = ["driver", "day"]
    parts = filings.tasks(t.orders.count())
    by_driver = jobs.repartition(parts, "driver")
    work = intervals.waits(by_driver, on, "s", "e", F.min("fleet_id").alias("fleet_id"))
    work = work.select(*on, *[F.col(c).cast("bigint").alias(c) for c in ("jobs", "wait", "span", "on_job")], "fleet_id")
    n = F.when(key % 2 == 0, 1).otherwise(7)
    spread = jobs.filter(key % 9 < 4).withColumn("n", n).withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    statements = spread.select("person", F.when(key % 4 > 0, F.col("driver")).alias("driver"), "platform", F.expr("date_add(day, i)").alias("day"), (F.col("fare") * 0.75 / F.col("n")).alias("net"), F.when(key % 6 != 3, F.col("n")).alias("period_days"))
    payouts = jobs.filter(key % 7 == 0).select("person", "driver", F.date_add("day", 20).alias("day"), F.col("fare").alias("earnings"), F.when(key % 2 == 0, F.col("fare")).alias("cash"))
    hour, half = F.expr("INTERVAL '1' HOUR"), F.expr("INTERVAL '30' MINUTE")
    spans = intervals.merge_spans(by_driver.filter(key % 5 < 2).select("driver", (F.col("requested_at") - hour).alias("start"), (F.col("ended_at") + half).alias("end")), ["driver"])
    found = filings.driver_days(work, jobs.select("driver", "person", "day", "platform", "fare"), statements, payouts, intervals.minutes_by_day(spans, ["driver"]), parts)
    return found.withColumns({c: F.round(c, 4) for c in ("statement_net", "money", "payout", "payout_cash")})
