"""Roll-ups, mixes, coverage, allocation, cohorts: groups A, C and part of D."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caravel.functions import money, time
from caravel.operators import aggregates as agg
from caravel.plans.registry import query
from caravel.sources.fleet import TRIP_SQL, WITH_TRIPS, bookings, listed, trips, trips_ext, trips_norm


def norm(t):
    return trips_norm(trips(t))


MEASURES_SQL = """
  count(*) AS trips, count(*) FILTER (WHERE is_booking) AS bookings, count(*) FILTER (WHERE NOT is_booking) AS telematics,
  count(DISTINCT CASE WHEN is_booking THEN nullif(person_key, '') END) AS drivers, count(DISTINCT plate) AS vehicles,
  count(DISTINCT plate) FILTER (WHERE is_booking AND has_fare AND price > 0) AS earning_vehicles,
  count(*) FILTER (WHERE is_booking AND person_key <> '') AS attributed_trips,
  CAST(sum(price) FILTER (WHERE is_booking AND has_fare) AS DOUBLE) AS revenue,
  count(*) FILTER (WHERE is_booking AND has_fare) AS priced_trips,
  round(sum(distance_km) FILTER (WHERE is_booking AND has_distance), 1) AS km,
  count(*) FILTER (WHERE is_booking AND has_distance) AS measured_trips,
  count(*) FILTER (WHERE outcome = 'completed') AS completed, count(*) FILTER (WHERE outcome = 'not_completed') AS not_completed,
  count(outcome) AS outcome_n"""


@query("S18_trips_norm", WITH_TRIPS + "SELECT is_booking, outcome, local_dow, local_hour, has_fare, has_distance, count(*) AS n, min(local_day) AS first_day, max(local_day) AS last_day FROM trip_norm GROUP BY ALL")
def _(t):
    keys = ["is_booking", "outcome", "local_dow", "local_hour", "has_fare", "has_distance"]
    return norm(t).groupBy(*keys).agg(F.count("*").alias("n"), F.min("local_day").alias("first_day"), F.max("local_day").alias("last_day"))


KINDS_SQL = " ".join(f"WHEN lower(payment_type) IN {listed(words)} THEN '{kind}'" for kind, words in money.SETTLEMENT.items())
SETTLEMENT_SQL = f"CASE WHEN payment_type IS NULL OR trim(payment_type) = '' THEN NULL {KINDS_SQL} ELSE 'other' END"
DAYPART_SQL = "CASE WHEN local_hour < 5 THEN 'night' WHEN local_hour < 10 THEN 'morning' WHEN local_hour < 15 THEN 'midday' WHEN local_hour < 20 THEN 'evening' ELSE 'late' END"


@query("S19_trips_ext", WITH_TRIPS + f"SELECT {SETTLEMENT_SQL} AS settlement_class, {DAYPART_SQL} AS daypart, lower(payment_type) IN {listed(money.HELD_BY_DRIVER)} AS driver_holds_cash, lower(payment_type) IN {listed(money.RECEIVABLE)} AS is_receivable, count(*) AS n, CAST(sum(price) AS DOUBLE) AS price FROM trip_norm WHERE is_booking GROUP BY ALL")
def _(t):
    rows = trips_ext(norm(t)).filter("is_booking")
    return rows.groupBy("settlement_class", "daypart", "driver_holds_cash", "is_receivable").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("price"))


@query("P01_A01_kpis", WITH_TRIPS + f"SELECT {MEASURES_SQL}, round(100.0 * count(*) FILTER (WHERE outcome = 'completed') / nullif(count(outcome), 0), 1) AS completion_pct FROM trip_norm")
def _(t):
    rate = 100 * F.count(F.when(F.col("outcome") == "completed", 1)) / F.nullif(F.count("outcome"), F.lit(0))
    return norm(t).agg(*agg.trip_measures(), F.round(rate, 1).alias("completion_pct"))


def _rollup_sql(grain: str) -> str:
    bucket = f"CAST(date_trunc('{grain}', requested_at + INTERVAL 4 HOUR) AS DATE)"
    return f"""WITH {TRIP_SQL}, b AS (SELECT *, {bucket} AS bucket FROM trip_norm WHERE requested_at IS NOT NULL)
SELECT bucket, CASE WHEN grouping(platform) = 1 THEN '*' ELSE coalesce(platform, 'unknown') END AS platform,
       CASE WHEN grouping(fleet_id) = 1 THEN '*' ELSE coalesce(fleet_id, 'unknown') END AS fleet, {MEASURES_SQL}
FROM b GROUP BY GROUPING SETS ((bucket, platform, fleet_id), (bucket, platform), (bucket, fleet_id), (bucket))"""


for _grain in ("day", "week", "month"):

    @query(f"A03_grain_rollup_{_grain}", _rollup_sql(_grain))
    def _(t, grain=_grain):
        return agg.grain_rollup(norm(t), grain)


for _grain in ("week", "month"):

    @query(
        f"A28_fold_grain_{_grain}",
        f"""WITH {TRIP_SQL}, b AS (SELECT *, local_day AS bucket FROM trip_norm WHERE requested_at IS NOT NULL), d AS (
SELECT bucket, CASE WHEN grouping(platform) = 1 THEN '*' ELSE platform END AS platform, {MEASURES_SQL} FROM b GROUP BY GROUPING SETS ((bucket, platform), (bucket)))
SELECT CAST(date_trunc('{_grain}', bucket) AS DATE) AS first_day, platform, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(completed) AS BIGINT) AS completed,
 CAST(sum(not_completed) AS BIGINT) AS not_completed, CAST(sum(telematics) AS BIGINT) AS telematics, CAST(sum(priced_trips) AS BIGINT) AS priced_trips,
 CAST(sum(CAST(km AS DECIMAL(24,2))) AS DOUBLE) AS km, CAST(sum(CAST(revenue AS DECIMAL(24,2))) AS DOUBLE) AS revenue, max(drivers) AS drivers_floor,
 count(DISTINCT bucket) AS days, count(DISTINCT bucket) < {"7" if _grain == "week" else "day(last_day(CAST(date_trunc('month', min(bucket)) AS DATE)))"} AS partial
FROM d GROUP BY 1, 2""",
    )
    def _(t, grain=_grain):
        days = agg.grain_rollup(norm(t), "day", [["bucket", "platform"], ["bucket"]])
        return agg.fold_grain(days, grain, by=("platform",))


@query("C02_person_month", WITH_TRIPS + "SELECT person_key, CAST(date_trunc('month', local_day) AS DATE) AS month, count(*) AS bookings, CAST(sum(price) FILTER (WHERE has_fare) AS DOUBLE) AS revenue, list_sort(list(DISTINCT platform)) AS platforms, list_sort(list(DISTINCT fleet_id) FILTER (WHERE fleet_id IS NOT NULL)) AS fleets FROM trip_norm WHERE is_booking AND person_key IS NOT NULL GROUP BY 1, 2")
def _(t):
    rows = norm(t).filter("is_booking and person_key is not null").groupBy("person_key", F.to_date(F.date_trunc("month", "local_day")).alias("month"))
    return rows.agg(
        F.count("*").alias("bookings"),
        F.sum(F.when(F.col("has_fare"), F.col("price"))).cast("double").alias("revenue"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
        F.when(F.count("fleet_id") > 0, F.array_sort(F.collect_set("fleet_id"))).alias("fleets"),
    )


@query("C04_lifetime", WITH_TRIPS + "SELECT driver_ext_id, max(requested_at) AS last_trip, arg_max(plate, {'a': requested_at, 'b': external_id}) AS last_plate, count(DISTINCT platform) AS platforms, count(*) AS trips FROM trip_norm WHERE is_booking GROUP BY 1")
def _(t):
    return norm(t).filter("is_booking").groupBy("driver_ext_id").agg(
        F.max("requested_at").alias("last_trip"), F.max_by("plate", F.struct("requested_at", "external_id")).alias("last_plate"), F.countDistinct("platform").alias("platforms"), F.count("*").alias("trips")
    )


@query("C06_first_event_day", "SELECT user_id, CAST(ts + INTERVAL 4 HOUR AS DATE) AS day, min(ts) AS first_at, arg_min(event_type, {'a': ts, 'b': event_id}) AS first_type FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", time.local_day(F.col("ts")).alias("day")).agg(F.min("ts").alias("first_at"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("C07_cash_fare_day", WITH_TRIPS + "SELECT local_day, count(*) AS trips, count(price) AS valued, CAST(sum(price) AS DOUBLE) AS cash FROM trip_norm WHERE is_booking AND lower(payment_type) IN ('cash', 'cash-driver') GROUP BY 1")
def _(t):
    rows = trips_ext(norm(t)).filter("is_booking and driver_holds_cash")
    return rows.groupBy("local_day").agg(F.count("*").alias("trips"), F.count("price").alias("valued"), F.sum("price").cast("double").alias("cash"))


@query("A02_hourly_mix", WITH_TRIPS + "SELECT platform, local_hour, count(*) AS n, count(*) FILTER (WHERE outcome = 'completed') AS completed FROM trip_norm WHERE is_booking GROUP BY 1, 2")
def _(t):
    return norm(t).filter("is_booking").groupBy("platform", "local_hour").agg(F.count("*").alias("n"), F.count(F.when(F.col("outcome") == "completed", 1)).alias("completed"))


@query("A02_D02_heatmap", WITH_TRIPS + "SELECT CAST(dayofweek(requested_at + INTERVAL 4 HOUR) AS BIGINT) AS dow, CAST(local_hour AS BIGINT) AS hour, count(*) AS n FROM trip_norm WHERE is_booking GROUP BY 1, 2")
def _(t):
    return norm(t).filter("is_booking").groupBy(F.col("local_dow").cast("bigint").alias("dow"), F.col("local_hour").cast("bigint").alias("hour")).agg(F.count("*").alias("n"))


@query("A27_weighted_mix", WITH_TRIPS + "SELECT platform, product, count(*) AS n, count(*) FILTER (WHERE has_distance) AS measured, round(sum(distance_km) FILTER (WHERE has_distance) / nullif(count(*) FILTER (WHERE has_distance), 0), 4) AS avg_km FROM trip_norm WHERE is_booking GROUP BY 1, 2")
def _(t):
    far = F.col("has_distance")
    return norm(t).filter("is_booking").groupBy("platform", "product").agg(
        F.count("*").alias("n"), F.count(F.when(far, 1)).alias("measured"), F.round(F.sum(F.when(far, F.col("distance_km"))) / F.nullif(F.count(F.when(far, 1)), F.lit(0)), 4).alias("avg_km")
    )


@query("A04_A05_A06_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS people, count(DISTINCT {'a': o_custkey, 'b': o_orderpriority}) AS pairs, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 200000) AS big_people FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(
        F.countDistinct("o_custkey").alias("people"), F.countDistinct(F.struct("o_custkey", "o_orderpriority")).alias("pairs"), F.countDistinct(F.when(F.col("o_totalprice") > 200000, F.col("o_custkey"))).alias("big_people")
    )


@query("A07_ratio", "SELECT c_mktsegment, round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / nullif(count(*) FILTER (WHERE c_acctbal > 9000), 0), 1) AS ratio FROM customer GROUP BY 1")
def _(t):
    count = lambda p: F.count(F.when(p, 1))
    return t.customer.groupBy("c_mktsegment").agg(F.round(100 * count(F.col("c_acctbal") < 0) / F.nullif(count(F.col("c_acctbal") > 9000), F.lit(0)), 1).alias("ratio"))


@query("A08_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.25) FILTER (WHERE hour(ts) < 12), 4) AS p25_morning FROM events GROUP BY 1")
def _(t):
    p = lambda c, q: F.round(F.percentile(c, F.lit(q)), 4)
    return t.events.groupBy("event_type").agg(p("value", 0.5).alias("p50"), p("value", 0.9).alias("p90"), p(F.when(F.hour("ts") < 12, F.col("value")), 0.25).alias("p25_morning"))


@query("A09_mode", "SELECT p_brand, arg_max(p_size, {'n': n, 'k': -p_size}) AS modal_size FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.mode("p_size", True).alias("modal_size"))


@query("A10_upper_median", "SELECT user_id, value AS upper_median FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn = n // 2 + 1")
def _(t):
    order = Window.partitionBy("user_id").orderBy("value", "event_id")
    rows = t.events.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    return rows.filter(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("user_id", F.col("value").alias("upper_median"))


@query("A11_A12_spread", "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, bool_or(p_size > 45) AS any_large, bool_and(p_size > 1) AS all_over_one FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"), F.bool_or(F.col("p_size") > 45).alias("any_large"), F.bool_and(F.col("p_size") > 1).alias("all_over_one"))


@query("A13_A16_arrays", "SELECT s_nationkey, list_sort(list(DISTINCT s_suppkey % 7)) AS sevenths, string_agg(s_name, ', ' ORDER BY s_name) FILTER (WHERE s_acctbal > 5000) AS rich FROM supplier GROUP BY 1")
def _(t):
    rich = F.array_compact(F.array_sort(F.collect_list(F.when(F.col("s_acctbal") > 5000, F.col("s_name")))))
    return t.supplier.groupBy("s_nationkey").agg(F.array_sort(F.collect_set(F.col("s_suppkey") % 7)).alias("sevenths"), F.when(F.size(rich) > 0, F.array_join(rich, ", ")).alias("rich"))


@query("A14_first_known", WITH_TRIPS + "SELECT plate, arg_min(fleet_id, {'a': requested_at, 'b': external_id}) FILTER (WHERE fleet_id IS NOT NULL) AS fleet, arg_min(payment_type, {'a': requested_at, 'b': external_id}) FILTER (WHERE payment_type IS NOT NULL) AS payment FROM trip_norm GROUP BY 1")
def _(t):
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("requested_at", "external_id")))
    return norm(t).groupBy("plate").agg(first("fleet_id").alias("fleet"), first("payment_type").alias("payment"))


@query("A15_arg_max", "SELECT l_suppkey, arg_max(l_partkey, {'a': l_extendedprice, 'b': -l_orderkey, 'c': -l_linenumber}) AS top_part FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("top_part"))


@query("A17_json_objects", "SELECT n_regionkey, '[' || string_agg('{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS refs FROM nation GROUP BY 1")
def _(t):
    refs = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(refs).alias("refs"))


@query("A18_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def _(t):
    # an aggregate instead of a window: it merges before the shuffle
    best = t.orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", (-F.col("o_orderkey")).alias("k"))).alias("m"))
    return best.select("o_custkey", (-F.col("m.k")).alias("o_orderkey"), F.col("m.o_orderdate").alias("o_orderdate"))


@query("A19_A20_two_level", WITH_TRIPS + "SELECT person_key, count(*) AS active_days, CAST(sum(n) AS BIGINT) AS trips, max(n) AS busiest FROM (SELECT person_key, local_day, count(*) AS n FROM trip_norm WHERE is_booking AND outcome = 'completed' GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    days = norm(t).filter("is_booking and outcome = 'completed'").groupBy("person_key", "local_day").agg(F.count("*").alias("n"))
    return days.groupBy("person_key").agg(F.count("*").alias("active_days"), F.sum("n").alias("trips"), F.max("n").alias("busiest")).filter("active_days >= 3")


@query("A21_modal_vote", "WITH t AS (SELECT p_size, p_type, count(*) AS votes FROM part GROUP BY 1, 2) SELECT p_size, p_type, votes, CAST(sum(votes) OVER w AS BIGINT) AS n, count(*) OVER w AS distinct_names FROM t WINDOW w AS (PARTITION BY p_size) QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY votes DESC, p_type) = 1")
def _(t):
    return agg.modal(t.part, ["p_size"], "p_type")


@query("A22_weighted_allocation", "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * (l_orderkey % 3) AS DOUBLE) AS w, o_totalprice AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT *, sum(w) OVER p AS total, count(*) OVER p AS n FROM l WINDOW p AS (PARTITION BY l_orderkey)) SELECT l_orderkey, l_linenumber, round(CASE WHEN total > 0 THEN w / total ELSE 1.0 / n END, 6) AS share, amount * (CASE WHEN total > 0 THEN w / total ELSE 1.0 / n END) AS allocated, CASE WHEN total > 0 THEN 'trips' ELSE 'even' END AS basis FROM s")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", (F.col("l_quantity") * (F.col("l_orderkey") % 3)).alias("w"), F.col("o_totalprice").alias("amount"))
    return agg.weighted_shares(rows, ["l_orderkey"], "w", "amount").select("l_orderkey", "l_linenumber", F.round("share", 6).alias("share"), "allocated", "basis")


PERIODS_SQL = """p AS (SELECT l_suppkey % 20 AS driver, l_partkey % 3 AS fleet, CAST(l_shipdate AS DATE) AS a, CAST(l_shipdate AS DATE) + CAST(l_linenumber - 1 AS INT) AS b,
  CAST(l_quantity AS DECIMAL(12,2)) AS amount, l_orderkey * 10 + l_linenumber AS seen FROM lineitem)"""


def _periods(t):
    rows = t.lineitem
    start = F.to_date("l_shipdate")
    return rows.select(
        (F.col("l_suppkey") % 20).alias("driver"), (F.col("l_partkey") % 3).alias("fleet"), start.alias("a"), F.date_add(start, (F.col("l_linenumber") - 1).cast("int")).alias("b"),
        F.col("l_quantity").cast("decimal(12,2)").alias("amount"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"),
    )


@query("A23_J16_period_to_day", f"WITH {PERIODS_SQL}, d AS (SELECT *, date_diff('day', a, b) + 1 AS n, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM p), r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY driver, fleet, day ORDER BY n, seen DESC, a) = 1), o AS (SELECT DISTINCT fleet, day FROM r WHERE n = 1) SELECT driver, r.fleet, r.day, n AS period_days, CASE WHEN n > 1 AND o.day IS NOT NULL THEN NULL ELSE round(CAST(amount AS DOUBLE) / n, 4) END AS day_amount, CASE WHEN n > 1 AND o.day IS NOT NULL THEN 'daily_filing_exists' END AS reason FROM r LEFT JOIN o ON r.fleet = o.fleet AND r.day = o.day")
def _(t):
    days = agg.period_to_days(_periods(t), ["driver", "fleet"], "a", "b", "amount", "seen")
    cut = agg.without_coarse(days, ["fleet"])
    return cut.select("driver", "fleet", "day", F.col("period_days").cast("bigint").alias("period_days"), F.round(F.col("day_amount").cast("double"), 4).alias("day_amount"), "reason")


COMPONENT_SQL = """c AS (SELECT l_suppkey AS driver, CAST(l_orderkey % 4 AS BIGINT) AS period,
  CASE l_returnflag WHEN 'A' THEN 'your_earnings' WHEN 'N' THEN 'tip' ELSE 'service_fee' END AS category,
  CASE l_linestatus WHEN 'O' THEN 'your_earnings' ELSE 'other' END AS parent, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount FROM lineitem)"""


@query("A24_A25_statement_fold", f"WITH {COMPONENT_SQL} SELECT driver, period, CAST(sum(amount) FILTER (WHERE category = 'your_earnings') - coalesce(sum(amount) FILTER (WHERE category = 'tip' AND parent = 'your_earnings'), 0) AS DOUBLE) AS net, CAST(sum(amount) FILTER (WHERE category = 'tip') AS DOUBLE) AS tips, CAST(-sum(amount) FILTER (WHERE category = 'service_fee') AS DOUBLE) AS fees FROM c GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("driver"), (F.col("l_orderkey") % 4).alias("period"),
        F.when(F.col("l_returnflag") == "A", "your_earnings").when(F.col("l_returnflag") == "N", "tip").otherwise("service_fee").alias("category"),
        F.when(F.col("l_linestatus") == "O", "your_earnings").otherwise("other").alias("parent"), F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"),
    )
    return agg.statement_fold(rows, ["driver", "period"]).select("driver", "period", *[F.col(c).cast("double").alias(c) for c in ("net", "tips", "fees")])


MONTHS_SQL = "a AS (SELECT DISTINCT o_custkey AS person, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)"


def _activity(t):
    return t.orders.select(F.col("o_custkey").alias("person"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))


@query("A26_cohorts", f"WITH {MONTHS_SQL}, f AS (SELECT person, min(month) AS cohort FROM a GROUP BY 1) SELECT cohort, CAST(date_diff('month', cohort, month) AS INT) AS \"offset\", count(*) AS retained, cohort = (SELECT min(month) FROM a) AS left_censored FROM a JOIN f USING (person) GROUP BY 1, 2")
def _(t):
    return agg.cohorts(_activity(t), "person", "month")


@query("A26_flow", f"WITH {MONTHS_SQL}, s AS (SELECT *, lag(month) OVER w AS before, lead(month) OVER w AS after FROM a WINDOW w AS (PARTITION BY person ORDER BY month)) SELECT month, count(*) AS active, count(*) FILTER (WHERE before IS NULL) AS joined, count(*) FILTER (WHERE before < month - INTERVAL 1 MONTH) AS returned, count(*) FILTER (WHERE after IS NULL OR after > month + INTERVAL 1 MONTH) AS \"left\" FROM s GROUP BY 1")
def _(t):
    return agg.flow(_activity(t), "person", "month")


@query("A30_ageing", WITH_TRIPS + ", r AS (SELECT *, date_diff('day', local_day, DATE '2001-08-01') AS age FROM trip_norm WHERE is_booking AND lower(payment_type) = 'room-charge') SELECT CASE WHEN age <= 30 THEN '0-30' WHEN age <= 60 THEN '31-60' WHEN age <= 90 THEN '61-90' ELSE '91+' END AS age, count(*) AS trips, CAST(sum(price) AS DOUBLE) AS amount, count(DISTINCT {'a': platform, 'b': fleet_id}) AS parties FROM r WHERE r.age >= 0 GROUP BY 1")
def _(t):
    rows = trips_ext(norm(t)).filter("is_booking and is_receivable")
    return agg.ageing(rows, F.to_date(F.lit("2001-08-01")), "local_day", "price", ["platform", "fleet_id"])


@query("A31_D12_coverage", "WITH c AS (SELECT event_type AS source, CAST(ts AS DATE) - CASE WHEN event_type = 'signup' AND day(ts) % 5 = 0 THEN 1 ELSE 0 END AS day, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT source, min(day) AS a, max(day) AS b, median(n) AS m FROM c GROUP BY 1), d AS (SELECT source, m, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s), j AS (SELECT source, day, coalesce(n, 0) AS n, m AS median, coalesce(n, 0) = 0 AND m > 0 AS silent FROM d LEFT JOIN c USING (source, day)) SELECT *, min(silent) OVER (PARTITION BY day) AS uncollected FROM j")
def _(t):
    # signups of every fifth day are filed a day early, so that days are missing
    early = F.when((F.col("event_type") == "signup") & (F.dayofmonth("ts") % 5 == 0), 1).otherwise(0)
    return agg.source_coverage(t.events.withColumn("day", F.date_sub(F.to_date("ts"), early)), "event_type", "day")


@query("C22_source_day_counts", "SELECT event_type AS source, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("C16_corridors", "SELECT n.n_name AS origin, s.n_name AS destination, count(*) AS trips, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    small = rows.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("trips"), F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("double").alias("value"))
    name = lambda key, out: t.nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(out))
    # names are joined after the keys are aggregated
    return small.join(name("c_nationkey", "origin"), "c_nationkey").join(name("s_nationkey", "destination"), "s_nationkey").select("origin", "destination", "trips", "value")


@query("C01_Q1_pricing", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2")
def _(t):
    rows = t.lineitem.filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '2000-09-02 00:00:00'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("qty"), F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("double").alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n")
    )


@query("P12_cancellations", WITH_TRIPS + "SELECT CASE WHEN outcome IS DISTINCT FROM 'not_completed' THEN NULL WHEN status = 'client_did_not_show' THEN 'rider' ELSE 'unattributed' END AS by_whom, platform, count(*) AS n FROM trip_norm GROUP BY 1, 2")
def _(t):
    return norm(t).groupBy(money.cancelled_by(F.col("outcome"), F.col("status")).alias("by_whom"), "platform").agg(F.count("*").alias("n"))


@query("P05_P07_window", WITH_TRIPS + "SELECT platform, count(*) AS n, min(requested_at) AS first_at FROM trip_norm WHERE local_day BETWEEN DATE '1997-03-01' AND DATE '1997-06-30' AND is_booking AND fleet_id = 'ASIA' GROUP BY 1")
def _(t):
    from datetime import date

    # the day bounds hold for the stored order dates too, one day wider: that filter reaches the scan
    orders = t.orders.filter(F.col("o_orderdate").between(F.expr("TIMESTAMP_NTZ '1997-02-27 00:00:00'"), F.expr("TIMESTAMP_NTZ '1997-07-01 00:00:00'")))

    class Narrow:
        customer, nation, region = t.customer, t.nation, t.region

    Narrow.orders = orders
    rows = bookings(Narrow).filter(time.span_filter(F.col("requested_at"), date(1997, 3, 1), date(1997, 6, 30)) & (F.col("fleet_id") == "ASIA"))
    return rows.groupBy("platform").agg(F.count("*").alias("n"), F.min("requested_at").alias("first_at"))


#: One row a booking's words: everything here is a column function of the library on one side and its text on the other.
@query("E04_column_macros", WITH_TRIPS + f"""SELECT regexp_replace(lower(trim(status)), '^optional_ride_', '') AS bare, outcome, regexp_replace(lower(trim(status)), '^optional_ride_', '') IN {listed(money.COMPLETED)} AS completed, {SETTLEMENT_SQL} AS settlement, {DAYPART_SQL} AS daypart,
  CASE WHEN outcome IS DISTINCT FROM 'not_completed' THEN NULL WHEN regexp_replace(lower(trim(status)), '^optional_ride_', '') IN {listed(money.DROPPED + money.DECLINED)} THEN 'driver' WHEN regexp_replace(lower(trim(status)), '^optional_ride_', '') IN {listed(money.RIDER)} THEN 'rider' ELSE 'unattributed' END AS cancelled_by,
  CASE WHEN date_diff('day', DATE '2000-01-01', local_day) < 0 THEN 'expired' WHEN date_diff('day', DATE '2000-01-01', local_day) <= 30 THEN 'd30' WHEN date_diff('day', DATE '2000-01-01', local_day) <= 45 THEN 'd45' WHEN date_diff('day', DATE '2000-01-01', local_day) <= 90 THEN 'd90' ELSE 'ok' END AS expiry, count(*) AS n FROM trip_norm WHERE is_booking GROUP BY ALL""")
def _(t):
    rows, status = norm(t).filter("is_booking"), F.col("status")
    macros = {
        "bare": money.bare_status(status), "outcome": money.outcome(status), "completed": money.completed(status), "settlement": money.settlement_class(F.col("payment_type")), "daypart": time.daypart(F.col("local_hour")),
        "cancelled_by": money.cancelled_by(money.outcome(status), status), "expiry": money.document_status(F.datediff("local_day", F.lit("2000-01-01"))),
    }
    return rows.groupBy(*[c.alias(n) for n, c in macros.items()]).agg(F.count("*").alias("n"))
