"""Feeds, predicates, calendars, places and the streaming refresh: groups A, B and I, and
what of J, H and K stands on them.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from caravel.functions import geo, money, text, time
from caravel.operators import identity, joins, places
from caravel.plans.registry import query
from caravel.plans.rollups import norm
from caravel.sources import readers, sinks
from caravel.sources.fleet import WITH_TRIPS, listed, trips_ext
from caravel.streaming import status


def literal(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


@query("S02_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    path = joins.shared_path(t.spark, "report")
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(path)
    return readers.csv_trips(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("S01_S06_landed_json", "SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY 1")
def _(t):
    path = joins.shared_path(t.spark, "landed")
    t.nation.write.json(path)
    feed = readers.SourceSpec("nations", path, "json", "n_nationkey int, n_name string, n_regionkey int")
    return feed.read(t.spark).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.min("n_name").alias("first"))


@query("S04_S10_paged", "SELECT i AS n, i * i AS square FROM range(1000) t(i)")
def _(t):
    def page(first: int, size: int) -> list[dict]:
        return [{"n": n, "square": n * n} for n in range(first, min(first + size, 1000))]

    return readers.paged(t.spark, page, 1000, 64, "n bigint, square bigint")


@query("S05_pivoted", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS row, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def _(t):
    lines = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    column = lambda key: F.struct(F.lit(key).alias("key"), F.transform("lines", lambda r: r[key].cast("string")).alias("cells"))
    table = t.nation.agg(lines.alias("lines")).select(F.array(column("id"), column("name")).alias("columns"))
    return readers.pivoted(table).select("row", F.col("cells")["id"].alias("id"), F.col("cells")["name"].alias("name"))


@query("S08_status_rows", "SELECT DISTINCT user_id AS driver, ts AS at, event_type AS status FROM events UNION SELECT user_id, ts - INTERVAL 1 MINUTE, 'view' FROM events WHERE event_type = 'purchase'")
def _(t):
    earlier = F.array(F.struct((F.col("ts") - F.expr("INTERVAL '1' MINUTE")).alias("at"), F.lit("view").alias("status")))
    seen = t.events.select(F.col("user_id").alias("driver"), F.col("event_type").alias("status"), F.col("ts").alias("changed_at"), F.when(F.col("event_type") == "purchase", earlier).alias("changes"))
    return readers.status_rows(seen, F.col("changed_at"))


@query("S07_S09_timeline", "SELECT DISTINCT user_id AS driver, date_trunc('millisecond', ts) AS at, 'status' AS kind, event_type AS status, CAST(NULL AS VARCHAR) AS state FROM events UNION SELECT user_id, date_trunc('millisecond', ts) + INTERVAL 5 SECOND, 'job', event_type, 'accepted' FROM events WHERE event_type = 'purchase'")
def _(t):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    change = F.array(F.struct((ms + 5000).alias("timestamp"), F.lit("accepted").alias("type")))
    events = t.events.select(F.col("user_id").alias("driver"), ms.alias("timestamp"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("jobuuid"), F.when(F.col("event_type") == "purchase", change).alias("stateChange"))
    return readers.timeline_rows(events).select("driver", F.col("at").cast("timestamp_ntz").alias("at"), "kind", "status", "state")


@query("S11_breakdown", "WITH l AS (SELECT l_orderkey AS k, 'paid.' || l_linestatus AS path, CAST(sum(l_quantity) AS DOUBLE) AS amount FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey AS k, count(DISTINCT l_returnflag) > 1 AS mixed_currency FROM lineitem GROUP BY 1) SELECT * FROM l JOIN m USING (k)")
def _(t):
    leaf = F.struct(F.col("l_linestatus").alias("name"), F.col("l_quantity").alias("amount"), F.col("l_returnflag").alias("currency"))
    trees = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.to_json(F.array(F.struct(F.lit("paid").alias("name"), F.collect_list(leaf).alias("children")))).alias("nodes"))
    return readers.flattened(trees, "k", "nodes")


@query("S14_S15_S26_workbook", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(t):
    book = sinks.workbook(t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey"))
    files = t.spark.createDataFrame([("nations.xlsx", bytearray(book))], "path string, content binary")
    return readers.headed_rows(readers.cells_of(files), ["n_nationkey", "n_name"]).select("n_nationkey", "n_name")


@query("S16_statement", "SELECT c_custkey AS line, CASE WHEN c_mktsegment = 'BUILDING' THEN 'bad_day' WHEN c_acctbal < 0 THEN 'bad_amount' END AS reason FROM customer")
def _(t):
    day = F.when(F.col("c_mktsegment") == "BUILDING", "31/12").otherwise("2024-01-31")
    amount = F.when(F.col("c_acctbal") < 0, "minus").otherwise(F.format_number("c_acctbal", 2))
    good, bad = readers.statement_lines(t.customer.select(F.col("c_custkey").alias("line"), day.alias("day"), amount.alias("amount")))
    return good.select("line", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("line", "reason"))


@query("S17_P10_scan", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def _(t):
    rows = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


ASKED = [("ASIA", "R1"), ("EUROPE", "R2"), ("AFRICA", None)]


@query("S20_S21_parameters", f"SELECT n, r_name, tag, r_regionkey FROM (SELECT CAST(row_number() OVER () AS BIGINT) AS n, * FROM {literal(ASKED)} v(r_name, tag)) LEFT JOIN region USING (r_name)")
def _(t):
    names, tags = zip(*ASKED)
    return readers.parameter_rows(t.spark, r_name=list(names), tag=list(tags)).join(t.region, "r_name", "left").select("n", "r_name", "tag", "r_regionkey")


@query("S27_cached_result", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(t):
    cache = sinks.ResultCache(2)
    build = lambda: t.nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    cache.get("nations", "v1", build)
    return cache.get("nations", "v1", build)


PAID = [("Cash", "cash"), (" ", None), (None, None), ("KCP_PG", "card"), ("in_app", "wallet"), ("business", "on_account"), ("salary", "salary"), ("FOC", "complimentary"), ("foc-other", "other"), ("offline", "off_platform"), ("derivative", "adjustment"), ("barter", "other")]


@query("P02_settlement", f"SELECT word, kind FROM {literal(PAID)} v(word, kind)")
def _(t):
    words = t.spark.createDataFrame([(w,) for w, _ in PAID], "word string")
    return words.select("word", money.settlement_class(F.col("word")).alias("kind"))


@query("P03_P06_guards", WITH_TRIPS + "SELECT has_fare, has_distance, count(*) AS n, CAST(sum(price) FILTER (WHERE has_fare) AS DOUBLE) AS fares FROM trip_norm WHERE is_booking GROUP BY 1, 2")
def _(t):
    return norm(t).filter("is_booking").groupBy("has_fare", "has_distance").agg(F.count("*").alias("n"), F.sum(F.when(F.col("has_fare"), F.col("price"))).cast("double").alias("fares"))


@query("P04_daypart", WITH_TRIPS + "SELECT platform, CASE WHEN local_hour < 5 THEN 'night' WHEN local_hour < 10 THEN 'morning' WHEN local_hour < 15 THEN 'midday' WHEN local_hour < 20 THEN 'evening' ELSE 'late' END AS daypart, count(*) AS n FROM trip_norm GROUP BY 1, 2")
def _(t):
    return trips_ext(norm(t)).groupBy("platform", "daypart").agg(F.count("*").alias("n"))


@query("P08_patterns", "SELECT p_type, count(*) FILTER (WHERE p_name ILIKE '%WIDGET%') AS widgets, count(*) FILTER (WHERE regexp_matches(p_name, '^(red|blue) ')) AS coloured, count(*) FILTER (WHERE regexp_matches(p_brand, 'BRAND#1[0-9]$', 'i')) AS tens FROM part GROUP BY 1")
def _(t):
    count = lambda p: F.count(F.when(p, 1))
    name = F.col("p_name")
    return t.part.groupBy("p_type").agg(count(name.ilike("%WIDGET%")).alias("widgets"), count(name.rlike("^(red|blue) ")).alias("coloured"), count(F.col("p_brand").rlike("(?i)BRAND#1[0-9]$")).alias("tens"))


@query("P09_null_safe", WITH_TRIPS + "SELECT fleet_id IS NOT DISTINCT FROM nullif(platform, 'fms') AS same, fleet_id IS DISTINCT FROM 'ASIA' AS elsewhere, count(*) AS n FROM trip_norm GROUP BY 1, 2")
def _(t):
    fleet = F.col("fleet_id")
    return norm(t).groupBy(fleet.eqNullSafe(F.nullif("platform", F.lit("fms"))).alias("same"), (~fleet.eqNullSafe(F.lit("ASIA"))).alias("elsewhere")).agg(F.count("*").alias("n"))


@query("P10_not_in_pairs", "SELECT s_suppkey FROM supplier WHERE (s_nationkey, CAST(floor(s_acctbal / 1000) AS INT)) NOT IN (SELECT c_nationkey, CAST(floor(c_acctbal / 1000) AS INT) FROM customer WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment = 'BUILDING')")
def _(t):
    band = lambda c: F.floor(F.col(c) / 1000).cast("int").alias("band")
    taken = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("s_nationkey"), band("c_acctbal")).distinct()
    return t.supplier.select("s_suppkey", "s_nationkey", band("s_acctbal")).join(taken, ["s_nationkey", "band"], "left_anti").select("s_suppkey")


ALERTS = [("Power cut", True), ("GPS lost", True), ("Harsh braking", False), ("low BATTERY", True), (None, False), ("over speed", False)]


@query("P11_device_faults", f"SELECT alert, fault FROM {literal([(a, int(f)) for a, f in ALERTS])} v(alert, f), (SELECT unnest([TRUE, FALSE]) AS fault) WHERE fault = (f = 1)")
def _(t):
    words = t.spark.createDataFrame([(a,) for a, _ in ALERTS], "alert string")
    return words.select("alert", money.device_fault(F.col("alert")).alias("fault"))


@query("P13_completed", f"SELECT o_orderstatus, regexp_replace(lower(trim(s)), '^optional_ride_', '') IN {listed(money.COMPLETED)} AS done, count(*) AS n FROM (SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN ' Optional_Ride_Finished ' WHEN 'O' THEN 'optional_ride_open' ELSE 'CLOSED' END AS s FROM orders) GROUP BY 1, 2")
def _(t):
    word = F.when(F.col("o_orderstatus") == "F", " Optional_Ride_Finished ").when(F.col("o_orderstatus") == "O", "optional_ride_open").otherwise("CLOSED")
    return t.orders.groupBy("o_orderstatus", money.completed(word).alias("done")).agg(F.count("*").alias("n"))


ADDRESSES = [
    ("Dubai International Airport - Terminal 3", "OMDB"), ("Terminal 1 Arrivals", "OMDB"), ("Terminal 1 Bus Station", None), ("DXB Terminal 2", "OMDB"),
    ("Al Maktoum International Airport", "OMDW"), ("Hall (DWC)", "OMDW"), ("Hotel near Dubai International Airport", None), ("Marina Walk", None), ("  ", None), (None, None),
]


@query("P14_airports", f"SELECT addr, icao FROM {literal(ADDRESSES)} v(addr, icao)")
def _(t):
    rows = t.spark.createDataFrame([(a,) for a, _ in ADDRESSES], "addr string")
    return rows.select("addr", money.airport_of(F.col("addr")).alias("icao"))


@query("P15_stored_key", "SELECT trim(regexp_replace(lower(c_name), '\\s+', ' ', 'g')) AS person_key, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    stored = joins.written(t.customer.withColumn("person_key", text.person_fold(F.col("c_name"))), "stored-key")
    return stored.groupBy("person_key").agg(F.count("*").alias("n"))


@query("P16_ranked_order", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS INT) AS place FROM orders")
def _(t):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    price = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice"))
    order = Window.partitionBy("o_custkey").orderBy(rank, F.desc("o_orderdate"), price.desc_nulls_last(), "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(order).alias("place"))


@query("J26_nearest_booking", WITH_TRIPS + "SELECT p.event_id, b.driver_name, b.status FROM (SELECT event_id, event_id * 4 AS k, event_type FROM events) p LEFT JOIN (SELECT * FROM trip_norm WHERE is_booking AND coalesce(trim(driver_name), '') <> '') b ON b.external_id = p.k AND b.platform = CASE WHEN p.event_type = 'view' THEN 'building' ELSE 'machinery' END")
def _(t):
    stored = t.events.select("event_id", (F.col("event_id") * 4).alias("external_id"), F.when(F.col("event_type") == "view", "building").otherwise("machinery").alias("platform"))
    named = norm(t).filter("is_booking and coalesce(trim(driver_name), '') <> ''").select("external_id", "platform", "driver_name", "status")
    return stored.join(named, ["external_id", "platform"], "left").select("event_id", "driver_name", "status")


@query("J27_status_history", """WITH c AS (SELECT event_id AS segment_id, user_id % 40 AS person, ts AS started_at FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id % 40 AS person, ts AS "at", event_type AS status FROM events WHERE event_type IN ('view', 'click')), b AS (SELECT segment_id, max({'a': e."at", 's': status}) AS s FROM c JOIN e ON e.person = c.person AND e."at" <= c.started_at GROUP BY 1) SELECT c.segment_id, c.person, b.s['s'] AS status, b.s['a'] AS "at" FROM c LEFT JOIN b USING (segment_id)""")
def _(t):
    person = (F.col("user_id") % 40).alias("person")
    candidates = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("segment_id"), person, F.col("ts").alias("started_at"))
    accounts = t.events.select(person, F.col("user_id").alias("account")).distinct()
    events = t.events.filter("event_type in ('view', 'click')").select(F.col("user_id").alias("account"), F.col("ts").alias("at"), F.col("event_type").alias("status"))
    newest = events.groupBy("account", "at").agg(F.max("status").alias("status"))
    return joins.status_at(candidates, accounts, newest)


@query("W16_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_before FROM events")
def _(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy(micros).rangeBetween(-86_400_000_000, 0)).alias("day_before"))


CODES = [("8FVC2222+22", 47.0000625, 8.0000625), ("7FG49Q00+", 20.375, 2.775), ("8FVC2222+22G", 47.0000625, 8.000078125), ("no code", None, None), (None, None, None)]


@query("F16_plus_codes", f"SELECT code, round(CAST(lat AS DOUBLE), 6) AS lat, round(CAST(lng AS DOUBLE), 6) AS lng FROM {literal(CODES)} v(code, lat, lng)")
def _(t):
    rows = t.spark.createDataFrame([(c,) for c, *_ in CODES], "code string").withColumn("p", text.plus_code_centre(F.col("code")))
    return rows.select("code", F.round("p.lat", 6).alias("lat"), F.round("p.lng", 6).alias("lng"))


TODAY = date(2024, 8, 14)
PERIODS = [
    ("today", "2024-08-14", "2024-08-14"), ("yesterday", "2024-08-13", "2024-08-13"), ("week", "2024-08-12", "2024-08-14"), ("month", "2024-08-01", "2024-08-14"),
    ("quarter", "2024-07-01", "2024-08-14"), ("year", "2024-01-01", "2024-08-14"), ("last_week", "2024-08-05", "2024-08-11"), ("last_month", "2024-07-01", "2024-07-31"),
    ("2024-08", "2024-08-01", "2024-08-14"), ("2024-02", "2024-02-01", "2024-02-29"), ("2023-Q4", "2023-10-01", "2023-12-31"), ("2023", "2023-01-01", "2023-12-31"),
]


@query("D06_periods", f"SELECT name, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi FROM {literal(PERIODS)} v(name, lo, hi)")
def _(t):
    return t.spark.createDataFrame([(n, *time.period_window(n, TODAY)) for n, *_ in PERIODS], "name string, lo date, hi date")


SAID = [("last 10 days", "2024-08-05", "2024-08-14"), ("March 2024", "2024-03-01", "2024-03-31"), ("since yesterday", "2024-08-13", "2024-08-14"), ("Q2 2023", "2023-04-01", "2023-06-30"), ("2024-01-05 to 2024-01-09", "2024-01-05", "2024-01-09"), ("revenue this  month", "2024-08-01", "2024-08-14"), ("hello", None, None)]


@query("D07_said_periods", f"SELECT said, CAST(lo AS DATE) AS lo, CAST(hi AS DATE) AS hi FROM {literal(SAID)} v(said, lo, hi)")
def _(t):
    return t.spark.createDataFrame([(s, *(time.resolve_period(s, TODAY) or (None, None))) for s, *_ in SAID], "said string, lo date, hi date")


@query("D09_D10_chunks", "SELECT 'chunk' AS kind, CAST(d AS DATE) AS lo, CAST(least(d + INTERVAL 30 DAY, TIMESTAMP '2024-08-14') AS DATE) AS hi FROM generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-08-14', INTERVAL 31 DAY) g(d) UNION ALL SELECT 'week', CAST(d AS DATE), CAST(d + INTERVAL 6 DAY AS DATE) FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-08-05', INTERVAL 7 DAY) g(d) UNION ALL SELECT 'grain-' || CASE WHEN n <= 45 THEN 'day' WHEN n <= 300 THEN 'week' ELSE 'month' END, DATE '2024-01-01', CAST(TIMESTAMP '2024-01-01' + to_days(CAST(n - 1 AS INT)) AS DATE) FROM (VALUES (45), (46), (300), (301)) v(n)")
def _(t):
    lo, new_year = date(2024, 1, 3), date(2024, 1, 1)
    rows = [("chunk", a, b) for a, b in time.date_chunks(lo, TODAY)] + [("week", a, b) for a, b in time.week_chunks(lo, TODAY, TODAY)]
    ends = [new_year + timedelta(days=n - 1) for n in (45, 46, 300, 301)]
    return t.spark.createDataFrame(rows + [(f"grain-{time.auto_grain(new_year, e)}", new_year, e) for e in ends], "kind string, lo date, hi date")


RUNWAYS = [("OMDB", "12", 25.25, 55.36, 120.0), ("OMDB", "30", 25.25, 55.36, 300.0), ("OMDW", "30", 24.9, 55.17, 300.0)]
FLYING = "SELECT c_custkey AS icao24, 24.85 + (c_custkey % 100) * 0.005 AS lat, 55.1 + (c_custkey % 37) * 0.01 AS lng, CAST(c_custkey % 36 * 10 AS DOUBLE) AS track, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 13 * 100.0 END AS baro_m, 500.0 AS geo_m, c_custkey % 4 - 3.0 AS climb_ms, c_custkey % 9 * 12.0 AS speed_ms, c_custkey % 6 = 0 AS on_ground FROM customer"


@query("M02_approaches", f"""WITH s AS ({FLYING}), r AS (SELECT * FROM {literal(RUNWAYS)} v(airport, runway, a, b, heading)),
d AS (SELECT *, (a - lat) * 60 AS n, (b - lng) * 60 * cos(radians((a + lat) / 2)) AS e, coalesce(baro_m, geo_m) AS alt FROM s, r),
p AS (SELECT *, sqrt(n * n + e * e) AS dist, n * cos(radians(track)) + e * sin(radians(track)) AS along, abs(n * sin(radians(track)) - e * cos(radians(track))) AS side,
  least(abs(track - heading), 360 - abs(track - heading)) AS turn FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY round(side, 2), airport, runway) AS i FROM p
  WHERE dist <= 6 AND turn <= 20 AND along >= -0.5 AND side <= 1.5 AND CASE WHEN on_ground THEN dist <= 3 AND speed_ms > 20 ELSE alt <= 900 AND climb_ms <= -0.5 END)
SELECT icao24, airport, runway, round(along, 2) AS along_nm, round(side, 2) AS cross_nm, round(dist, 2) AS dist_nm, CAST(alt AS DOUBLE) AS alt_m,
  CAST(round(greatest(along, 0) * 1852 / CASE WHEN speed_ms > 30 THEN speed_ms ELSE 70 END) AS BIGINT) AS eta_s FROM f WHERE i = 1""")
def _(t):
    k = F.col("c_custkey")
    states = t.customer.select(
        k.alias("icao24"), (24.85 + k % 100 * 0.005).alias("lat"), (55.1 + k % 37 * 0.01).alias("lng"), (k % 36 * 10).cast("double").alias("track"),
        F.when(k % 5 > 0, k % 13 * 100.0).alias("baro_m"), F.lit(500.0).alias("geo_m"), (k % 4 - 3.0).alias("climb_ms"), (k % 9 * 12.0).alias("speed_ms"), (k % 6 == 0).alias("on_ground"),
    )
    return geo.approaches(states, t.spark.createDataFrame(RUNWAYS, "airport string, runway string, lat double, lng double, heading double"))


@query("T01_T02_T03_T15_available_now", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def _(t):
    """Two runs of the scheduled job on one checkpoint: the second finds nothing to do."""
    table, checkpoint = joins.shared_path(t.spark, "landed-events"), joins.shared_path(t.spark, "offsets")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{table}/batch={n}")  # noqa: E731  a batch that runs again writes its own folder anew
    for _ in range(2):
        status.run_batches(status.event_stream(t.spark, f"{t._folder}/event[s].parquet", t.events.schema), write, checkpoint).awaitTermination()
    return t.spark.read.parquet(table).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("C08_money_events", "SELECT source, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(14,2))) AS DOUBLE) AS amount FROM (SELECT 'fare' AS source, o_totalprice AS amount FROM orders UNION ALL SELECT 'fee', -l_extendedprice * l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax * l_extendedprice FROM lineitem UNION ALL SELECT 'balance', c_acctbal FROM customer UNION ALL SELECT 'payout', s_acctbal FROM supplier) GROUP BY 1")
def _(t):
    part = lambda df, source, amount: df.select(F.lit(source).alias("source"), F.expr(amount).cast("decimal(14,2)").alias("amount"))
    rows = part(t.orders, "fare", "o_totalprice").unionByName(part(t.lineitem, "fee", "-l_extendedprice * l_discount")).unionByName(part(t.lineitem, "tax", "l_tax * l_extendedprice"))
    rows = rows.unionByName(part(t.customer, "balance", "c_acctbal")).unionByName(part(t.supplier, "payout", "s_acctbal"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


@query("C15_canonical_vehicle", "WITH v AS (SELECT 'V-' || p_size AS plate, lower(p_type) AS platform, nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END), '') AS make, p_partkey AS r FROM part) SELECT plate, arg_min(platform, r) AS platform, list_sort(list(DISTINCT platform)) AS platforms, count(*) AS records, arg_min(make, r) FILTER (WHERE make IS NOT NULL) AS make FROM v GROUP BY 1")
def _(t):
    make = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand"))
    rows = t.part.select(F.concat(F.lit("V-"), F.col("p_size")).alias("plate"), F.lower("p_type").alias("platform"), make.alias("make"), "p_partkey")
    return identity.canonical(rows, "plate", F.col("p_partkey"), ["make"])


ENDS = [
    ("a", "Gate 2 - Marina - Dubai - AE", None, None, "V1", 1, 0, 0, None, None, "Marina", "address", None),
    ("b", "beside old souk gate", None, None, "V1", 1, 0, 0, None, None, "Old Souk", "address_name", None),
    ("c", "8FVC2222+22 somewhere", None, None, "V1", 1, 0, 0, None, None, "Zurich", "plus_code", None),
    ("d", None, 25.2, 55.3, "V1", 1, 0, 0, None, None, "Creek", "coordinates", None),
    ("e", None, None, None, "V1", 1, 0, 0, 25.2, 55.3, "Creek", "tracker", None),
    ("f", None, 1.0, 1.0, "V1", 1, 0, 0, None, None, None, None, "unnamed_cell"),
    ("g", "", None, None, None, 1, 0, 0, 25.2, 55.3, None, None, "no_plate"),
    ("h", None, None, None, "V1", 0, 1, 0, None, None, None, None, "cancelled"),
    ("i", None, None, None, "V1", 0, 0, 0, None, None, None, None, "no_time"),
    ("j", None, None, None, "V1", 1, 0, 1, 25.2, 55.3, None, None, "scheduled"),
    ("k", None, None, None, "V1", 1, 0, 0, None, None, None, None, "no_fix"),
]


@query("C13_places", f"SELECT id, area, basis, reason FROM {literal([(e[0], *e[10:]) for e in ENDS])} v(id, area, basis, reason)")
def _(t):
    ends = t.spark.createDataFrame([e[:10] for e in ENDS], "id string, addr string, lat double, lng double, plate string, timed int, c int, s int, fix_lat double, fix_lng double")
    ends = ends.select("*", F.when(F.col("timed") == 1, F.lit("2024-01-01").cast("timestamp")).alias("at"), (F.col("c") == 1).alias("cancelled"), (F.col("s") == 1).alias("scheduled"))
    known = t.spark.createDataFrame([(25.2, 55.3, "Creek"), (47.0000625, 8.0000625, "Zurich")], "lat double, lng double, area string")
    cells = known.select(geo.cell(F.col("lat")).alias("cell_lat"), geo.cell(F.col("lng")).alias("cell_lng"), "area")
    return places.resolved(ends, cells, ["Old Souk", "Souk"])
