"""Text, dates, JSON and statistics: groups H and J."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from caravel.functions import geo, money, stats, text, time
from caravel.operators import algebra, forecast, identity
from caravel.plans.registry import query
from caravel.plans.rollups import norm
from caravel.sources.fleet import WITH_TRIPS, trips_ext


@query("F01_F02_folds", r"SELECT c_custkey, trim(regexp_replace(lower(c_name || '  ' || c_name), '\s+', ' ', 'g')) AS spaced, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS folded FROM customer")
def _(t):
    twice = F.concat(F.col("c_name"), F.lit("  "), F.col("c_name"))
    return t.customer.select("c_custkey", F.trim(F.regexp_replace(F.lower(twice), r"\s+", " ")).alias("spaced"), text.fold_name(F.col("c_name")).alias("folded"))


TRIGRAMS = lambda c: f"list_distinct(list_transform(range(1, length({c}) + 2), lambda i: substring('  ' || {c} || ' ', i, 3)))"


@query("F03_trigram", f"WITH p AS (SELECT DISTINCT p_name AS a FROM part), q AS (SELECT DISTINCT p_name AS b FROM part), j AS (SELECT a, b, {TRIGRAMS('a')} AS ta, {TRIGRAMS('b')} AS tb FROM p JOIN q ON string_split(a, ' ')[1] = string_split(b, ' ')[1]) SELECT a, b, round(CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))), 6) AS score FROM j")
def _(t):
    side = lambda n: t.part.select(F.col("p_name").alias(n), F.split("p_name", " ")[0].alias("w")).distinct()
    return side("a").join(side("b"), "w").select("a", "b", F.round(text.trigram_score(F.col("a"), F.col("b")), 6).alias("score"))


#: Part names, the same with a word more, and turned round.
NAMED = "SELECT DISTINCT unnest([p_name, p_name || ' ' || lower(p_type), split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)]) AS name FROM part"


def named(t):
    turned = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    return t.part.select(F.explode(F.array("p_name", F.concat_ws(" ", "p_name", F.lower("p_type")), turned)).alias("name")).distinct()


@query("F04_edit_distance", "WITH n AS (SELECT DISTINCT p_name AS a, substring(p_name, 1, 2) || substring(p_name, 4, 1) || substring(p_name, 3, 1) || substring(p_name, 6) AS b FROM part) SELECT a.a, b.b, least(damerau_levenshtein(a.a, b.b), 4) AS edits FROM n a JOIN n b ON length(a.a) = length(b.b)")
def _(t):
    changed = F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1), F.substring("p_name", 3, 1), F.substring("p_name", 6, 100))
    names = t.part.select(F.col("p_name").alias("a"), changed.alias("b")).distinct()
    met = names.select("a", F.length("a").alias("n")).join(names.select("b", F.length("b").alias("n")), "n")
    return met.select("a", "b", text.edit_distance(F.col("a"), F.col("b"), 3).cast("bigint").alias("edits"))


WANTED_SQL = "SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN substring(p_name, 1, 2) || substring(p_name, 4) WHEN 2 THEN substring(p_name, 1, 1) || ' ' || split_part(p_name, ' ', 2) ELSE 'zzyx ' || split_part(p_name, ' ', 2) || 'q' END AS wanted FROM part"


@query("F05_name_match", f"""WITH w AS ({WANTED_SQL}), p AS (SELECT DISTINCT p_name AS name FROM part),
c AS (SELECT wanted, name, list_filter(string_split(wanted, ' '), lambda x: x <> '') AS wa, string_split(name, ' ') AS wb FROM w, p),
s AS (SELECT *, CASE WHEN len(wa) <= len(wb) THEN wa ELSE wb END AS f, CASE WHEN len(wa) <= len(wb) THEN wb ELSE wa END AS m FROM c),
k AS (SELECT wanted, name, CAST(len(list_filter(f, lambda x: list_contains(m, x) OR len(list_filter(m, lambda y: (length(x) >= 4 AND length(y) >= 4 AND damerau_levenshtein(x, y) <= 1) OR (length(x) <= 2 AND length(y) > 2 AND starts_with(y, x)))) > 0)) AS DOUBLE) / len(f) AS tokens, {TRIGRAMS('wanted')} AS ta, {TRIGRAMS('name')} AS tb FROM s),
r AS (SELECT wanted, name, CASE WHEN wanted = name THEN 1.0 ELSE round(0.7 * tokens + 0.3 * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 3) END AS score FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY score DESC, name DESC) AS i, lead(score) OVER (PARTITION BY wanted ORDER BY score DESC, name DESC) AS next FROM r WHERE score >= 0.45)
SELECT w.wanted, o.name AS best, o.score, o.next, CASE WHEN o.name IS NULL THEN 'none' WHEN w.wanted = o.name THEN 'exact' WHEN o.score - o.next < 0.08 THEN 'ambiguous' WHEN o.score >= 0.86 THEN 'likely' ELSE 'weak' END AS verdict
FROM w LEFT JOIN o ON o.wanted = w.wanted AND o.i = 1""")
def _(t):
    kind, second = F.col("p_size") % 4, F.split_part("p_name", F.lit(" "), F.lit(2))
    dropped = F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 100))
    strange = F.concat(F.lit("zzyx "), second, F.lit("q"))
    wanted = F.when(kind == 0, F.col("p_name")).when(kind == 1, dropped).when(kind == 2, F.concat(F.substring("p_name", 1, 1), F.lit(" "), second)).otherwise(strange)
    return identity.matched(t.part.select(wanted.alias("wanted")), t.part.select(F.col("p_name").alias("name")))


KEY_SQL = "array_to_string(list_sort(list_distinct(string_split(name, ' '))), ' ')"


@query("J30_contained_names", f"WITH k AS (SELECT DISTINCT {KEY_SQL} AS key FROM ({NAMED})) SELECT a.key AS short, b.key AS long FROM k a JOIN k b ON len(string_split(a.key, ' ')) < len(string_split(b.key, ' ')) AND list_has_all(string_split(b.key, ' '), string_split(a.key, ' '))")
def _(t):
    classes = identity.name_classes(named(t).select(F.col("name").alias("id"), "name"))
    return identity.contained_names(classes.select("key").distinct())


#: Accounts: a name with its words turned round on every second platform, and with a word more on the third.
ACCOUNT_SQL = """SELECT p_name || '#' || p_size % 5 AS id, CASE p_size % 5 WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 2 THEN p_name || ' senior' ELSE p_name END AS name,
    'V-' || p_partkey % 20 AS plate, TIMESTAMP '2024-01-01' + INTERVAL 2 HOUR * CAST(p_partkey % 5000 AS INT) AS s, TIMESTAMP '2024-01-01' + INTERVAL 2 HOUR * CAST(p_partkey % 5000 AS INT) + INTERVAL 5 MINUTE * p_size AS e, CASE WHEN p_partkey % 200 < 2 THEN CAST(950000000 + p_partkey // 2 AS VARCHAR) END AS phone FROM part"""


@query("C23_J31_persons", f"""WITH RECURSIVE r AS ({ACCOUNT_SQL}), acc AS (SELECT DISTINCT id, {KEY_SQL} AS key FROM r),
f AS (SELECT key, min(id) AS first FROM acc GROUP BY 1), pairs AS (
    SELECT first AS x, id AS y FROM acc JOIN f USING (key) WHERE first <> id
    UNION SELECT a.first, b.first FROM f a JOIN f b ON len(string_split(a.key, ' ')) < len(string_split(b.key, ' ')) AND list_has_all(string_split(b.key, ' '), string_split(a.key, ' '))),
ab AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM pairs),
car AS (SELECT DISTINCT a, b FROM ab JOIN r p ON p.id = a JOIN r q ON q.id = b AND q.plate = p.plate),
bad AS (SELECT DISTINCT a, b FROM ab JOIN r p ON p.id = a JOIN r q ON q.id = b AND q.plate <> p.plate AND p.s < q.e AND q.s < p.e),
ph AS (SELECT min(id) AS a, max(id) AS b FROM (SELECT DISTINCT id, phone FROM r) GROUP BY phone HAVING count(*) = 2 AND count(DISTINCT split_part(id, '#', 2)) = 2),
l AS (SELECT * FROM car WHERE (a, b) NOT IN (SELECT (a, b) FROM bad) UNION SELECT a, b FROM ph),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), w AS (SELECT x AS node, x AS seen FROM e UNION SELECT w.node, e.y FROM w JOIN e ON e.x = w.seen)
SELECT node AS id, min(seen) AS person FROM w GROUP BY 1""")
def _(t):
    band, second = F.col("p_size") % 5, F.split_part("p_name", F.lit(" "), F.lit(2))
    turned = F.concat_ws(" ", second, F.split_part("p_name", F.lit(" "), F.lit(1)))
    name = F.when(band == 1, turned).when(band == 2, F.concat("p_name", F.lit(" senior"))).otherwise(F.col("p_name"))
    begin = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_interval(hours=(F.col("p_partkey") % 5000 * 2).cast("int"))
    rows = t.part.select(
        F.concat("p_name", F.lit("#"), band).alias("id"),
        name.alias("name"),
        F.concat(F.lit("V-"), F.col("p_partkey") % 20).alias("plate"),
        begin.alias("start"),
        (begin + F.make_interval(mins=F.col("p_size") * 5)).alias("end"),
        F.when(F.col("p_partkey") % 200 < 2, F.floor(950000000 + F.col("p_partkey") / 2).cast("string")).alias("phone"),
        band.cast("string").alias("platform"),
    )
    pairs = identity.name_pairs(rows.select("id", "name").distinct())
    return identity.persons(pairs, rows, identity.phone_links(rows.select("id", "phone", "platform").distinct()))


@query("F06_F07_F08_keys", r"SELECT s_suppkey, upper(regexp_replace('ab-' || s_suppkey || ' x', '[\s-]', '', 'g')) AS plate, CASE WHEN length(regexp_replace('+971 50-' || (1000000 + s_suppkey), '[^0-9]', '', 'g')) >= 9 THEN right(regexp_replace('+971 50-' || (1000000 + s_suppkey), '[^0-9]', '', 'g'), 9) END AS phone, regexp_replace(lower(trim(' Optional_Ride_' || s_name)), '^optional_ride_', '') AS status FROM supplier")
def _(t):
    key = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", text.plate_key(F.concat(F.lit("ab-"), key, F.lit(" x"))).alias("plate"), text.phone_key(F.concat(F.lit("+971 50-"), key + 1000000)).alias("phone"), money.bare_status(F.concat(F.lit(" Optional_Ride_"), F.col("s_name"))).alias("status"))


@query("F09_E01_place_area", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN s_name END AS area FROM supplier")
def _(t):
    third = F.when(F.col("s_suppkey") % 3 == 0, F.lit("AB 123")).otherwise(F.col("s_name"))
    address = F.when(F.col("s_suppkey") % 3 == 2, F.concat(F.col("s_name"), F.lit(" - Dubai"))).otherwise(F.concat(F.lit("7 Road - "), third, F.lit(" - Dubai - AE")))
    return t.supplier.select("s_suppkey", text.place_area(address).alias("area"))


@query("F10_area_alias", "SELECT n_nationkey, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN 'First' WHEN n_name LIKE 'NATION_2%' THEN 'Twenties' ELSE n_name END AS area FROM nation")
def _(t):
    return t.nation.select("n_nationkey", text.canonical_area(F.col("n_name"), {"nation_1": "First", "nation_2": "First"}, {"nation_2": "Twenties"}).alias("area"))


@query("F11_F12_F13_pieces", "SELECT page_id, CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS INT) AS number, split_part(url, '/', 3) AS host, 'page ' || page_id || ' of ' || split_part(url, '/', 3) AS title FROM pages")
def _(t):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    return t.pages.select("page_id", text.captured_int(F.col("url"), "([0-9]+)").alias("number"), host.alias("host"), F.format_string("page %d of %s", "page_id", host).alias("title"))


@query("F14_F15_hashes", "SELECT doc_id, md5(doc_id || '|' || coalesce(lang, chr(0)) || '|' || coalesce(source, chr(0))) AS inputs, sha256(coalesce(text, '')) AS content FROM documents")
def _(t):
    return t.documents.select("doc_id", text.fingerprint(F.col("doc_id"), F.col("lang"), F.col("source")).alias("inputs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))


@query("F17_vocabulary", "SELECT p_partkey, CASE WHEN contains(' ' || p_name || ' ', ' widget ') THEN 'widget' WHEN contains(' ' || p_name || ' ', ' small ') THEN 'small' WHEN contains(' ' || p_name || ' ', ' ring ') THEN 'ring' WHEN contains(' ' || p_name || ' ', ' red ') THEN 'red' END AS found FROM part")
def _(t):
    return t.part.select("p_partkey", text.vocabulary_area(F.col("p_name"), ["widget", "ring", "small", "red"]).alias("found"))


@query("F18_redacted", """SELECT event_id, '{"user":' || user_id || ',"inner":{"kind":"' || event_type || '"},"seen":[{"n":' || event_id % 7 || '},{}]}' AS value, ['api_key', 'inner.password', 'seen[1].token'] AS removed FROM events""")
def _(t):
    inner = F.struct(F.lit("y").alias("password"), F.col("event_type").alias("kind"))
    payload = F.to_json(F.struct(F.col("user_id").alias("user"), F.lit("x").alias("api_key"), inner.alias("inner")))
    seen = F.concat(F.lit(',"seen":[{"n":'), F.col("event_id") % 7, F.lit('},{"token":1}]}'))
    return t.events.select("event_id", text.redacted(F.concat(F.regexp_replace(payload, r"\}$", ""), seen)).alias("r")).select("event_id", "r.value", "r.removed")


LOCAL = "(ts + INTERVAL 4 HOUR)"


@query("D01_D02_D03_D04_local", f"SELECT event_id, CAST({LOCAL} AS DATE) AS local_day, CAST(hour({LOCAL}) AS INT) AS hour, CAST(dayofweek({LOCAL}) AS INT) AS dow, CAST(date_trunc('week', {LOCAL}) AS DATE) AS week, strftime({LOCAL}, '%Y-%m') AS month, strftime({LOCAL}, '%d %b') AS label, epoch_us(ts) // 1000000 AS epoch FROM events")
def _(t):
    at = time.local(F.col("ts"))
    return t.events.select(
        "event_id", time.local_day(F.col("ts")).alias("local_day"), time.local_hour(F.col("ts")).alias("hour"), time.local_dow(F.col("ts")).alias("dow"), time.bucket("week", F.col("ts")).alias("week"),
        F.date_format(at, "yyyy-MM").alias("month"), F.date_format(at, "dd MMM").alias("label"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"),
    )


@query("D05_D08_arithmetic", "SELECT o_orderkey, CAST(date_diff('day', o_orderdate, DATE '1998-01-01') AS INT) AS days, CAST(o_orderdate AS DATE) - 7 AS week_before, CAST(o_orderdate - INTERVAL 1 YEAR AS DATE) AS year_before FROM orders")
def _(t):
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.datediff(F.to_date(F.lit("1998-01-01")), day).alias("days"), F.date_sub(day, 7).alias("week_before"), F.add_months(day, -12).alias("year_before"))


@query("D12_calendar", "SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 MONTH)) AS DATE) AS month FROM orders")
def _(t):
    bounds = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return time.calendar(bounds, "lo", "hi", "1 MONTH", "month")


@query("D13_C05_hour_slices", "WITH s AS (SELECT event_id, ts AS a, ts + to_minutes(CAST(20 + event_id % 150 AS INT)) AS b FROM events), h AS (SELECT *, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b), INTERVAL 1 HOUR)) AS hour_at FROM s), m AS (SELECT event_id, hour_at, round(CAST(least(greatest(epoch_us(least(b, hour_at + INTERVAL 1 HOUR)) - epoch_us(greatest(a, hour_at)), 0), 3600000000) AS DECIMAL(20,0)) / 60000000, 2) AS minutes FROM h) SELECT * FROM m WHERE minutes >= 0.005")
def _(t):
    spans = t.events.select("event_id", F.col("ts").alias("start"), (F.col("ts") + F.make_interval(mins=(20 + F.col("event_id") % 150).cast("int"))).alias("end"))
    return time.hour_slices(spans).select("event_id", "hour_at", "minutes")


#: The first days of the calendar's months.
HIJRI_STARTS = [
    ("2023-12-14", 1445, 6), ("2024-01-13", 1445, 7), ("2024-02-11", 1445, 8), ("2024-03-11", 1445, 9), ("2024-04-10", 1445, 10), ("2024-05-09", 1445, 11),
    ("2024-06-07", 1445, 12), ("2024-07-07", 1446, 1), ("2024-08-05", 1446, 2), ("2024-09-04", 1446, 3), ("2024-10-04", 1446, 4), ("2024-11-03", 1446, 5),
    ("2024-12-02", 1446, 6), ("2025-01-01", 1446, 7), ("2025-01-31", 1446, 8), ("2025-03-01", 1446, 9), ("2025-03-30", 1446, 10), ("2025-04-29", 1446, 11),
    ("2025-05-28", 1446, 12), ("2025-06-26", 1447, 1), ("2025-07-26", 1447, 2), ("2025-08-24", 1447, 3), ("2025-09-23", 1447, 4), ("2025-10-23", 1447, 5),
    ("2025-11-22", 1447, 6), ("2025-12-21", 1447, 7),
]


@query("D14_S12_hijri", f"WITH m AS (SELECT CAST(f AS DATE) AS f, y, m FROM (VALUES {', '.join(map(str, HIJRI_STARTS))}) v(f, y, m)), d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2025-12-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, y AS year, m AS month, CAST(day - f AS INT) + 1 AS hijri_day, m = 9 AS is_ramadan FROM d ASOF JOIN m ON day >= f")
def _(t):
    from datetime import date

    return time.calendar_days(t.spark, date(2024, 1, 1), date(2025, 12, 31))


LAT, LNG = "(25 + s_nationkey / 50.0)", "(55 + s_suppkey % 17 / 40.0)"


@query("M01_haversine", f"SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(25.2 - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(25.2)) * pow(sin(radians(55.3 - {LNG}) / 2), 2), 1.0))), 6) AS km FROM supplier")
def _(t):
    lat, lng = 25 + F.col("s_nationkey") / 50.0, 55 + F.col("s_suppkey") % 17 / 40.0
    return t.supplier.select("s_suppkey", F.round(geo.haversine_km(lat, lng, F.lit(25.2), F.lit(55.3)), 6).alias("km"))


@query("J21_J22_cells", "WITH c AS (SELECT s_suppkey, s_acctbal, CAST(round((25 + s_nationkey / 50.0) / 0.005) AS INT) AS a, CAST(round((55 + s_suppkey % 17 / 40.0) / 0.005) AS INT) AS b FROM supplier), g AS (SELECT a, b, min(s_suppkey) AS place FROM c WHERE s_acctbal > 0 GROUP BY 1, 2) SELECT s_suppkey, place FROM c LEFT JOIN g USING (a, b)")
def _(t):
    cells = t.supplier.select("s_suppkey", "s_acctbal", geo.cell((25 + F.col("s_nationkey") / 50.0)).alias("a"), geo.cell(55 + F.col("s_suppkey") % 17 / 40.0).alias("b"))
    places = cells.filter("s_acctbal > 0").groupBy("a", "b").agg(F.min("s_suppkey").alias("place"))
    return cells.join(places, ["a", "b"], "left").select("s_suppkey", "place")


@query("M03_ols", "WITH m AS (SELECT o_orderpriority AS p, CAST(date_diff('month', DATE '1995-01-01', o_orderdate) AS DOUBLE) AS x, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2) SELECT p, regr_count(y, x) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (regr_count(y, x) - 2)), 5) AS s FROM m GROUP BY 1")
def _(t):
    months = F.months_between(F.date_trunc("month", "o_orderdate"), F.lit("1995-01-01").cast("timestamp"))
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("p"), F.round(months).alias("x")).agg(F.count("*").cast("double").alias("y"))
    fit = stats.ols(rows, ["p"], "x", "y")
    return fit.select("p", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")], F.round("s", 5).alias("s"))


def _monthly(t):
    return t.orders.groupBy("o_orderpriority", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("value"))


MONTHLY_SQL = "SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS y FROM orders GROUP BY 1, 2"
T95_SQL = "[" + ", ".join(map(str, stats.T95)) + "]"


def forecast_sql(series: str, horizon: int) -> str:
    """CTEs over `whole` (series columns, month, y): out has value and what belongs to it."""
    same = " AND ".join(f"a.{c} = b.{c}" for c in series.split(", "))
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {series} ORDER BY month DESC) AS i FROM whole),
k AS (SELECT {", ".join(f"a.{c}" for c in series.split(", "))}, a.i AS take, regr_syy(b.y, b.i) AS syy, regr_sxy(b.y, b.i) AS sxy, regr_sxx(b.y, b.i) AS sxx, avg(b.y) AS mean FROM r a JOIN r b ON {same} AND b.i <= a.i GROUP BY {", ".join(f"a.{c}" for c in series.split(", "))}, a.i),
c AS (SELECT {series}, coalesce(min(take) FILTER (WHERE take > 3 AND (mean <= 0 OR sqrt(greatest(syy - sxy * sxy / sxx, 0) / (take - 2)) / mean > 0.35)) - 1, max(take)) AS n FROM k GROUP BY {series} HAVING max(take) >= 3),
u AS (SELECT r.*, c.n, date_diff('month', min(month) OVER (PARTITION BY {series}), month)::DOUBLE AS x, min(month) OVER (PARTITION BY {series}) AS base FROM r JOIN c USING ({series}) WHERE i <= n),
f AS (SELECT {series}, n, base, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_r2(y, x) AS r2, avg(x) AS mx, regr_sxx(y, x) AS sxx, CASE WHEN n > 2 THEN sqrt(greatest(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x), 0) / (n - 2)) END AS s, avg(y) FILTER (WHERE i <= 3) AS flat FROM u GROUP BY {series}, n, base),
g AS (SELECT *, unnest(range(1, {horizon + 1})) AS ahead FROM f JOIN (SELECT {series}, max(month) AS last FROM all_months GROUP BY {series}) USING ({series})),
h AS (SELECT *, CAST(last + to_months(CAST(ahead AS INT)) AS DATE) AS month, date_diff('month', base, last) + ahead AS x FROM g),
out AS (SELECT *, greatest(b0 + b1 * x, 0) AS point, coalesce({T95_SQL}[CAST(n AS INT) - 2], 1.96) * s * sqrt(1 + 1.0 / n + (x - mx) * (x - mx) / sxx) AS half FROM h)"""


@query("M04_M05_forecast", f"""WITH all_months AS ({MONTHLY_SQL}), whole AS (SELECT * FROM all_months WHERE month < (SELECT date_trunc('month', max(o_orderdate)) FROM orders)), {forecast_sql("p", 6)}
SELECT p AS o_orderpriority, month, floor(point / 100 + 0.5) * 100 AS value, greatest(floor((point - half) / 100 + 0.5) * 100, 0) AS low, floor((point + half) / 100 + 0.5) * 100 AS high, floor(flat / 100 + 0.5) * 100 AS flat, CASE WHEN ahead <= 3 THEN 'forecast' ELSE 'extrapolation' END AS kind, s IS NOT NULL AND r2 >= 0.5 AS beats_flat, n AS regime_months FROM out""")
def _(t):
    # the month that the record ends in is partial
    last = t.orders.agg(F.to_date(F.date_trunc("month", F.max("o_orderdate"))).alias("__partial"))
    months = _monthly(t).crossJoin(F.broadcast(last))  # one row
    return forecast.forecasts(months, ["o_orderpriority"], "month", "value", usable=F.col("month") < F.col("__partial"))


@query("M06_seasonal_ratio", "WITH m AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS value FROM orders GROUP BY 1, 2), j AS (SELECT a.*, a.value / nullif(b.value, 0) AS ratio FROM m a LEFT JOIN m b ON a.o_orderpriority = b.o_orderpriority AND a.month = b.month + INTERVAL 12 MONTH) SELECT o_orderpriority, month, round(ratio, 6) AS ratio, round(CASE WHEN count(ratio) OVER w = 3 THEN avg(ratio) OVER w END, 6) AS mean_ratio FROM j WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(t):
    rows = forecast.seasonal_ratio(_monthly(t), ["o_orderpriority"], "month", "value")
    return rows.select("o_orderpriority", "month", F.round("ratio", 6).alias("ratio"), F.round("mean_ratio", 6).alias("mean_ratio"))


@query("M08_back_test", f"""WITH m AS ({MONTHLY_SQL}), t AS (SELECT p, month AS cut, y AS actual FROM m QUALIFY row_number() OVER (PARTITION BY p ORDER BY month DESC) <= 6),
all_months AS (SELECT t.p, t.cut, m.month, m.y FROM t JOIN m ON m.p = t.p AND m.month < t.cut), whole AS (SELECT * FROM all_months), {forecast_sql("p, cut", 1)},
q AS (SELECT *, y / nullif(lag(y, 12) OVER w, 0) AS ratio, lag(y, 12) OVER w AS year, lag(y) OVER w AS naive FROM m WINDOW w AS (PARTITION BY p ORDER BY month)),
z AS (SELECT p, month AS cut, naive, CASE WHEN count(ratio) OVER v = 3 THEN greatest(year * avg(ratio) OVER v, 0) END AS seasonal FROM q WINDOW v AS (PARTITION BY p ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
e AS (SELECT t.p, actual, naive, seasonal, floor(point / 100 + 0.5) * 100 AS trend FROM t JOIN z USING (p, cut) LEFT JOIN out USING (p, cut)),
x AS (SELECT p, 'trend' AS model, abs(trend - actual) AS error FROM e UNION ALL SELECT p, 'seasonal', abs(seasonal - actual) FROM e UNION ALL SELECT p, 'naive', abs(naive - actual) FROM e)
SELECT p AS o_orderpriority, model, count(error) AS tests, round(avg(error), 2) AS mae FROM x GROUP BY 1, 2""")
def _(t):
    return forecast.back_test(_monthly(t), ["o_orderpriority"], "month", "value").withColumn("mae", F.round("mae", 2))


@query("M07_decompose", "WITH y AS (SELECT year(o_orderdate) AS y, count(DISTINCT o_custkey)::DOUBLE AS v, count(*)::DOUBLE AS n FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1) SELECT round(ln(b.v / a.v), 6) AS vehicles, round(ln(b.n / a.n) - ln(b.v / a.v), 6) AS intensity FROM y a, y b WHERE a.y = 1996 AND b.y = 1997")
def _(t):
    of = lambda y, c: F.when(F.year("o_orderdate") == y, F.col(c))
    row = t.orders.agg(F.countDistinct(of(1996, "o_custkey")).alias("v0"), F.count(of(1996, "o_orderkey")).alias("n0"), F.countDistinct(of(1997, "o_custkey")).alias("v1"), F.count(of(1997, "o_orderkey")).alias("n1"))
    d = stats.decompose(F.col("v0"), F.col("n0"), F.col("v1"), F.col("n1"))
    return row.select(d.alias("d")).select(F.round("d.vehicles", 6).alias("vehicles"), F.round("d.intensity", 6).alias("intensity"))


CDF = "(CASE WHEN z >= 0 THEN 1 - u ELSE u END)"


@query("M09_tests", "WITH g AS (SELECT event_type, avg(value) AS m1, stddev_samp(value) AS s1, count(*) AS n1 FROM events GROUP BY 1), o AS (SELECT g.event_type, m1, s1, n1, avg(value) AS m2, stddev_samp(value) AS s2, count(*) AS n2 FROM g JOIN events e ON e.event_type <> g.event_type GROUP BY ALL), z AS (SELECT *, abs(m1 - m2) / sqrt(s1 * s1 / n1 + s2 * s2 / n2) AS z FROM o), t AS (SELECT *, 1 / (1 + 0.2316419 * z) AS k FROM z) SELECT event_type, round(2 * (exp(-z * z / 2) / sqrt(2 * pi()) * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))), 6) AS p FROM t")
def _(t):
    # the rest of each group from the totals' moments: one aggregate, no join of events
    parts = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    w = Window.partitionBy(F.lit(1))  # one row for each event type
    rest = parts.withColumns({f"r{c}": F.sum(c).over(w) - F.col(c) for c in ("n", "s", "q")})
    sd = lambda n, s, q: F.sqrt((F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1))
    p = stats.welch_p(F.col("s") / F.col("n"), sd("n", "s", "q"), F.col("n"), F.col("rs") / F.col("rn"), sd("rn", "rs", "rq"), F.col("rn"))
    return rest.select("event_type", F.round(p, 6).alias("p"))


@query("M10_E05_adjudicate", WITH_TRIPS + ", m AS (SELECT count(*) FILTER (WHERE platform = 'machinery') AS n_in, count(*) FILTER (WHERE platform <> 'machinery') AS n_out, avg(x) FILTER (WHERE platform = 'machinery') AS a, avg(x) FILTER (WHERE platform <> 'machinery') AS b FROM (SELECT platform, CAST(outcome = 'completed' AS INT)::DOUBLE AS x FROM trip_norm WHERE outcome IS NOT NULL)) SELECT n_in, n_out, round(a - b, 6) AS effect, CASE WHEN n_in = 0 OR n_out = 0 THEN 'unsupported' WHEN n_in < 30 OR n_out < 30 THEN 'immaterial' WHEN a - b < 0 THEN 'refuted' WHEN abs(a - b) < 0.03 THEN 'immaterial' ELSE 'confirmed' END AS verdict FROM m")
def _(t):
    measured = algebra.measure(trips_ext(norm(t)), "completion", "platform", "machinery")
    return algebra.adjudicated(measured, "completion", True).select("n_in", "n_out", F.round("effect", 6).alias("effect"), "verdict")


@query("M11_wilson", "WITH g AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1), p AS (SELECT *, k / n AS p, 1.96 AS z FROM g) SELECT o_orderpriority, round((p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 6) AS low, round((p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 6) AS high FROM p")
def _(t):
    rows = t.orders.groupBy("o_orderpriority").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("k"), F.count("*").alias("n"))
    return rows.select("o_orderpriority", stats.wilson(F.col("k"), F.col("n")).alias("w")).select("o_orderpriority", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("M12_M13_surprise", "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT user_id, avg(n) AS e, stddev_samp(n) AS sd, max(n) AS m FROM d GROUP BY 1) SELECT user_id, round((m - e) / nullif(greatest(sqrt(e), sd), 0), 6) AS surprise FROM g")
def _(t):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    per = days.groupBy("user_id").agg(F.avg("n").alias("e"), F.stddev_samp("n").alias("sd"), F.max("n").alias("m"))
    return per.select("user_id", F.round(stats.surprise(F.col("m"), F.col("e"), F.col("sd")), 6).alias("surprise"))


@query("M14_M15_split", "WITH y AS (SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (WHERE year(o_orderdate) = 1996)::DOUBLE AS d0, count(*) FILTER (WHERE year(o_orderdate) = 1996)::DOUBLE AS n0, count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (WHERE year(o_orderdate) = 1997)::DOUBLE AS d1, count(*) FILTER (WHERE year(o_orderdate) = 1997)::DOUBLE AS n1 FROM orders GROUP BY 1) SELECT o_custkey, round((d1 - d0) * (n0 / d0 + n1 / d1) / 2, 6) AS days_part, round((n1 / d1 - n0 / d0) * (d0 + d1) / 2, 6) AS rate_part FROM y WHERE d0 > 0 AND d1 > 0")
def _(t):
    of = lambda y, c: F.when(F.year("o_orderdate") == y, c)
    rows = t.orders.groupBy("o_custkey").agg(
        F.countDistinct(of(1996, F.to_date("o_orderdate"))).alias("d0"), F.count(of(1996, F.lit(1))).alias("n0"), F.countDistinct(of(1997, F.to_date("o_orderdate"))).alias("d1"), F.count(of(1997, F.lit(1))).alias("n1")
    ).filter("d0 > 0 and d1 > 0")
    split = stats.split_change(F.col("d0"), F.col("n0") / F.col("d0"), F.col("d1"), F.col("n1") / F.col("d1"))
    return rows.select("o_custkey", split.alias("s")).select("o_custkey", F.round("s.days", 6).alias("days_part"), F.round("s.rate", 6).alias("rate_part"))


@query("M16_breaks", """WITH m AS (SELECT l_returnflag AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS trips, count(DISTINCT l_partkey % 60) FILTER (WHERE l_linenumber < 5 AND NOT (l_returnflag = 'R' AND month(l_shipdate) % 3 = 0)) AS drivers FROM lineitem GROUP BY 1, 2),
l AS (SELECT *, lag(trips) OVER w AS t0, lag(drivers) OVER w AS d0, lag(month) OVER w AS pm FROM m WINDOW w AS (PARTITION BY series ORDER BY month)),
c AS (SELECT *, (trips - t0) / CAST(t0 AS DOUBLE) AS change, d0 > 0 AND drivers > 0 AS comparable FROM l WHERE month = pm + INTERVAL 1 MONTH AND (trips >= 20 OR t0 >= 20)),
x AS (SELECT *, CASE WHEN comparable THEN (drivers - d0) / CAST(d0 AS DOUBLE) END AS dc, CASE WHEN comparable THEN (trips / CAST(drivers AS DOUBLE)) / (t0 / CAST(d0 AS DOUBLE)) - 1 END AS pc FROM c WHERE abs(change) >= 0.2)
SELECT series, month, round(change, 6) AS change, round(dc, 6) AS driver_change, round(pc, 6) AS productivity_change, CASE WHEN NOT comparable THEN 'unattributable' WHEN abs(pc) > 2 * abs(dc) THEN 'demand' WHEN abs(dc) > 2 * abs(pc) THEN 'supply' ELSE 'mixed' END AS cause FROM x""")
def _(t):
    known = (F.col("l_linenumber") < 5) & ~((F.col("l_returnflag") == "R") & (F.month("l_shipdate") % 3 == 0))
    months = t.lineitem.groupBy(F.col("l_returnflag").alias("series"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.count("*").alias("trips"), F.countDistinct(F.when(known, F.col("l_partkey") % 60)).alias("drivers"))
    found = forecast.breaks(months, ["series"], "month", "trips", "drivers", least_change=0.2)
    return found.select("series", "month", *[F.round(c, 6).alias(c) for c in ("change", "driver_change", "productivity_change")], "cause")


@query("M17_income_basis", "WITH g AS (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS st, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) END AS cov, count(*) FILTER (WHERE o_orderstatus = 'P') AS np, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS nf, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN st > 0 THEN CASE WHEN cov IS NULL OR cov >= 0.8 THEN 'statement' ELSE 'partial_statement' END WHEN np > 0 AND np / CAST(n AS DOUBLE) >= 0.8 THEN 'payout' WHEN np = 0 AND nf / CAST(n AS DOUBLE) >= 0.8 THEN 'fares' WHEN np > 0 THEN 'partial_payout' WHEN nf > 0 THEN 'partial_fares' ELSE 'none' END AS basis FROM g")
def _(t):
    count = lambda p: F.count(F.when(p, 1))
    rows = t.orders.groupBy("o_custkey").agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("st"), (count(F.col("o_orderstatus") == "F") / F.count("*")).alias("c"),
        count(F.col("o_orderstatus") == "P").alias("np"), count(F.col("o_orderpriority") == "1-URGENT").alias("nf"), F.count("*").alias("n"),
    )
    coverage = F.when(F.col("o_custkey") % 5 != 0, F.col("c"))
    basis = money.income_basis(F.col("st"), coverage, F.col("np"), F.col("np") / F.col("n"), F.col("np"), F.col("nf") / F.col("n"), F.col("nf"))
    return rows.select("o_custkey", basis.alias("basis"))


@query("M18_unpriced", WITH_TRIPS + ", g AS (SELECT platform, count(*) FILTER (WHERE outcome = 'completed') AS n, count(*) FILTER (WHERE outcome = 'completed' AND has_fare) AS k, CAST(sum(price) FILTER (WHERE outcome = 'completed' AND has_fare) AS DOUBLE) AS money FROM trip_norm WHERE is_booking GROUP BY 1) SELECT platform, round(greatest(money, n * money / k) - money, 2) AS unpriced FROM g WHERE k >= 0.5 * n AND n - k >= 0.1 * n")
def _(t):
    done = F.col("outcome") == "completed"
    fare = done & F.col("has_fare")
    rows = norm(t).filter("is_booking").groupBy("platform").agg(F.count(F.when(done, 1)).alias("n"), F.count(F.when(fare, 1)).alias("k"), F.sum(F.when(fare, F.col("price"))).cast("double").alias("money")).filter("k >= 0.5 * n and n - k >= 0.1 * n")
    return rows.select("platform", F.round(F.greatest("money", F.col("n") * F.col("money") / F.col("k")) - F.col("money"), 2).alias("unpriced"))


@query("M19_weekday_weights", "WITH d AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS v FROM events GROUP BY 1), w AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS week FROM d WHERE CAST(date_trunc('week', day) AS DATE) + 6 <= DATE '2024-01-29' - 2), k AS (SELECT week, avg(v) AS mean FROM w GROUP BY 1 HAVING count(*) = 7 AND min(v) >= 0.4 * avg(v)), s AS (SELECT isodow(day) - 1 AS dow, avg(v / mean) AS x, count(*) AS weeks FROM w JOIN k USING (week) GROUP BY 1) SELECT CAST(dow AS INT) AS dow, round(x / avg(x) OVER (), 4) AS weight, weeks FROM s")
def _(t):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("v"))
    return forecast.weekday_weights(days, "day", "v", F.to_date(F.lit("2024-01-29")), least=3)


@query("M20_M21_forgone", "WITH r AS (SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS rate FROM lineitem) SELECT o_orderkey, round((o_orderkey % 50) * rate, 2) AS forgone FROM orders, r WHERE o_orderstatus = 'P'")
def _(t):
    total = lambda c: F.sum(F.col(c).cast("decimal(14,2)")).cast("double")
    rate = t.lineitem.agg((total("l_extendedprice") / total("l_quantity")).alias("rate"))  # one row
    return t.orders.filter("o_orderstatus = 'P'").crossJoin(F.broadcast(rate)).select("o_orderkey", F.round((F.col("o_orderkey") % 50) * F.col("rate"), 2).alias("forgone"))


@query("X01_X02_arrays", "SELECT p_partkey, len(string_split(p_name, ' ')) AS words, list_contains(string_split(p_name, ' '), 'widget') AS has_widget, coalesce(list_position(string_split(p_name, ' '), 'ring'), 0) AS at_ring, array_to_string(list_sort(string_split(p_name, ' ')), '+') AS joined FROM part")
def _(t):
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", F.size(words).cast("bigint").alias("words"), F.array_contains(words, "widget").alias("has_widget"), F.array_position(words, "ring").alias("at_ring"), F.array_join(F.array_sort(words), "+").alias("joined"))


@query("X03_X07_json", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (WHERE try_cast(json_extract_string(props, '$.missing') AS INT) IS NULL) AS missing FROM events GROUP BY 1")
def _(t):
    field = lambda name: F.get_json_object("props", f"$.{name}")
    return t.events.groupBy("event_type").agg(F.sum(field("k").try_cast("bigint")).alias("k"), F.count(F.when(field("missing").try_cast("int").isNull(), 1)).alias("missing"))


@query("X04_X05_json_rows", "SELECT event_id, CAST(i - 1 AS INT) AS at, k * i AS v FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, unnest([1, 2, 3]) AS i FROM events)")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    made = F.to_json(F.array(k, 2 * k, 3 * k))
    return t.events.select("event_id", F.posexplode(F.from_json(made, "array<bigint>")).alias("at", "v"))


@query("X06_key_profile", "SELECT key, json_type(v) AS kind, count(*) AS n, count(DISTINCT CAST(v AS VARCHAR)) AS distinct_values FROM (SELECT unnest(json_keys(props)) AS key, json_extract(props, '$.' || unnest(json_keys(props))) AS v FROM events) GROUP BY 1, 2")
def _(t):
    pairs = t.events.select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    kind = F.when(F.col("v").rlike("^-?[0-9]+$"), F.when(F.col("v").startswith("-"), "BIGINT").otherwise("UBIGINT")).when(F.col("v").rlike("^-?[0-9.eE+-]+$"), "DOUBLE").otherwise("VARCHAR")
    return pairs.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("v").alias("distinct_values"))


@query("X08_conditional", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), l_tax) AS first_rate, greatest(l_discount, nullif(l_tax, 0)) AS high, least(l_discount, nullif(l_tax, 0)) AS low FROM lineitem")
def _(t):
    tax = F.nullif("l_tax", F.lit(0.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(F.nullif("l_discount", F.lit(0.0)), "l_tax").alias("first_rate"), F.greatest("l_discount", tax).alias("high"), F.least("l_discount", tax).alias("low"))


@query("X09_latest_for_hour", "SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, arg_max(event_type, {'a': ts, 'b': event_id}) AS latest FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))


@query("A32_summarise", "SELECT o_orderpriority, count(*) AS rows, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000 GROUP BY 1")
def _(t):
    found = algebra.summarise(t.orders, "o_orderpriority", [("count", "*"), ("sum", "o_totalprice")], [("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", ">", 100000)], sort="rows")
    return found.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("A33_compare", "WITH y AS (SELECT year(o_orderdate) AS y, count(*)::DOUBLE AS n, count(DISTINCT o_custkey)::DOUBLE AS people FROM orders GROUP BY 1), l AS (UNPIVOT y ON n, people INTO NAME figure VALUE v) SELECT a.figure, a.v AS a, b.v AS b, b.v - a.v AS change, round(100 * (b.v - a.v) / a.v, 1) AS change_pct FROM l a JOIN l b USING (figure) WHERE a.y = 1996 AND b.y = 1997")
def _(t):
    of = lambda y: t.orders.filter(F.year("o_orderdate") == y).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("people"))
    return algebra.compare(of(1996), of(1997))


@query("J24_combine", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) SELECT a.k, a.n, b.n AS n_2, b.k IS NOT NULL AS matched FROM a LEFT JOIN b ON a.k = b.k")
def _(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    b = t.customer.filter("c_acctbal > 5000").groupBy(F.col("c_custkey").alias("k")).agg(F.count("*").alias("n"))
    return algebra.combine(a, b, "k").select("k", "n", "n_2", "matched")


@query("E08_E09_scoped", WITH_TRIPS + "SELECT fleet_id, platform, count(*) AS n, CAST(NULL AS DOUBLE) AS price FROM trip_norm WHERE fleet_id IN ('ASIA', 'EUROPE') GROUP BY 1, 2")
def _(t):
    rows = algebra.scoped(norm(t), ["ASIA", "EUROPE"]).groupBy("fleet_id", "platform").agg(F.count("*").alias("n"), F.sum("price").cast("double").alias("price"))
    return algebra.withheld(rows, {"price"})
