"""Accounts as persons, with names spelled alike, addresses and a register of decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.operators import identity
from caravel.plans.registry import query

#: Accounts on six platforms: a name in order, turned round, with a word more, misspelled in
#: its first word, in both, or with its first two letters swapped.
ACCOUNT_SQL = """SELECT p_name || '#' || p_size % 6 AS id, CASE p_size % 6 WHEN 1 THEN b || ' ' || a WHEN 2 THEN p_name || ' senior' WHEN 3 THEN left(a, 2) || substr(a, 4) || ' ' || b WHEN 4 THEN a || 'e ' || b || 's' WHEN 5 THEN substr(a, 2, 1) || left(a, 1) || substr(a, 3) || ' ' || b ELSE p_name END AS name,
    CAST(p_size % 6 AS VARCHAR) AS platform, 'V-' || p_partkey % 12 AS plate, TIMESTAMP '2024-01-01' + INTERVAL 2 HOUR * CAST(p_partkey % 5000 AS INT) AS s, TIMESTAMP '2024-01-01' + INTERVAL 2 HOUR * CAST(p_partkey % 5000 AS INT) + INTERVAL 5 MINUTE * p_size AS e,
    CASE WHEN p_partkey % 160 < 2 THEN 'Driver' || p_partkey // 2 || '@Fleet.example' WHEN p_partkey % 160 < 5 THEN 'office@fleet.example' END AS email
    FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)"""
SPELLED_SQL = f"""r AS ({ACCOUNT_SQL}), w AS (SELECT DISTINCT id, unnest(string_split(lower(name), ' ')) AS word FROM r), v AS (SELECT DISTINCT word FROM w),
near AS (SELECT x.word AS p, y.word AS q FROM v x JOIN v y ON length(x.word) >= 4 AND length(y.word) >= 4 AND abs(length(x.word) - length(y.word)) <= 1 AND damerau_levenshtein(x.word, y.word) <= 1),
walk AS (SELECT word, word AS seen FROM v UNION SELECT walk.word, near.q FROM walk JOIN near ON near.p = walk.seen), cls AS (SELECT word, min(seen) AS class FROM walk GROUP BY 1),
acc AS (SELECT id, array_to_string(list_sort(list(DISTINCT class)), ' ') AS key FROM w JOIN cls USING (word) GROUP BY id HAVING count(DISTINCT class) >= 2)"""


def accounts(t):
    band, key = F.col("p_size") % 6, F.col("p_partkey")
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    piece = lambda w, i, n=100: F.substring(w, i, n)
    words = lambda *w: F.concat_ws(" ", *w)
    name = (
        F.when(band == 1, words(b, a)).when(band == 2, words("p_name", F.lit("senior"))).when(band == 3, words(F.concat(piece(a, 1, 2), piece(a, 4)), b))
        .when(band == 4, words(F.concat(a, F.lit("e")), F.concat(b, F.lit("s")))).when(band == 5, words(F.concat(piece(a, 2, 1), piece(a, 1, 1), piece(a, 3)), b)).otherwise(F.col("p_name"))
    )
    begin = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_interval(hours=(key % 5000 * 2).cast("int"))
    email = F.when(key % 160 < 2, F.concat(F.lit("Driver"), F.floor(key / 2), F.lit("@Fleet.example"))).when(key % 160 < 5, "office@fleet.example")
    return t.part.select(
        F.concat("p_name", F.lit("#"), band).alias("id"), name.alias("name"), band.cast("string").alias("platform"), F.concat(F.lit("V-"), key % 12).alias("plate"),
        begin.alias("start"), (begin + F.make_interval(mins=F.col("p_size") * 5)).alias("end"), email.alias("email"), key.alias("number"), F.col("p_name").alias("whole"),
    )


@query("J30_spelled_names", f"""WITH RECURSIVE {SPELLED_SQL}, k AS (SELECT DISTINCT key FROM acc)
SELECT a.key AS short, b.key AS long FROM k a JOIN k b ON len(string_split(a.key, ' ')) < len(string_split(b.key, ' ')) AND list_has_all(string_split(b.key, ' '), string_split(a.key, ' '))""")
def _(t):
    return identity.contained_names(identity.spelled_classes(accounts(t).select("id", "name").distinct()).select("key").distinct())


@query("C23_spelled_persons", f"""WITH RECURSIVE {SPELLED_SQL}, f AS (SELECT key, min(id) AS first FROM acc GROUP BY 1),
pairs AS (SELECT first AS x, id AS y FROM acc JOIN f USING (key) WHERE first <> id UNION SELECT a.first, b.first FROM f a JOIN f b ON len(string_split(a.key, ' ')) < len(string_split(b.key, ' ')) AND list_has_all(string_split(b.key, ' '), string_split(a.key, ' '))),
ab AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM pairs), car AS (SELECT DISTINCT a, b FROM ab JOIN r p ON p.id = a JOIN r q ON q.id = b AND q.plate = p.plate),
bad AS (SELECT DISTINCT a, b FROM ab JOIN r p ON p.id = a JOIN r q ON q.id = b AND q.plate <> p.plate AND p.s < q.e AND q.s < p.e),
em AS (SELECT min(id) AS a, max(id) AS b FROM (SELECT DISTINCT id, platform, lower(email) AS email FROM r WHERE email IS NOT NULL) GROUP BY email HAVING count(*) = 2 AND count(DISTINCT platform) = 2),
no AS (SELECT p_name || '#0' AS a, p_name || '#1' AS b FROM part WHERE p_partkey % 3 = 0), yes AS (SELECT p_name || '#2' AS a, p_name || '#5' AS b FROM part WHERE p_partkey % 41 = 0),
l AS (SELECT * FROM (SELECT * FROM car WHERE (a, b) NOT IN (SELECT (a, b) FROM bad) UNION SELECT a, b FROM em) WHERE (a, b) NOT IN (SELECT (a, b) FROM no) UNION SELECT a, b FROM yes),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), g AS (SELECT x AS node, x AS seen FROM e UNION SELECT g.node, e.y FROM g JOIN e ON e.x = g.seen)
SELECT node AS id, min(seen) AS person FROM g GROUP BY 1""")
def _(t):
    rows = accounts(t)
    pairs = identity.name_pairs(rows.select("id", "name").distinct(), spelled=True)
    said = lambda p, a, b, word: rows.filter(p).select(F.concat("whole", F.lit(a)).alias("a"), F.concat("whole", F.lit(b)).alias("b"), F.lit(word).alias("decision")).distinct()
    register = said("number % 3 = 0", "#0", "#1", "rejected").unionByName(said("number % 41 = 0", "#2", "#5", "confirmed"))
    return identity.persons(pairs, rows, identity.email_links(rows.select("id", "name", "email", "platform").distinct()), register)
