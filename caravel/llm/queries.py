"""The contract's thin queries over the corpus operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.llm import alignment, chat, decontamination, exact_dedup, html_text, licences, packing, pii, sharding, simhash, spelling, tokens, toxicity
from caravel.llm.shared import read

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    found = toxicity.toxicity(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).drop("identity")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(read(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.personal_data(read(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.prefix_counts(read(spark, sf_dir, "documents"), vocabulary(), (LIMIT,))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.col("fits")[0].alias("fits_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.phrase_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    ids = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), sha256(ids).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], stored.schema)
    examples = chat.chat_examples(stored.unionByName(extra))
    loss = examples.withColumn("reply", chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")))
    whole = F.max_by("formatted", F.struct("example")).alias("whole")  # the last example holds every turn
    replies = F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies")
    by = loss.groupBy("conv_id").agg(whole, replies, F.sum(F.length("formatted").cast("bigint")).alias("formatted_chars"))
    turns = by.withColumn("turns", chat.read_turns(F.col("whole"))).withColumn("loss", F.concat_ws("", F.transform("replies", lambda r: r["reply"])))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        sha256(F.concat_ws("", lines)).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        sha256(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_html_text, op3_exact_dedup, op4_packing, op5_sharding,
        op6_simhash, op7_pii, op8_token_counts, op9_decontamination, op10_chat,
        op11_alignment, op12_spelling, op13_licences,
    )}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def values(rows: list[tuple]) -> str:
    quoted = (", ".join("'{}'".format(x) if isinstance(x, str) else str(x) for x in row) for row in rows)
    return "VALUES " + ", ".join(f"({row})" for row in quoted)


def licence_sql() -> str:
    """The scan's own rules as relations: the templates' words, the phrases, and votes."""
    index = licences.Index(licences.TEMPLATES, licences.BASE)
    wanted = [(t, i, " ".join(p)) for t, phrases in enumerate(index.mandatory) for i, p in enumerate(phrases)]
    phrases = sorted({p for _, _, p in wanted} | {" ".join(b["words"]) for b in index.base})
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), vocabulary(word) AS ({values([(w,) for w in index.words])}),
occ AS (SELECT r, pos, word FROM (SELECT r, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d) SEMI JOIN vocabulary USING (word)),
tpl(t, word, spot) AS ({values([(t, w, at) for t, f in enumerate(index.first) for w, at in f.items()])}),
named(t, label) AS ({values(list(enumerate(index.labels)))}),
phrase(p, i, word) AS ({values([(p, i, w) for p in phrases for i, w in enumerate(p.split())])}),
base(p, label) AS ({values([(" ".join(b["words"]), b["label"]) for b in index.base])}),
wanted(t, i, p) AS ({values(wanted)}),
starts AS (SELECT r, p, pos - i AS start FROM occ JOIN phrase USING (word) GROUP BY ALL HAVING count(*) = max(len(string_split(p, ' ')))),
based AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM starts JOIN base USING (p) GROUP BY r),
freq AS (SELECT word, coalesce(n, 0) AS n FROM vocabulary LEFT JOIN (SELECT word, count(DISTINCT r) AS n FROM occ GROUP BY word) USING (word)),
weighed AS (SELECT t, word, spot, n, length(bin(CAST(((SELECT count(*) FROM d) + 1) // (n + 1) AS BIGINT))) AS weight FROM tpl JOIN freq USING (word)),
whole AS (SELECT t, sum(weight) AS whole FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n, word) AS k FROM weighed) WHERE k <= 8 GROUP BY t),
rarest AS (
  SELECT r, t, word, spot, weight FROM (SELECT *, row_number() OVER (PARTITION BY r, t ORDER BY n, word) AS k FROM (SELECT DISTINCT r, word FROM occ) JOIN weighed USING (word)) WHERE k <= 8
), phrased AS (
  SELECT r, t FROM wanted JOIN (SELECT DISTINCT r, p FROM starts) USING (p) GROUP BY r, t HAVING count(*) = (SELECT count(*) FROM wanted x WHERE x.t = wanted.t)
), votes AS (
  SELECT r, t, pos - spot AS start, sum(weight) AS agreed FROM rarest SEMI JOIN phrased USING (r, t) JOIN occ USING (r, word) GROUP BY ALL
), added AS (
  SELECT r, list(DISTINCT label) AS labels, max(agreed / whole) AS coverage FROM votes JOIN whole USING (t) JOIN named USING (t) WHERE agreed >= 0.6 * whole GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, a.labels))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(coverage, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN based b USING (r) LEFT JOIN added a USING (r)
"""


#: Queries that learn, extract, number by place or iterate have none: see tests/llm.
ORACLES = {
    "op3_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
""",
    "op9_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), bw AS (
  SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
), bn AS (
  SELECT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bn),
dn AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT dw.doc_id, dw.w, ks.k, unnest(range(1, len(dw.w) - ks.k + 2)) AS i FROM dw, ks WHERE len(dw.w) >= ks.k)
), m AS (SELECT DISTINCT dn.doc_id, dn.i, dn.k, bn.item_id FROM dn JOIN bn ON dn.k = bn.k AND dn.g = bn.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op12_spelling": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i)) AS t
), found AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), coded AS (
  SELECT run, c, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)]
    ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes FROM found
), hashed AS (
  SELECT run, c, xor(list_reduce(list_transform(bytes, lambda x: CAST(x AS BIGINT)), lambda v, x: xor(v >> 8, crc.t[(xor(v, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM coded, crc
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, {'less': -near_n, 'near': encode(near)}) AS near, max(near_n) AS near_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT y.word, f.form FROM ways y JOIN forms f ON f.word = y.at WHERE f.form IS NOT NULL
), ends AS (SELECT y.word, y.at AS root FROM ways y JOIN forms f ON f.word = y.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
""",
    "op13_licences": licence_sql(),
}
