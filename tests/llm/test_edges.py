"""Every operator on nulls, empty and very long texts, repeated rows, ties, clashing extra
columns of types that have no order, and tables without rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caravel.llm import chat, decontamination, exact_dedup, html_text, near_copies, packing, pii, sharding, simhash, tokens, toxicity
from caravel.llm.queries import vocabulary

LONG = "lang " * 30_000 + "x" * 5_000
ROWS = [(1, "a  b\tc"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (None, None), (3, None), (4, ""), (5, LONG), (6, LONG), (7, "mail me: a.b@c.org or +1 (696) 555-2293"), (8, "é 日本 ​ \U0001f600")]
#: Names that operators use for columns of their own.
CLASHING = ["row", "identity", "size", "shard", "slot", "fp", "same", "kept", "part", "n_ids", "score", "spans", "start", "end", "component", "key", "rank", "stays", "text_sha256", "item_ids", "n_words"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string")
    return plain.select("*", *[F.lit("x").alias(c) for c in CLASHING], F.create_map(F.lit("k"), F.lit(1)).alias("m"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def texts():
    return [(d, t or "") for d, t in ROWS]


def in_order(rows):
    return sorted(map(repr, rows))


def test_op1(spark, docs, none):
    bad = [(d, "this is vile rubbish and more of it " * 8 + f"number {d}") for d in range(100, 140)]
    good = [(d, f"this is a plain sentence about item {d} " * 8) for d in range(140, 180)]
    train = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 140)) for d, _ in bad + good] + [(100, 0), (None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.fit(train, labels)
    found = toxicity.toxicity(docs, model).collect()
    assert in_order(r.doc_id for r in found) == in_order(d for d, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.score == r.score for r in found)
    assert toxicity.toxicity(none, model).count() == 0
    kept = toxicity.without_toxic(docs, model, 0.7)
    assert kept.dtypes == docs.dtypes and in_order(r.doc_id for r in kept.collect()) == in_order(r.doc_id for r in found if r.score < 0.7)
    assert toxicity.without_toxic(none, model, 0.7).count() == 0
    scored = {r.doc_id: r.score for r in toxicity.toxicity(train, model).collect()}
    assert min(scored[d] for d in range(100, 140)) > 0.7 > max(scored[d] for d in range(140, 180))


def test_op1_without_both_labels(spark, docs, none):
    for labels in ([], [(1, 1)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.score for r in toxicity.toxicity(docs, model).collect()} == {1.0 if labels else 0.0}
    assert toxicity.fit(none, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).chain is None


def test_op2(spark):
    page = "<body><article><p>One.<p>Two &amp; three.</article></body>"
    deep = "<div>" * 4000 + "deep" + "</div>" * 4000
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "u", ""), (3, "u", deep), (4, "u", "<nav>menu</nav>"), (5, "u", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    found = html_text.extracted(pages).collect()
    by = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and by[1] == "One.\n\nTwo & three." and by[None] == by[2] == by[4] == "" and by[3] == "deep" and len(by[5]) == 499_999
    assert all(r.n_chars == len(r.text) for r in found) and html_text.extracted(pages.limit(0)).count() == 0


def test_op3(docs, none):
    found = exact_dedup.exact_dedup(docs, block=64).collect()
    norm = {t: t if t == LONG else t.replace("  ", " ").replace("\t", " ") for _, t in texts()}
    groups = defaultdict(list)
    for d, t in texts():
        groups[norm[t]].append(d)
    expected = []
    for t, ids in groups.items():
        known = [d for d in ids if d is not None]
        expected += [(d, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    assert in_order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == in_order(expected)
    assert sum(r.kept for r in found) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs, block=64)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert in_order((r.doc_id, r.text or "", r.row, r.m) for r in kept.collect()) == in_order([(1, "a  b\tc", "x", {"k": 1}), (3, "", "x", {"k": 1}), (5, LONG, "x", {"k": 1}), *[(d, t, "x", {"k": 1}) for d, t in ROWS[9:]]])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_op4(docs, none):
    pieces = packing.packed(docs, vocabulary(), seq_len=512).collect()
    by = defaultdict(int)
    for r in pieces:
        by[r.doc_id] += r.length
    counts = [(d, len(tokens.encoder(vocabulary()).ids(t)) // 2 + 1) for d, t in texts()]
    assert dict(by) == {d: sum(n for e, n in counts if e == d) for d, _ in counts}
    places = sorted((r.sequence_id * 512 + r.offset, r.length) for r in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
    assert packing.packed(none, vocabulary()).count() == 0


def test_op5(docs, none):
    found = sharding.sharded(docs, shards=4).collect()
    assert in_order((r.doc_id, r["size"], r.text_crc32) for r in found) == in_order((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in texts())
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [2, 3, 3, 3] and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.sharded(none).count() == 0


def test_op6(docs, none):
    found = simhash.near_duplicates(docs).collect()
    by = defaultdict(set)
    for r in found:
        by[r.fp].add(r.component_id)
    assert len(found) == len(ROWS) and all(len(c) == 1 for c in by.values())
    assert {r.component_id for r in found if r.doc_id in (3, 4)} == {3} and {r.component_id for r in found if r.doc_id in (5, 6)} == {5}
    assert simhash.near_duplicates(none).count() == 0
    kept = near_copies.drop_near_copies(docs)
    assert kept.dtypes == docs.dtypes and in_order(r.doc_id for r in kept.collect()) == in_order([1, 3, 5, 7, 8])
    assert near_copies.drop_near_copies(none).count() == 0


def test_op7(docs, none):
    found = pii.digests(pii.personal_data(docs)).collect()
    assert in_order(r.doc_id for r in found) == in_order(d for d, _ in ROWS)
    spans = {r.doc_id: r.spans for r in found}
    assert spans[7] == "email:9:18,phone:22:39" and spans[5] == spans[4] == spans[3] == ""
    assert pii.personal_data(none).count() == 0


def test_op8(docs, none):
    found = tokens.prefix_counts(docs, vocabulary(), (3, 10**9), keep_table=True).collect()
    library = tokens.library(vocabulary())
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert in_order((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == in_order((d, len(t.encode()), count(t)) for d, t in texts())
    assert tokens.prefix_counts(none, vocabulary()).count() == 0


def test_op9(spark, docs, none):
    benchmark = spark.createDataFrame([(1, "A b, c!"), (1, "a b c"), (2, None), (3, ""), (None, "日本")], "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("n_words", F.lit(0))
    found = {(r.doc_id, r.n_words, tuple(r.item_ids), str(r.spans)) for r in decontamination.phrase_matches(docs, benchmark).collect()}
    assert {(1, 3, (1,), "[[0, 3]]"), (None, 3, (1,), "[[0, 3]]"), (3, 0, (), "[]"), (4, 0, (), "[]")} <= found
    assert [x[2] for x in found if x[0] == 8] == [(None,)]
    assert decontamination.phrase_matches(none, benchmark).count() == 0
    assert {r.n_words for r in decontamination.phrase_matches(docs, benchmark.limit(0)).collect() if r.item_ids} == set()
    clean = decontamination.without_contaminated(docs, benchmark)
    assert clean.dtypes == docs.dtypes and in_order(r.doc_id for r in clean.collect()) == in_order([None, 3, 4, 5, 6])
    assert decontamination.without_contaminated(none, benchmark).count() == 0


def test_op10(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, None, None, None), (2, 5, "assistant", LONG), (3, 0, "user", "")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9)).withColumn("block", F.lit("x"))
    found = chat.chat_examples(conversations)
    read = found.select("conv_id", "example", F.size(chat.read_turns(F.col("formatted"))).alias("n"), chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    expected = [(1, 0, 2, "x"), (1, 1, 3, "x"), (None, 0, 1, None), (2, 0, 1, LONG), (3, 0, 1, None)]
    assert in_order(map(tuple, read.collect())) == in_order(expected)
    assert chat.chat_examples(conversations.limit(0)).count() == 0


def test_pipeline_on_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
