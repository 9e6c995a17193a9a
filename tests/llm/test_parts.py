"""Branches that the given tables are too small to reach."""

from __future__ import annotations

from caravel.llm import decontamination, toxicity


def test_op1_fits_on_whole_documents_above_its_bound(spark):
    texts = {d: " ".join(f"слово{(d * 7 + i) % 97} word{(d + i) % 89}" for i in range(400)) + (" мерзкий" if d % 2 else "") for d in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in texts], "doc_id long, toxic int")
    bound = sum(map(len, texts.values())) // 2
    rows, rate = toxicity.sampled(docs, labels, None, 6000, bound)
    chosen = {r.text: r.toxic for r in rows.collect()}
    assert rate == 0.5 and all(texts[d] not in chosen or chosen[texts[d]] == (d % 2 == 1) for d in texts) and set(chosen) <= set(texts.values())
    assert 0.6 * bound < sum(map(len, chosen)) < 1.4 * bound
    model = toxicity.fit(docs, labels, fit_chars=bound)
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert len(scores) == 80 and all(0 <= s <= 1 for s in scores.values())


def test_op9_merges_the_parts_of_a_test_set_by_row(spark):
    item = lambda i: " ".join(f"i{i}w{k}" for k in range(14))
    benchmark = spark.createDataFrame([*((i, item(i)) for i in range(12)), (None, item(99)), (50, item(3))], "item_id long, text string")
    rows = [
        (1, f"start {item(0)} {item(1)} middle {item(2)} {item(3)} end"),
        (1, f"{item(99)} of no id"),
        (None, f"both {item(99)} {item(7)}"),
        (None, "nothing of these"),
        (2, None),
        (2, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = decontamination.phrase_matches(docs, benchmark)
    parts = decontamination.phrase_matches(docs, benchmark, part_words=3)
    assert decontamination.n_parts(benchmark, 3) > 10 and parts.columns == whole.columns
    expected = [
        (1, 59, [0, 1, 2, 3, 50], [[1, 29], [30, 58]]),
        (1, 17, [None], [[0, 14]]),
        (None, 29, [7, None], [[1, 29]]),
        (None, 3, [], []),
        (2, 0, [], []),
        (2, 0, [], []),
    ]
    for found in (whole, parts):
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
