"""What single operators promise beyond their contracts."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravel.llm import chat, decontamination, exact_dedup, html_text, pii, sharding, tokens
from caravel.llm.queries import vocabulary
from caravel.llm.shared import shared_table

SENTENCES = "Some long paragraph of an article that goes on for a while, with commas, and so on until it ends. "


def p(n: int, times: int = 2) -> str:
    return f"<p>{SENTENCES * times}P{n}.</p>"


@pytest.mark.parametrize(
    "page, marks",
    [
        ("<body><div id=top><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><div class=content><h1>Title</h1>" + p(1) + p(2) + p(3) + "</div><div class=bottom>(c) 2020 Firm</div></body>", "Title P1 P2 P3"),
        ("<body><nav><a>Home</a></nav><main><article><h1>Title</h1>" + p(1) + p(2) + p(3) + "</article><article><h1>Title</h1>" + p(4) + p(5) + "</article></main></body>", "Title P1 P2 P3 Title P4 P5"),
        ("<body><article><section id='legal-background'>" + p(1) + f"</section><p class='social-history'>{SENTENCES}P2.</p><div class='reader-comments'>" + p(8) + "</div><div class=comment-list>" + p(9) + "</div>" + p(3) + "</article></body>", "P1 P2 P3"),
        ("<body><article><header><h1>Title</h1></header><div class=body>" + p(1) + p(2) + "</div><section><h2>Comments (2)</h2><article>" + p(9) + "</article></section><ul><li><a>Home one</a></li><li><a>Home two</a></li></ul></article><aside>" + p(8) + "</aside></body>", "Title P1 P2"),
        ("<body><table><tr><td><a>Home</a><br><a>News</a><br><a>About</a></td><td>" + p(1) + p(2) + "</td></tr></table></body>", "P1 P2"),
        ("<body><div id=wrap><h1>Title</h1><div class=c1>" + p(1) + p(2) + p(3) + "</div><div class=c2>" + p(4) + p(5) + "</div><div class=links><a>Home</a><a>News</a></div></div></body>", "Title P1 P2 P3 P4 P5"),
        ("<body class='has-sidebar'><article class='post no-comments'>" + p(1) + p(2) + "</article><article class=comment>" + p(9, 6) + "</article><form>" + p(8) + "</form><div class='cookie-notice'>" + p(7) + "</div></body>", "P1 P2"),
    ],
)
def test_op2_layouts(page, marks):
    assert re.findall(r"P\d|Title|Firm|Home|News|About", html_text.main_text(page)) == marks.split()


def test_op5_links_chunks_and_cuts_fewer(spark):
    rows = shared_table(spark.createDataFrame([(i, "a" if i < 60 else f"b{i // 4}") for i in range(200)], "row long, same string"), "rows")
    links = shared_table(sharding.links_of_copies(rows, 8), "links")
    root = {r: r for r in range(200)}

    def top(r):
        while root[r] != r:
            r = root[r]
        return r

    for r in links.collect():
        root[top(r.row)] = top(r.other)
    assert len({top(r) for r in range(60)}) == 1 and len({top(r) for r in range(60, 200)}) == 35
    start = rows.select("row", F.pmod(F.xxhash64("row"), F.lit(20)).cast("int").alias("shard"))
    before, after = (sharding.cut_links(x, links).first() for x in (start, sharding.balanced_shards(rows.select("row"), links, 20)))
    assert before.links == after.links == links.count() and after.cut < 0.6 * before.cut


def test_op7_finds_planted_spans_of_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    figures = {r.generator: r for r in pii.fitted(docs)[1].collect()}
    assert set(figures) == set(pii.GENERATORS)
    assert all(r.recall >= 0.9 and r.precision >= 0.9 for r in figures.values()), figures


def test_op7_is_judged_on_shapes_that_the_trees_have_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = pii.judged_unseen(docs, folds=2, n=1500).collect()
    assert {r.generator for r in found} <= set(pii.GENERATORS) and sum(r.personal for r in found) > 20
    assert all(0 <= r.found <= r.personal and r.found + r.false == r.taken for r in found) and sum(r.found for r in found) > 0


def test_op7_base_matches_as_they_are_and_more(spark):
    texts = ["card 4111 1111 1111 1111 and order 1234567890123456", "write jane (at) host (dot) org", "host fe80::1ff:fe23:4567:890a and 12:30:45", "call (415) 555-2671 or 030/1234567", "v 1.2.3.400 and 10.0.0.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end], s.base) for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert ("card", "4111 1111 1111 1111", True) in found[0] and ("ip", "10.0.0.1", True) in found[4]
    assert [s[:2] for s in found[1]] == [("email", "jane (at) host (dot) org")]
    assert all(len(s) == 3 and not (s[2] and s[1] == "1.2.3.400") for spans in found.values() for s in spans)


def test_op8_looks_up_what_stands_between_spaces():
    """A piece that came back beside others was cut and looked up again each time."""
    from caravel.llm import tokens

    counter = tokens.PrefixCounter(vocabulary())
    seen = []
    counter.pieces = tokens.Memory(lambda piece: seen.append(piece) or counter.steps(piece), 0)
    text = "it's  one, two\n two one, ÀB it's "
    table = counter.table(text)
    assert len(table) == len(text) and seen == ["it", "'s", "one", ",", "two", "\n", "two", "àb"]
    assert table.sum() == len(counter.encoder.tokenizer.encode(text, add_special_tokens=False).ids)


def test_op8_words_of_any_length():
    import resource

    counter, rng = tokens.PrefixCounter(vocabulary()), random.Random(5)
    library = counter.encoder.tokenizer
    most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for text in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "!?=" * 60_000, "日本" * 40_000, "ab" * 100_000 + " end"):
        assert counter.table(text).sum(dtype=np.int64) == len(library.encode(text, add_special_tokens=False).ids)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - most < 600_000
    short = "".join(rng.choices("abcdxyz", k=300))
    sums = np.cumsum(counter.table(short))
    assert all(sums[i - 1] == len(library.encode(short[:i], add_special_tokens=False).ids) for i in range(1, 301))


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_op9_ids_of_any_type_and_proximity(spark, kind):
    ids = ["10", "9", None] if kind == "string" else [10, 9, None]
    items = ["one two three four", "five six seven", "eight nine"]
    benchmark = spark.createDataFrame(list(zip(ids, items)), f"item_id {kind}, text string")
    docs = spark.createDataFrame([(1, "x one two three four y five six seven"), (2, "one two and three four"), (3, "nine eight")], "doc_id long, text string")
    exact = {r.doc_id: (r.item_ids, r.spans) for r in decontamination.phrase_matches(docs, benchmark).collect()}
    assert exact == {1: (sorted(ids[:2]), [[1, 5], [6, 9]]), 2: ([], []), 3: ([], [])}
    near = {r.doc_id: r.item_ids for r in decontamination.phrase_matches(docs, benchmark, slop=1).collect()}
    assert near == {1: sorted(ids[:2]), 2: [ids[0]], 3: [None]}
    parts = {r.doc_id: r.item_ids for r in decontamination.phrase_matches(docs, benchmark, slop=1, part_words=1).collect()}
    assert parts == near


@pytest.mark.parametrize("block_turns", [64, 4])
def test_op10_reads_back_any_roles_texts_and_lengths(spark, block_turns):
    rng, bits = random.Random(3), ["a|>\nb", "<|end|>", "<|", "|>", "\\", "<", "|", ">", "\n", "[INST]", "</s>", "x", "<\\|", "assistant"]
    rows = []
    for c in (1, 2, None, 5):
        for turn in range(30 if c != 5 else 3):
            role = rng.choice(["assistant", "user", "".join(rng.choices(bits, k=3))])
            rows.append((c, turn if rng.random() < 0.9 else None, role, None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randrange(6)))))
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        turns[c].append((turn is not None, turn or 0, role, text or ""))
    expected = {}
    for c, own in turns.items():
        own.sort()
        ends = [i for i, x in enumerate(own) if x[2] == "assistant"]
        for n, i in enumerate([*ends, *([len(own) - 1] if not ends or ends[-1] < len(own) - 1 else [])]):
            expected[c, n] = ([x[2:] for x in own[: i + 1]], own[i][3] if i in ends else None)
    examples = chat.chat_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block_turns=block_turns)
    read = examples.select("conv_id", "example", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    assert {(r.conv_id, r.example): ([tuple(x) for x in r.turns], r.reply) for r in read.collect()} == expected


def test_components_after_more_links_are_those_of_all_links(spark):
    from caravel.llm.near_copies import joined_roots
    from caravel.llm.simhash import components

    rng = random.Random(1)
    first, more = ([tuple(sorted(rng.sample(range(200), 2))) for _ in range(60)] for _ in range(2))
    edges = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    found, expected = ({r.node: r.root for r in x.collect()} for x in (joined_roots(components(edges(first)), edges(more)), components(edges(first + more))))
    assert all(found.get(i, i) == expected.get(i, i) for i in range(200))


def test_op9_proximity_does_not_depend_on_the_other_documents_of_a_block(spark):
    random = np.random.default_rng(7)
    texts = [" ".join(random.choice(list("abcdx"), random.integers(0, 12))) for _ in range(120)] + ["b a c", "a a a b b b", "c c c b b b"]
    items = ["a b c", "c b a d", "x x", "d", "b d c a x"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for slop in (0, 1, 2):
        expected = {}
        for i, text in enumerate(texts):
            words = text.split()
            near = lambda w, at: any(words[j] == w for j in range(max(0, at - slop), min(len(words), at + slop + 1)))  # noqa: B023, E731
            expected[i] = [k for k, item in enumerate(items) if any(all(near(w, s + j) for j, w in enumerate(item.split())) for s in range(len(words)))]
        for parts in (1, 12):
            docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
            assert {r.doc_id: list(r.item_ids) for r in decontamination.phrase_matches(docs, benchmark, slop=slop).collect()} == expected


def test_op3_tells_blocks_apart_whose_keys_are_the_same(spark):
    random = np.random.default_rng(3)
    texts = ["".join(random.choice(list("ab c"), random.integers(0, 90))) for _ in range(400)] + ["same text " * 20] * 9
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    norm = [re.sub(" +", " ", t) for t in texts]
    for bits in (1, 8):
        found = {r.doc_id: r.identity for r in exact_dedup.exact_identities(docs, block=16, key_bits=bits).collect()}
        assert len(found) == len(texts) and len(set(found.values())) == len(set(norm))
        assert len({(found[i], n) for i, n in enumerate(norm)}) == len(set(norm))


def test_op2_hostile_pages_take_time_in_proportion():
    import time

    n = 20_000
    shapes = ["<b>" * n + "</i>" * n, "<b>" * n + "<li></li>" * n, "<table><td>" + "<i>" * n + "</b>" * n, "<p><div>" + "<b>" * n + "<hr>" * n, "<b><p>" * n, "<ul><li><b>" * n]
    for page in shapes:
        began = time.process_time()
        html_text.parse(page)
        assert time.process_time() - began < 8


def test_op2_ends_of_inline_elements_reach_no_further_than_their_cell():
    def tree(node):
        return [c if isinstance(c, str) else (c.tag, tree(c)) for c in node.children]

    assert tree(html_text.parse("<b><table><td></b>in</td></table></b>out")) == [("b", [("table", [("td", ["in"])])]), "out"]
    assert tree(html_text.parse("<p>a<b>b<p>c</b>d")) == [("p", ["a", ("b", ["b"])]), ("p", ["cd"])] or tree(html_text.parse("<p>a<b>b<p>c</b>d")) == [("p", ["a", ("b", ["b"])]), ("p", ["c", "d"])]
    assert tree(html_text.parse("<ul><li>a<ul><li>b</ul><li>c</ul>")) == [("ul", [("li", ["a", ("ul", [("li", ["b"])])]), ("li", ["c"])])]
