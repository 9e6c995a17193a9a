"""op11, op12 and op13 against plain, single-machine versions, and on edges."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from caravel.llm import alignment, licences, spelling
from caravel.llm import queries as corpus

SF = "/root/testdata/sf0.001"
PATHS = (corpus.vocabulary("byte_bpe_50k.json"), corpus.vocabulary("piece_bpe_32k.model"))
LONG = "lang " * 30_000 + "x" * 5_000
TEXTS = [
    (1, "a  b\tc"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (None, None), (3, None), (4, ""), (5, LONG), (6, LONG), (8, "é 日本 ​ \U0001f600"),
    (9, " "), (10, "  lead and trail  "), (11, "\n\n x\n"), (12, "marked ▁ text"), (13, "don't  we'll\t\t go\r\n "), (14, "<|endoftext|> </s> <s>"), (15, "nul \x00 soft ­"),
    (16, "a\n b \n c"), (17, "x" * 3000 + " " * 500 + "y"), (18, "ªº ²³ ¼½ x² ŉ ﬁ ſ"), (19, "\x1c\x1d a\x0b\x0c"),
]


def clashing(df):
    names = ["block", "pair", "n", "place", "word", "form", "row", "seen", "words", "at", "n_words", "labels", "mask", "key"]
    return df.select("*", *[F.lit("x").alias(c) for c in names], F.create_map(F.lit("k"), F.lit(1)).alias("m"))


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(TEXTS, "doc_id long, text string"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", ["op12_spelling", "op13_licences"])
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    found = corpus.queries()[name](spark, SF)
    result = duck.execute(corpus.oracle_sql()[name])
    assert [c[0] for c in result.description] == found.columns
    rows = found.collect()
    assert len(rows) > 100 and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, result.fetchall()))


def plain_tokens(text: str):
    """(ids, ends) of A and B, or None if the text has no tokens."""
    first, second = alignment.byte_level(PATHS[0]), alignment.sentence_piece(PATHS[1])
    sides = []
    for v, ids in ((first, first.library.encode(" " + text, add_special_tokens=False).ids), (second, second.library.encode(text))):
        pieces = [v.bytes[v.start[i] : v.start[i] + v.length[i]].tobytes() for i in ids]
        if not text or b"".join(pieces) != (" " + text).encode():
            return None
        ends, at = [], 0
        for p in pieces:
            at += len(p)
            ends.append(at)
        sides.append((ids, ends))
    return sides


def plain_alignment(rows):
    counts, per_row = Counter(), []
    for doc, text in rows:
        sides = plain_tokens(text or "")
        if sides is None:
            per_row.append((doc, 0, 0, 0, [], ""))
            continue
        (a, ends_a), (b, ends_b) = sides
        groups, links = [], []
        for cut in sorted(set(ends_a) & set(ends_b)):
            low = groups[-1][0] if groups else 0
            own = [",".join(str(i) for i, e in zip(ids, ends) if low < e <= cut) for ids, ends in sides] if len(a) < 2000 else ["", ""]
            groups.append((cut, "|".join(own)))
        begin_a, begin_b = [0, *ends_a], [0, *ends_b]
        i = j = 0
        while i < len(a) and j < len(b):  # the next stretch between two ends of any side
            assert begin_a[i] < ends_b[j] and begin_b[j] < ends_a[i]
            links.append((a[i], b[j]))
            i, j = i + (ends_a[i] <= ends_b[j]), j + (ends_b[j] <= ends_a[i])
        counts.update(links)
        text = ";".join(g for _, g in groups)
        per_row.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if len(a) < 2000 else None))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(d, na, nb, g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), s) for d, na, nb, g, ls, s in per_row], counts


def same(found, expected):
    key = lambda r: repr(tuple(r)[:-1])
    found, expected = sorted(map(tuple, found), key=key), sorted(expected, key=key)
    assert [r[:-1] for r in found] == [r[:-1] for r in expected]
    assert all(e[-1] in (None, f[-1]) for f, e in zip(found, expected))


@pytest.mark.parametrize("block_bytes", [1, 300, 8_000_000])
def test_op11_on_odd_texts_in_blocks_of_any_size(docs, block_bytes):
    expected, counts = plain_alignment(TEXTS)
    same(alignment.aligned(docs, *PATHS, block_bytes=block_bytes).collect(), expected)
    if block_bytes == 300:
        assert {(r.a, r.b): r.n for r in alignment.linked_pairs(docs, *PATHS, block_bytes).collect()} == counts
        groups = alignment.alignments(docs, *PATHS, block_bytes).collect()
        short = {e[-1] for e in expected} - {None}
        assert short - {""} <= {hashlib.sha256(r.groups.encode()).hexdigest() for r in groups} and len(groups) == len(TEXTS)


def test_op11_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(corpus.queries()["op11_alignment"](spark, SF).collect(), plain_alignment(rows)[0])


def test_op11_on_no_rows(docs):
    assert alignment.aligned(docs.limit(0), *PATHS).count() == 0 and alignment.alignments(docs.limit(0), *PATHS).count() == 0
    blank = docs.filter("text is null or text = ''").collect()
    assert len(blank) == 3


def plain_spelling(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    out, form = [], {}
    around = {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


def test_op12_against_all_pairs(spark):
    base = ["letter", "straße", "naïveté", "aaaaaa", "committee", "abcde", "÷×÷×÷", "ÀÉÎÕÜ"]
    words = set(base)
    for w in base:
        words |= {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "aezé"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "tñ"}
    rows = []
    for i, w in enumerate(sorted(words)):
        rows += [(i, f"{w} {w.upper() if w.isascii() else w}. 1{w}_{w}")] * (1 + i % 4)
    rows += [(10_000 + i, "letter " * 2**k) for i, k in enumerate((5, 8))] + [(20_000 + i, "lettor " * 40 + "lettorz " * 9) for i in range(1)]
    rows += [(None, "letter letter letters letters letters"), (None, None), (3, ""), (30_000, "w" * 100_000), (30_001, "w" * 99_999 + " " + "w" * 100_000)] + [(40_000 + i, "word number five") for i in range(300)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = spelling.spelling_variants(docs).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_spelling(rows)))
    assert any(r.root != r.form and r.form for r in found) and max(r.n_near for r in found) > 20
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_op12_counts_alike_when_tasks_hand_on_early(spark, monkeypatch):
    rows = [(i, f"alpha{'bcd'[i % 3]} gammas deltas") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, spelling.word_counts(docs).collect()))
    monkeypatch.setattr(spelling, "HELD_WORDS", 1)
    assert sorted(map(tuple, spelling.word_counts(docs).collect())) == whole


def test_op12_sends_no_table_through_the_driver(spark, monkeypatch):
    rows = [(i, f"letter lettor lettr lett{'aeiou'[i % 5]}rs lettering") for i in range(60)]
    plans, write = [], spelling.shared_table

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(spelling, "shared_table", noted)
    found = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain_spelling(rows)))


def test_op12_masks_differ_in_two_bits_at_most():
    for word in ("letter", "ÿàé÷×ß", "zzzzz"):
        for other in [word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in spelling.BITS] + [word[:i] + c + word[i:] for i in range(7) for c in spelling.BITS]:
            assert (spelling.parity_mask(word) ^ spelling.parity_mask(other)).bit_count() <= 2


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licences.BASE.items() for q in [p.split()] for i in range(len(words)) if words[i : i + len(q)] == q]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_op13_base_places_and_whole_notices(spark):
    mit, bsd = (next(t.text for t in licences.TEMPLATES if t.label == x and len(t.text) > 60) for x in ("mit", "bsd"))
    filler = "the of and to in a is that for on with as by this are be or at from an not it which was has".split()
    prose = " ".join(filler[(i * i) % len(filler)] for i in range(900))
    rows = [
        (1, "MIT License, mit-license; the MIT\nlicense MIT"), (2, f"{prose} // {mit.replace(' ', ' * ')}\n{prose}"), (3, f"{prose} {bsd} {prose} Apache License"), (3, f"{prose} {bsd} {prose} Apache License"),
        (4, "K general public licenSe GENERAL PUBLIC LICENSE generalpublic license"), (5, "permission is hereby granted free of charge " + prose), (6, "Licensed under CC BY-NC 4.0."), (7, "by cc nc 4.0 licensed under"),
        (8, None), (None, None), (None, ""), (9, "mit license " * 20_000), (10, bsd.replace("binary", "other")), (11, "mit license mitİlicense Key mit licenseé"), (12, prose),
    ]
    rows += [(100 + i, prose[i:]) for i in range(40)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = licences.licence_scan(docs).collect()
    in_order = lambda rows: sorted(map(repr, rows))
    assert in_order((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found) == in_order((d, *plain_base(t)) for d, t in rows)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)
    labels = {r.doc_id: r.labels for r in found}
    assert (labels[2], labels[3], labels[6], labels[1], labels[4]) == ("mit", "apache,bsd", "cc-by-nc", "mit", "gpl")
    assert {labels[i] for i in (5, 7, 8, 10, 11, 12, None, *range(100, 140))} == {""}
    assert {r.score for r in found if not r.labels} == {0.0} and all(r.score > 0.6 for r in found if r.labels)
    assert licences.licence_scan(docs.limit(0)).count() == 0


def test_op11_texts_with_white_space_at_their_edges_do_not_touch_others(spark):
    rows = [(i, t) for i, t in enumerate(["one two  ", "next one", "  two three", "one\n", "\t two", "three  ", "two  three   "] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(alignment.aligned(docs, *PATHS).collect(), plain_alignment(rows)[0])
