"""The corpus pipeline's stages against plain, single-machine versions of their contracts."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from caravel.llm import decontamination, near_copies

WORDS = [a + b + c for a in "bdfgklmnprst" for b in ("a", "e", "io", "u") for c in ("n", "r", "st", "lm")]


def prose(seed: int, n: int) -> list[str]:
    return random.Random(seed).choices(WORDS, k=n)


def shingle_set(text: str) -> set[tuple[str, ...]]:
    words = text.encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def alike(a: str, b: str) -> float:
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_copies_of_four_fifths_go_and_others_stay(spark):
    texts = []
    for i in range(60):
        words = prose(i, 120 + 7 * i)
        near, far = words.copy(), words.copy()
        for at in range(10, len(words) - 10, 70):
            near[at] = f"edited{at}"
        for at in range(10, len(words) - 10, 20):
            far[at] = f"changed{at}"
        texts += [" ".join(x) for x in (words, near, far)]
    schema = "doc_id long, text string"
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), schema), "")
    for i in range(60):
        assert alike(texts[3 * i], texts[3 * i + 1]) >= 0.8 > alike(texts[3 * i], texts[3 * i + 2])
    assert {r.doc_id for r in kept.collect()} == {i for i in range(180) if i % 3 != 1}


def test_near_copy_stage_leaves_no_pair_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 4 * max(len(x), len(y)) <= 5 * min(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({top(d) for d in sets})


def test_near_copies_miss_no_link_in_large_buckets(spark):
    """Copies of one text with four words changed in each: most are below 0.8, and all of
    them meet in the same buckets.
    """
    random_, base, texts = random.Random(5), prose(5, 200), []
    for _ in range(500):
        words = base.copy()
        for _ in range(4):
            words[random_.randrange(200)] = f"edit{random_.randrange(10**9)}"
        texts.append(" ".join(words))
    texts += [" ".join(prose(900 + i, 3)) for i in range(5)] * 2
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    links = 0
    for a, b in combinations(range(len(texts)), 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            links += 1
            low, high = sorted((top(a), top(b)))
            root[high] = low
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_copies.near_copies(docs, block=64).collect()
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r.doc_id)
    expected = {}
    for d in range(len(texts)):
        expected.setdefault(top(d), []).append(d)
    assert links > 5 and sorted(map(sorted, by.values())) == sorted(map(sorted, expected.values()))


def test_near_copies_meet_in_balls_without_a_band(spark, monkeypatch):
    """Sets that share no band still meet if their SimHashes differ in two bits or fewer;
    at more, and where they meet but are not alike, they stay apart.
    """
    monkeypatch.setattr(near_copies, "bands_of", lambda hashes, seed: np.arange(near_copies.BANDS) + hashes[:1].view(np.int64) + len(hashes))
    texts = [" ".join(prose(40 + i // 2, 3000)) for i in range(40)]
    texts = [t if i % 2 == 0 else f"{t} one{i}" + " more" * (i % 3) for i, t in enumerate(texts)]
    prints = [near_copies.simhash_of(near_copies.shingles(t)) & (2**64 - 1) for t in texts]
    bits = [(prints[i] ^ prints[i + 1]).bit_count() for i in range(0, 40, 2)]
    found = {r.doc_id: r.component for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(n <= 2 for n in bits) > 10
    assert all(found[2 * i] == found[2 * i + 1] for i, n in enumerate(bits) if n <= 2)
    assert len(set(found.values())) == 40 - sum(n <= 2 for n in bits)

    schema = "node long, fp long"
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 0b11), (4, 0b1110001), (5, -1)], schema)
    pairs = {(r.node, r.other) for r in near_copies.in_balls(nodes, 2).collect()}
    assert {tuple(sorted(p)) for p in pairs} == {(1, 2), (1, 3)}


def test_packed_sets_are_read_back():
    for text in ("", "one", "a b c d e f g", " ".join(prose(3, 5000))):
        hashes = near_copies.shingles(text)
        assert list(near_copies.unpacked(near_copies.packed(hashes))) == sorted(set((hashes >> np.uint64(24)).tolist()))


def test_pipeline_runs_whole(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    found = corpus_pipeline.run(spark, sf).collect()
    assert found and {r.doc_id for r in found} <= ids
    for d in {r.doc_id for r in found}:
        own = sorted((r.start, r.length, r.doc_tokens) for r in found if r.doc_id == d)
        assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))]
        assert sum(n for _, n, _ in own) == own[0][2]


def test_stages_decide_by_row_where_ids_are_null_or_repeated(spark):
    a, b, c, d = (" ".join(prose(1000 + i, 150)) for i in range(4))
    copy = a.split()
    copy[75] = "edited"
    rows = [(None, b, "x"), (None, c, "x"), (5, a, "x"), (5, d, "x"), (9, " ".join(copy), "x"), (7, d, "x"), (5, a, "y"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    expected = [(None, b, "x"), (None, c, "x"), (5, a, "x"), (5, d, "x"), (None, None, "x")]
    assert kept.columns == docs.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, expected))

    leak = " ".join(a.split()[40:60])
    benchmark = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(None, f"before {leak} after", "x"), (None, b, "x"), (5, a, "x"), (5, d, "x"), (5, d, "x"), (6, None, "x")]
    docs = spark.createDataFrame(rows, docs.schema)
    clean = decontamination.without_contaminated(docs, benchmark)
    expected = [(None, b, "x"), (5, d, "x"), (5, d, "x"), (6, None, "x")]
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(map(repr, expected))
