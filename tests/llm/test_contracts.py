"""Each registered query against a plain, single-machine version of its contract."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from caravel.llm import queries as corpus

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows(spark, name):
    return corpus.queries()[name](spark, SF).collect()


def test_op1_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in corpus.queries()["op1_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(found) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    held = [(found[d].score, t) for d, t in labels.items() if found[d].held_out]
    ones, zeros = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > 0.94, auc
    assert np.mean([s >= 0.7 for s in ones]) > 0.85 and np.mean([s >= 0.7 for s in zeros]) < 0.005


def test_op3_keeps_the_smallest_of_equal_texts(spark, documents):
    groups = defaultdict(list)
    for d, text in documents.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text)].append(d)
    expected = {d: (min(g), len(g), d == min(g), sha(norm)) for norm, g in groups.items() for d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows(spark, "op3_exact_dedup")} == expected


def test_op4_cuts_every_id_once(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus.vocabulary())
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op4_packing"):
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for d, text in documents.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(places) == list(range(len(places)))
    for s, own in places.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 4096 or s == len(places) - 1 and at < 4096


def test_op5_sizes_and_slots(spark, documents):
    found = rows(spark, "op5_sharding")
    shards = defaultdict(list)
    for r in found:
        raw = documents[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r.slot)
    assert len(found) == len(documents) and sorted(shards) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    groups = defaultdict(list)
    for r in found:
        groups[documents[r.doc_id]].append(r.shard)
    linked = [g for g in groups.values() if len(g) > 1]
    assert np.mean([len(set(g)) == 1 for g in linked if len(g) <= 40]) > 0.95


def plain_fingerprint(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6_components(spark, documents):
    prints = {d: plain_fingerprint(t) for d, t in documents.items()}
    root = {d: d for d in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    values = np.array([prints[d] for d in ids], np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2):
            a, b = sorted((top(d), top(ids[i + 1 + j])))
            root[b] = a
    expected = {d: (f"{prints[d]:016x}", top(d)) for d in ids}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op6_simhash")} == expected


def base_spans(text: str) -> list[tuple[str, int, int]]:
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_op7_base_spans_stay(spark, documents):
    for r in rows(spark, "op7_pii"):
        base = base_spans(documents[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)), r
        counts = [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        order = [("email", "ip", "card", "phone").index(s.split(":")[0]) * 10**9 + int(s.split(":")[1]) for s in spans]
        assert order == sorted(order)


def test_op8_counts_as_the_library(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus.vocabulary())
    for r in rows(spark, "op8_token_counts"):
        n = len(tokenizer.encode(documents[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(documents[r.doc_id].encode()), n, n > 2048)
        if n > 2048:
            text = documents[r.doc_id]
            assert len(tokenizer.encode(text[: r.fits_chars], add_special_tokens=False).ids) <= 2048
            assert len(tokenizer.encode(text[: r.fits_chars + 1], add_special_tokens=False).ids) > 2048


def test_op9_windows(spark, documents):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))

    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text or "")
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(r.item_id)
    widths = {len(w) for w in windows}
    for r in rows(spark, "op9_decontamination"):
        w = words(documents[r.doc_id])
        hit, items = set(), set()
        for k in widths:
            for i in range(len(w) - k + 1):
                if own := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    items |= own
        expected = (len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected


def test_op10_reads_back_every_turn(spark):
    conversations = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        conversations[r.conv_id].append((r.turn, r.role, r.text or ""))
    conversations[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    expected = {}
    for c, turns in conversations.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        expected[c] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss))
    found = rows(spark, "op10_chat")
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == expected
    assert all(r.formatted_chars > r.loss_chars for r in found)


def test_op2_takes_the_article_alone(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows(spark, "op2_html_text"):
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_prefix_table_is_the_library_at_every_prefix():
    from tokenizers import Tokenizer

    from caravel.llm.tokens import PrefixCounter

    counter, tokenizer = PrefixCounter(corpus.vocabulary()), Tokenizer.from_file(corpus.vocabulary())
    texts = ["Don't they're 'stop' we'll", "réêou Größe niño 12345 ½²", "!!!'s --- a_b", "naïve é 가 İstanbul ΑΣ ας", "東京 タワー  \t x", "<|endoftext|> <|startoftext|>x", "a\x1cb\x85c\xa0d", "internationalization" * 3, ""]
    for text in texts:
        whole = unicodedata.normalize("NFC", text)
        table = np.cumsum(counter.table(text), dtype=np.int64)
        assert len(table) == len(whole)
        for i in range(1, len(whole) + 1):
            assert table[i - 1] == len(tokenizer.encode(whole[:i], add_special_tokens=False).ids), (text, i)
