"""Benchmark decontamination with a positional inverted index.

The index is partitioned by document: each row of its table is a bounded block of
documents with, for each test term, the sorted list of its positions in the block.
A phrase is found by intersecting offset-adjusted lists, beginning with the terms that
are rarest in the block, so a passage with one rare term costs that term's list only.
Frequent words and passages that a third of all documents share lie in as many blocks
as their documents do; there is no list of one term for the whole corpus, and nothing
is shuffled but the table's rows if a later test set is large.

A test set is taken in parts of a bounded number of words, each sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.shared import rows_per_batch, shared_table

WINDOW = 10
#: Words of test items that are sent to a task at once.
PART_WORDS = 500_000
#: Words of documents in one block of the index; a longer document is a block itself.
BLOCK_WORDS = 65_536
#: Every byte that is no part of a word becomes a space, A-Z become a-z.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def in_order(items: Iterable) -> list:
    """Each once and sorted, null last."""
    return sorted(set(items), key=null_last)


def null_last(item):
    return item is None, 0 if item is None else item


class TestPart:
    """The windows of some test items, as numbers of their terms."""

    def __init__(self, items: list[tuple], window: int):
        self.terms: dict[bytes, int] = {}
        self.items, self.windows = [], []
        seen: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            row = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for at in range(max(1, len(row) - window + 1) if row else 0):
                seen.setdefault(tuple(row[at : at + window]), []).append(item)
        for terms, owners in seen.items():
            self.windows.append(terms)
            self.items.append(in_order(owners))
        self.padded = np.full((len(self.windows), window), -1, np.int64)
        for i, terms in enumerate(self.windows):
            self.padded[i, : len(terms)] = terms


def block_index(documents: list[list[bytes]], terms: dict[bytes, int], gap: int) -> dict[str, np.ndarray]:
    """The positional inverted index of a block. Positions count words of the whole
    block; `gap` free positions after each document keep phrases and neighbourhoods
    within it.
    """
    known = terms.get
    codes = [np.array([known(w, -1) for w in d], np.int32) for d in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + gap)[:-1]]).astype(np.int64)
    code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    place = np.concatenate([np.arange(n) + f for n, f in zip(sizes, first)]) if codes else np.zeros(0, np.int64)
    hit = np.flatnonzero(code >= 0)
    order = hit[np.argsort(code[hit], kind="stable")]
    term, start = np.unique(code[order], return_index=True)
    return {"first": first, "size": sizes, "term": term.astype(np.int32), "start": np.append(start, len(order)).astype(np.int64), "place": place[order].astype(np.int32)}


INDEX_SCHEMA = "first binary, size binary, term binary, start binary, place binary"
INDEX_TYPES = {"first": "<i8", "size": "<i8", "term": "<i4", "start": "<i8", "place": "<i4"}


def build_index(docs: DataFrame, terms: dict[bytes, int], gap: int, keys: list[str]) -> DataFrame:
    """One row for each block: the values of `keys` of its documents, and the arrays of
    `block_index` as bytes. Null text has no words; every row of `docs` (keys, text) has
    its place, repeated ones too.
    """
    rows_per_batch(docs.sparkSession)
    kinds = ", ".join(f"{k} array<{docs.schema[k].dataType.simpleString()}>" for k in keys)

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, n = [], [], 0

        def block() -> pa.RecordBatch:
            found = block_index(texts, terms, gap)
            arrays = [pa.array([found[k].astype(t).tobytes()], pa.binary()) for k, t in INDEX_TYPES.items()]
            named = [pa.array([list(column)], pa.list_(kind)) for column, kind in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([*named, *arrays], [*keys, *INDEX_TYPES])

        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            for *row, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                texts.append(words(text))
                n += len(texts[-1]) + 1
                if n >= BLOCK_WORDS:
                    yield block()
                    rows, texts, n = [], [], 0
        if rows:
            yield block()

    return docs.select(*keys, F.col("text").cast("string")).mapInArrow(index, f"{kinds}, {INDEX_SCHEMA}")


class Block:
    def __init__(self, row: dict):
        self.__dict__.update({k: np.frombuffer(row[k], t) for k, t in INDEX_TYPES.items()})

    def places(self, term: int) -> np.ndarray:
        at = np.searchsorted(self.term, term)
        return self.place[self.start[at] : self.start[at + 1]] if at < len(self.term) and self.term[at] == term else self.place[:0]

    def counts(self, n_terms: int) -> np.ndarray:
        found = np.zeros(n_terms + 1, np.int64)  # the last: of no term, for windows that are shorter
        found[self.term] = np.diff(self.start)
        found[-1] = np.iinfo(np.int64).max
        return found

    def starts(self, terms: tuple[int, ...], counts: np.ndarray, slop: int) -> np.ndarray:
        """Where the window's terms stand, each within `slop` words of its place: lists
        shifted by the term's offset, intersected from the rarest on. That one too may be
        displaced, so each of its places gives every start within `slop`.
        """
        order = sorted(range(len(terms)), key=lambda i: counts[terms[i]])
        starts = np.unique((self.places(terms[order[0]]) - order[0])[:, None] + np.arange(-slop, slop + 1))
        for i in order[1:]:
            if not len(starts):
                break
            others = self.places(terms[i]) - i
            near = np.searchsorted(others, starts - slop)
            near = np.minimum(near, len(others) - 1)
            starts = starts[np.abs(others[near] - starts) <= slop]
        return starts


def matches_in(block: Block, part: TestPart, slop: int) -> list[tuple[int, int, int]]:
    """(window, document, first word in it) for each match in the block."""
    counts = block.counts(len(part.terms))
    rarest = counts[part.padded].min(axis=1) if len(part.windows) else np.zeros(0)
    found = []
    for w in np.flatnonzero(rarest > 0):
        starts = block.starts(part.windows[w], counts, slop)
        owners = np.searchsorted(block.first, starts, side="right") - 1
        found += [(int(w), int(d), int(s - block.first[d])) for d, s in zip(owners, starts) if d >= 0 and block.first[d] <= s < block.first[d] + block.size[d]]
    return found


def n_parts(benchmark: DataFrame, part_words: int) -> int:
    total = benchmark.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    return 1 + total // (6 * part_words)


def test_parts(benchmark: DataFrame, window: int, parts: int) -> Iterator[TestPart]:
    """The test items in `parts` parts by a hash of their rows: one part is all that driver
    and tasks hold. Null and empty texts have no window.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    for k in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = sorted(mine.collect(), key=lambda r: (null_last(r.item_id), r.text))
        yield TestPart([(r.item_id, r.text) for r in rows], window)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, part_words: int = PART_WORDS) -> DataFrame:
    """doc_id, n_words, item_ids (sorted), and spans (array of [first, end) word numbers,
    merged) for each row of `docs`: what windows of `benchmark` (item_id, text) occur.

    Exact phrases with slop 0; otherwise proximity matches, whose terms may each stand
    up to `slop` words from their place (the span is the window's own place, which begins
    in the document). Documents
    without words or matches have empty arrays. Items of a null item_id are one null in
    item_ids, the last.
    """
    return matches_of(docs, benchmark, ["doc_id"], window, slop, part_words)


def matches_of(docs: DataFrame, benchmark: DataFrame, keys: list[str], window: int, slop: int, part_words: int) -> DataFrame:
    """`phrase_matches` with the columns `keys` of `docs` in place of doc_id. If the test set
    has several parts, the rows of `docs` are written with a number first, and what the
    parts find of a row is merged by it.
    """
    rows_per_batch(docs.sparkSession, 200)  # of the index, a row is a block
    parts = n_parts(benchmark, part_words)
    if parts > 1:
        docs = shared_table(docs.select(F.monotonically_increasing_id().alias("__row"), *keys, F.col("text").cast("string").alias("text")), "numbered-docs")
    carried = ["__row", *keys] if parts > 1 else keys
    item = benchmark.schema["item_id"].dataType.simpleString()
    item_type = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in carried)
    schema = f"{kinds}, n_words bigint, item_ids array<{item}>, spans array<array<bigint>>"
    found = None
    for part in test_parts(benchmark, window, parts):
        index = shared_table(build_index(docs, part.terms, window + slop, carried), "postings")

        def search(batches: Iterable[pa.RecordBatch], part: TestPart = part) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, row in enumerate(batch.select([*INDEX_TYPES]).to_pylist()):
                    block = Block(row)
                    items: dict[int, set] = {}
                    spans: dict[int, list] = {}
                    for w, d, start in matches_in(block, part, slop):
                        items.setdefault(d, set()).update(part.items[w])
                        spans.setdefault(d, []).append([start, min(start + len(part.windows[w]), int(block.size[d]))])
                    n = range(len(block.size))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(k)[at].values for k in carried),
                            pa.array(block.size.astype(np.int64)),
                            pa.array([in_order(items.get(d, ())) for d in n], pa.list_(item_type)),
                            pa.array([merged(spans.get(d, [])) for d in n], pa.list_(pa.list_(pa.int64()))),
                        ],
                        [*carried, "n_words", "item_ids", "spans"],
                    )

        more = index.mapInArrow(search, schema)
        found = more if found is None else found.unionByName(more)
    if parts == 1:
        return found
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("item_ids", "spans")]  # one of each part
    rows = found.groupBy("__row").agg(*(F.first(c).alias(c) for c in [*keys, "n_words"]), *lists)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([in_order(x) for x in batch.column("item_ids").to_pylist()], batch.column("item_ids").type)
            spans = pa.array([merged(x) for x in batch.column("spans").to_pylist()], batch.column("spans").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], items, spans], batch.schema.names)

    merged_rows = rows.select(*keys, "n_words", "item_ids", "spans")
    return merged_rows.mapInArrow(merge, merged_rows.schema)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of `docs` in whose own text no match is found, whatever their doc_ids; rows of
    null or empty text stay.
    """
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    texts = docs.select("text", sha.alias("text_sha256"))
    found = matches_of(texts, benchmark, ["text_sha256"], window, 0, part_words).filter(F.size("spans") > 0)
    hit = shared_table(found.select("text_sha256").distinct(), "contaminated")
    return docs.join(hit, sha == hit["text_sha256"], "left_anti")
