"""Cross-tokenizer alignment of a byte-level BPE vocabulary (A) and a sentence-piece
vocabulary (B).

Both cut the same bytes, so a text's tokens are laid over each other by the cumulative
sums of their lengths: ends common to both cut the text into groups, and every A token is
linked with the B tokens whose bytes it overlaps. This is done at once for all distinct
words of a block of documents (a few megabytes of text).

Links are counted before anything is shuffled: a block has one row for each pair of ids in
it. The corpus-wide counts are summed in two stages, by pair and a salt and then by pair,
and go back to the blocks, again as one row for each pair and block. No list of one pair's
links or one document's links crosses the network; the table of pairs meets the blocks by
shuffle unless Spark finds it small.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from caravel.llm.shared import rows_per_batch, shared_table
from caravel.llm.tokens import PLAIN, byte_letters

#: Bytes of text of a block; a longer document is a block itself.
BLOCK_BYTES = 8_000_000
#: Parts of a pair's blocks that are summed apart first.
SALTS = 16
#: Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where both vocabularies cut plain texts.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how a sentence-piece vocabulary names a byte, and its space.
BYTE_PIECE, SPACE_MARK = re.compile(r"<0x([0-9A-Fa-f]{2})>"), "▁"


class Vocabulary:
    """Each id's bytes, as one row of bytes with starts and lengths."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = len(tokens)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class ByteLevel(Vocabulary):
    """A. The library itself encodes; texts whose characters no version of Unicode sees
    differently go through a quicker library with the same vocabulary.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        special = self.library.get_added_tokens_decoder()
        named = {i: t for t, i in self.library.get_vocab().items()}
        tokens = [b""] * (max(named) + 1)
        for i, token in named.items():
            tokens[i] = token.encode() if i in special else bytes(byte[c] for c in token)
        super().__init__(tokens)
        ranks = {t: i for i, t in enumerate(tokens) if i not in special}
        self.twin = tiktoken.Encoding("alignment", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        """Of a space and the text."""
        text = " " + text
        return self.twin.encode_ordinary(text) if PLAIN.fullmatch(text) else self.library.encode(text, add_special_tokens=False).ids


class SentencePiece(Vocabulary):
    """B, which puts a space before the text itself."""

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        tokens = []
        self.crosses = False
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            byte = BYTE_PIECE.fullmatch(piece)
            self.crosses |= re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", piece) is not None
            tokens.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode())
        super().__init__(tokens)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


@cache
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@cache
def sentence_piece(path: str) -> SentencePiece:
    return SentencePiece(path)


class Units:
    """The stretches of texts that both vocabularies cut apart from all others.

    In a plain text a single space between two other characters begins a token of both, so
    words between such spaces are units, and the same word is laid over itself once for the
    whole block. A plain text's first and last unit stand alone if white space is at its
    edge; a text of other characters is one unit.
    """

    def __init__(self, texts: list[str], apart: bool):
        index: dict[str, int] = {}
        alone: dict[str, int] = {}
        self.n = np.zeros(len(texts), np.int64)
        at = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if apart and PLAIN.fullmatch(text):
                words = BETWEEN.split(text)
                edges = {i: w for i, w in ((0, words[0]), (len(words) - 1, words[-1])) if w[0].isspace() or w[-1].isspace()}
                own = [index.setdefault(w, len(index)) if i not in edges else ~alone.setdefault(w, len(alone)) for i, w in enumerate(words)]
            else:
                own = [~alone.setdefault(text, len(alone))]
            self.n[i] = len(own)
            at.append(np.array(own, np.int64))
        at = np.concatenate([np.zeros(0, np.int64), *at])
        self.words, self.alone = list(index), list(alone)
        #: The unit of each place of each text, words first.
        self.at = np.where(at < 0, len(index) + ~at, at)


class Overlay:
    """Two cuts laid over each other, of units that follow each other in one row of bytes.

    `a` and `b` are the ids, `end_a` and `end_b` where they end. A unit that either
    vocabulary does not give back byte for byte has no tokens and no bytes.
    """

    def __init__(self, units: Units, first: Vocabulary, second: Vocabulary):
        self.first, self.second = first, second
        texts = [*([" ".join(units.words)] if units.words else []), *units.alone]
        raw = [(" " + t).encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good, sides = np.ones(len(raw), bool), []
        for vocabulary in (first, second):
            own = [np.array(vocabulary.ids(t), np.int64) for t in texts]
            n = np.fromiter(map(len, own), np.int64, len(own))
            ids = np.concatenate([np.zeros(0, np.int64), *own])
            upto = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])
            edge = np.concatenate([[0], np.cumsum(n)])
            good &= upto[edge[1:]] - upto[edge[:-1]] == size
            sides.append((vocabulary, ids, n))
        joined = np.frombuffer(b"".join(r for r, g in zip(raw, good) if g), np.uint8)
        ends = np.cumsum(np.where(good, size, 0))
        wrong = [np.flatnonzero(v.joined(ids[np.repeat(good, n)]) != joined) for v, ids, n in sides]
        good[np.unique(np.searchsorted(ends, np.concatenate(wrong), side="right"))] = False
        self.a, self.b = (ids[np.repeat(good, n)] for _, ids, n in sides)
        self.whole = not units.words or bool(good[0])
        words = [len(w.encode()) + 1 for w in units.words] if self.whole else []
        self.unit_end = np.cumsum([*words, *np.where(good, size, 0)[1 if units.words else 0 :]])
        self.n_units = len(self.unit_end)
        self.end_a, self.end_b = np.cumsum(first.length[self.a]), np.cumsum(second.length[self.b])
        self.common = np.intersect1d(self.end_a, self.end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(self.common, self.end_a), np.searchsorted(self.common, self.end_b)

    def by_unit(self, ends: np.ndarray) -> np.ndarray:
        """How many of `ends` each unit has."""
        return np.bincount(np.searchsorted(self.unit_end, ends), minlength=self.n_units)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(links of each unit, pair of each link), in the order of the A tokens. A pair is
        A id x size of B + B id.
        """
        low = np.searchsorted(self.end_b, self.end_a - self.first.length[self.a], side="right")
        n = np.searchsorted(self.end_b, self.end_a) - low + 1
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
        of_unit = np.bincount(np.searchsorted(self.unit_end, self.end_a), weights=n, minlength=self.n_units).astype(np.int64)
        return of_unit, np.repeat(self.a, n) * self.second.size + self.b[b]

    def groups(self, written: list[bytes]) -> list[bytes]:
        """Each unit's groups as `a1,a2|b1;a3|b2,b3`; `written` is of `written_ids`."""
        na, nb = self.first.size, self.second.size
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (self.group_a, self.group_b))
        codes = np.concatenate([self.a + na * last_a, 2 * na + self.b + nb * last_b])
        codes = codes[np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")].tolist()
        edge = np.concatenate([[0], np.cumsum(self.by_unit(self.end_a) + self.by_unit(self.end_b))]).tolist()
        return [b"".join(map(written.__getitem__, codes[i:j]))[:-1] for i, j in zip(edge, edge[1:])]


def laid_over(texts: list[str], first: ByteLevel, second: SentencePiece) -> tuple[Units, Overlay]:
    units = Units(texts, not second.crosses)
    laid = Overlay(units, first, second)
    if not laid.whole:  # a vocabulary that changes plain texts: each stands or falls alone
        units = Units(texts, False)
        laid = Overlay(units, first, second)
    return units, laid


def groups_of(units: Units, laid: Overlay) -> list[bytes]:
    """Each text's groups."""
    own = laid.groups(written_ids(laid.first.size, laid.second.size))
    at, edge = units.at.tolist(), np.concatenate([[0], np.cumsum(units.n)]).tolist()
    return [b";".join(map(own.__getitem__, at[i:j])) for i, j in zip(edge, edge[1:])]


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each run of `n` values."""
    upto, end = np.concatenate([[0], np.cumsum(values)]), np.cumsum(n)
    return upto[end] - upto[end - n]


def runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., n numbers for each of `start`."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def summed_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's values."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


@cache
def written_ids(n_a: int, n_b: int) -> list[bytes]:
    """Ids as they stand in `groups`: of A within and at the end of a group, then of B."""
    return [b"%d%b" % (i, mark) for n, marks in ((n_a, b",|"), (n_b, b",;")) for mark in (marks[:1], marks[1:]) for i in range(n)]


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values byte by byte of equal weight, which compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def of_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64)


def lists(*values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
BLOCK = (
    ", ".join(f"{c} array<bigint>" for c in COUNTS)
    + ", groups_sha256 array<string>, n_pairs array<bigint>, step binary, times binary, pair array<bigint>, pair_n array<bigint>"
)


def in_blocks(docs: DataFrame, column: str, block_bytes: int, make, schema: str) -> DataFrame:
    """`make(values of column, texts)` gives the record batch of each block of `docs`."""
    rows_per_batch(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, texts, n = [], [], 0
        for batch in batches:
            at = 0
            own = [t or "" for t in batch.column(1).to_pylist()]
            for i, text in enumerate(own):
                n += len(text)
                if n >= block_bytes:
                    yield make(pa.chunked_array([*kept, batch.column(0)[at : i + 1]]).combine_chunks(), texts + own[at : i + 1])
                    kept, texts, n, at = [], [], 0, i + 1
            kept.append(batch.column(0)[at:])
            texts += own[at:]
        if texts:
            yield make(pa.chunked_array(kept).combine_chunks(), texts)

    return docs.select(column, F.col("text").cast("string")).mapInArrow(run, schema)


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: lists of its documents' ids, counts and digests of groups; its
    pairs with the number of their links; and each document's pairs, as steps through the
    block's sorted pairs with the number of links.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        units, laid = laid_over(texts, byte_level(path_a), sentence_piece(path_b))
        unit_links, pairs = laid.links()
        counted = (laid.by_unit(laid.end_a), laid.by_unit(laid.end_b), laid.by_unit(laid.common), unit_links)
        columns = lists(*(sums(c[units.at], units.n) for c in counted))
        block_pairs, of_link = np.unique(pairs, return_inverse=True)
        n, m = max(1, laid.n_units), max(1, len(block_pairs))
        own, uses = np.unique(np.repeat(np.arange(len(texts)), units.n) * n + units.at, return_counts=True)
        n_links = unit_links[own % n] if len(own) else own
        link = runs((np.cumsum(unit_links) - unit_links)[own % n] if len(own) else own, n_links)
        doc_pair, times = summed_by(np.repeat(own // n, n_links) * m + of_link[link], np.repeat(uses, n_links))
        doc, at = doc_pair // m, doc_pair % m
        n_pairs = np.bincount(doc, minlength=len(texts))
        step = np.diff(at, prepend=0)
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        step[begin] = at[begin]
        total = np.bincount(at, weights=times, minlength=len(block_pairs)).astype(np.int64)
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups_of(units, laid)]
        names = ["doc_id", *COUNTS, "groups_sha256", "n_pairs", "step", "times", "pair", "pair_n"]
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                *columns,
                pa.array([digests], pa.list_(pa.string())),
                *lists(n_pairs.astype(np.int64)),
                pa.array([planes(step)], pa.binary()),
                pa.array([planes(times)], pa.binary()),
                *lists(block_pairs.astype(np.int64), total),
            ],
            names,
        )

    return in_blocks(docs, "doc_id", block_bytes, make, f"doc_id array<{kind}>, {BLOCK}")


def pair_totals(pairs: DataFrame, salts: int = SALTS) -> DataFrame:
    """pair, n: the corpus-wide number of links of each pair of `pairs` (block, pair,
    pair_n). Summed by pair and a salt of the block first.
    """
    salted = pairs.groupBy("pair", F.pmod("block", F.lit(salts)).alias("salt")).agg(F.sum("pair_n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and groups (text, `a1,a2|b1;a3|b2,b3`) of each row of `docs` (doc_id, text).

    Null and empty texts, and texts that either vocabulary does not give back byte for byte
    with a space before them, have empty groups. Repeated rows and null doc_ids are rows
    like any other; no rows give none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        found = groups_of(*laid_over(texts, byte_level(path_a), sentence_piece(path_b)))
        return pa.RecordBatch.from_arrays([ids, pa.array([g.decode() for g in found], pa.string())], ["doc_id", "groups"])

    return in_blocks(docs, "doc_id", block_bytes, make, f"doc_id {kind}, groups string")


def linked_pairs(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """a, b, n: how many links of `docs` hold each pair of ids linked."""
    blocks = shared_table(aligned_blocks(docs, path_a, path_b, block_bytes).withColumn("block", F.monotonically_increasing_id()), "aligned")
    size_b = sentence_piece(path_b).size
    return pair_totals(exploded(blocks)).select(F.expr(f"pair div {size_b}").alias("a"), (F.col("pair") % size_b).alias("b"), "n")


def exploded(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.posexplode(F.arrays_zip("pair", "pair_n")).alias("place", "own")).select("block", "place", "own.pair", "own.pair_n")


def aligned(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is the most
    linked of its B id in all of `docs`, ties included), count_sum (over the links, how
    often their pairs are linked in all of `docs`), groups_sha256, for each row of `docs`
    (doc_id, text).

    Null and empty texts, and texts that either vocabulary does not give back byte for byte
    with a space before them, have no tokens: zeros and ''. Repeated rows and null doc_ids
    are rows like any other; no rows give none.
    """
    blocks = shared_table(aligned_blocks(docs, path_a, path_b, block_bytes).withColumn("block", F.monotonically_increasing_id()), "aligned")
    pairs = exploded(blocks)
    totals = shared_table(pair_totals(pairs), "pairs")
    b = (F.col("pair") % sentence_piece(path_b).size).alias("b")
    # at most one row for each id of B: bounded by the vocabulary
    best = totals.groupBy(b).agg(F.max("n").alias("most"))
    rated = totals.select("pair", b, "n").join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    counted = pairs.select("block", "place", "pair").join(rated, "pair").select("block", "place", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def score(block: pa.Table, rows: pa.Table) -> pa.Table:
        n, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        place = rows.column("place").to_numpy()
        n[place], best[place] = rows.column("n").to_numpy(), rows.column("best").to_numpy(zero_copy_only=False)
        of = {c: block.column(c).combine_chunks().flatten() for c in block.column_names if c not in ("whole", "step", "times")}
        n_pairs = of["n_pairs"].to_numpy()
        step, times = (of_planes(block.column(c)[0].as_py()) for c in ("step", "times"))
        begin = np.cumsum(n_pairs) - n_pairs
        upto = np.cumsum(step)
        before = np.concatenate([[0], upto])[begin]
        at = upto - np.repeat(before, n_pairs)  # each document's steps begin at the block's first pair

        def summed(values: np.ndarray) -> pa.Array:
            out = np.concatenate([[0], np.cumsum(values[at] * times)])
            return pa.array(out[begin + n_pairs] - out[begin])

        return pa.table([of["doc_id"], *(of[c] for c in COUNTS), summed(best), summed(n), of["groups_sha256"]], names=["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    whole = blocks.select(F.col("block").alias("whole"), *[c for c in blocks.columns if c not in ("block", "pair", "pair_n")])
    return whole.groupBy("whole").cogroup(counted.groupBy("block")).applyInArrow(score, schema)
