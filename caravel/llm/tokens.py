"""Token ids and exact token counts at every prefix of a text, for a word BPE vocabulary
in the tokenizers library's format (NFC, lower case, words split by pattern, a mark at
each word's end).

Word pieces are independent of each other in such a vocabulary. So the ids of a text
are its pieces' ids one after another, and each Python worker keeps a bounded memory of
short pieces that it has met; long ones are worked out where they stand. Texts of a plain
range of characters are cut into pieces here; all others are normalised and cut by the
library's own rules, as only it knows its version of Unicode.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from caravel.llm.shared import rows_per_batch

#: Pieces kept by a worker; when full, the memory is emptied and filled again.
MEMORY = 400_000
#: Pieces, and prefixes of pieces, that are longer are not kept.
LONG = 48
#: Words with what stands beside them up to the spaces, kept as wholes up to this length.
WORD = 10
#: Texts of these characters need no library: NFC leaves them, lower case is one to one.
PLAIN = re.compile(r"[\t-\r\x20-\x7E\xA1-įı-ňŊ-ž]*")
#: Letters and other numbers of the plain range, after lower-casing.
LETTERS = "a-zªµºß-öø-ž"
NUMBERS = "0-9²³¹¼½¾"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
PIECES = re.compile(f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
SPACES = "\t\n\v\f\r "
PIECES_AND_SPACE = re.compile(f"{PIECES.pattern}|\\s+")


@cache
def library(path: str):
    return Tokenizer.from_file(path)


class Memory(dict):
    """piece -> what `make` gives for it; kept for short pieces only."""

    def __init__(self, make, longest: int = LONG):
        self.make, self.longest = make, longest

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = value
        return value


class Encoder:
    """Ids as little-endian bytes of `dtype`."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.pieces = Memory(self.by_model)
        self.words = Memory(self.by_pieces, WORD)

    def is_plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def nfc(self, text: str) -> str:
        return normalizers.NFC().normalize_str(text)

    def lower_case(self, char: str) -> str:
        return normalizers.Lowercase().normalize_str(char)

    def cuts(self, lowered: str) -> list[tuple[int, int]]:
        """(start, end) of the pieces of a normalised text, white space left out."""
        return [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(lowered)]

    def by_library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def by_model(self, piece: str) -> bytes:
        """The ids of a plain piece: the library's model on the letters that stand for its bytes."""
        found = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in found], self.dtype).tobytes()

    def by_pieces(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(word)))

    def ids(self, text: str) -> bytes:
        """No piece has white space in it, and none depends on what is beyond the space, so a
        plain text is looked up by what stands between spaces.
        """
        if self.is_plain(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return self.by_library(text)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes for themselves, the others numbered from U+0100.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Exact token counts at every prefix, by dynamic programming over prefixes.

    `last[i]` is the last token of the first i symbols of a piece that goes on. A token
    that covers symbols j to i can follow exactly when merging it with last[j] leaves
    both as they are; one such token exists for each i. The count at i is the count at j
    plus one; for the count of the prefix as a piece of its own, the last token is one
    with the end mark. Nothing is encoded again for any prefix.
    """

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        model = json.loads(self.encoder.tokenizer.to_str())["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab))
        self.tails = {"": set(), self.end: set()}  # ends of tokens, without and with the mark
        for token in self.vocab:
            ended = token.endswith(self.end) and token != self.end
            whole = token.removesuffix(self.end) if ended else token
            self.tails[self.end if ended else ""].update(whole[i:] for i in range(len(whole)))
        self.goes_on: dict[str, tuple[str, int]] = {}
        self.ended: dict[str, int] = {}
        self.letters = byte_letters()
        self.stands = Memory(self.both_stand)
        self.pieces = Memory(self.steps)
        self.words = Memory(self.by_pieces, WORD)
        self.lower = Memory(self.encoder.lower_case)

    def merged(self, symbols: list[str], edge: int = 0) -> list[str]:
        """The tokens of `symbols`; none if one would cover both sides of the first `edge`."""
        rank, never = self.rank.get, len(self.rank)
        ranks = [rank(pair, never) for pair in zip(symbols, symbols[1:])]
        edge -= 1
        while ranks and (best := min(ranks)) != never:
            at = ranks.index(best)
            if at == edge:
                return []
            edge -= at < edge
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), never)
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), never)
        return symbols

    def both_stand(self, pair: tuple[str, str]) -> bool:
        left, right = pair
        if pair in self.rank:
            return False
        ended = right.endswith(self.end) and len(right) > len(self.end)
        symbols = [*left, *(right.removesuffix(self.end) if ended else right)]
        if ended:
            symbols[-1] += self.end
        return self.merged(symbols, len(left)) == [t for t in pair if t]

    def ending(self, symbols: str, stop: int, end: str, last: list[tuple[str, int]]) -> tuple[str, int]:
        """The last token of the first `stop` of `symbols`, and the count with it; `last`
        has the same for the prefixes before. Longer and longer ends are tried while some
        token ends in them.
        """
        vocab, stands, tails = self.vocab, self.stands, self.tails[end]
        for j in range(stop - 1, -1, -1):
            tail = symbols[j:stop]
            if tail not in tails:
                break
            if (token := tail + end) in vocab and stands[last[j - stop][0], token]:
                return token, last[j - stop][1] + 1
        raise ValueError(f"no token ends {symbols[max(0, stop - self.longest) : stop]!r}")

    def steps(self, piece: str) -> bytes:
        """For each code point of a piece, the change of the count, as 32-bit numbers."""
        if piece[0] in SPACES:
            return bytes(4 * len(piece))
        raw = piece.encode()
        symbols = "".join([self.letters[b] for b in raw])
        ends = range(1, len(raw) + 1) if len(raw) == len(piece) else np.cumsum([len(c.encode()) for c in piece]).tolist()
        counts = self.short(symbols, ends) if len(symbols) <= LONG else self.long(symbols, ends)
        return struct.pack(f"<{len(piece)}i", *map(sub, counts, [0, *counts]))

    def by_pieces(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES_AND_SPACE.findall(word)))

    def short(self, symbols: str, ends: Sequence[int]) -> list[int]:
        """The counts at `ends`. What is known of a prefix holds for every piece that begins
        with it.
        """
        goes_on, ended, ending, end = self.goes_on, self.ended, self.ending, self.end
        if max(len(goes_on), len(ended)) >= MEMORY:
            goes_on.clear()
            ended.clear()
        last, counts, prefix, known = [("", 0)], [], "", 0
        for stop in ends:
            for at in range(max(1, known), stop):
                if at > known:
                    prefix = symbols[:at]
                state = goes_on.get(prefix)
                if state is None:
                    state = goes_on[prefix] = ending(prefix, at, "", last)
                last.append(state)
            prefix, known = symbols[:stop], stop
            n = ended.get(prefix)
            if n is None:
                n = ended[prefix] = ending(prefix, stop, end, last)[1]
            counts.append(n)
        return counts

    def long(self, symbols: str, ends: Sequence[int]) -> list[int]:
        """The same, holding only the states within reach of the longest token."""
        last, done, counts = [("", 0)], 1, []
        for stop in ends:
            while done < stop:
                last.append(self.ending(symbols, done, "", last))
                done += 1
                if len(last) > 64 * self.longest:
                    del last[: -self.longest]
            counts.append(self.ending(symbols, stop, self.end, last)[1])
        return counts

    def table(self, text: str) -> np.ndarray:
        """Changes of the token count, one for each code point of the text in NFC: the
        count at prefix i is the sum of the first i. A special string of the vocabulary
        stands for itself and counts as one token once it is whole; before, as ordinary
        text. What lies between special strings is put in NFC.
        """
        if self.encoder.is_plain(text):
            # no piece goes beyond a space, so what stands between spaces is looked up as a whole
            return np.frombuffer(bytes(4).join(map(self.words.__getitem__, text.lower().split(" "))), "<i4")
        parts = re.split("(" + "|".join(map(re.escape, self.encoder.special)) + ")", text)
        return np.concatenate([self.special(p) if p in self.encoder.special else self.other(p) for p in parts])

    def special(self, part: str) -> np.ndarray:
        steps = self.other(part)
        steps[-1] += 1 - steps.sum()
        return steps

    def other(self, part: str) -> np.ndarray:
        lowered = [self.lower[c] for c in self.encoder.nfc(part)]
        joined = "".join(lowered)
        steps = np.zeros(len(joined), "<i4")
        for start, end in self.encoder.cuts(joined):
            steps[start:end] = np.frombuffer(self.pieces[joined[start:end]], "<i4")
        if len(lowered) == len(joined):
            return steps
        ends = np.cumsum([len(c) for c in lowered])
        return np.diff(np.concatenate([[0], np.cumsum(steps)])[ends], prepend=0)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """The most code points whose prefix has at most `budget` tokens, of the count at each
    (counts are not monotone: a longer prefix may merge into fewer).
    """
    if len(counts) and counts[-1] <= budget:
        return len(counts)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, vocabulary: str, budgets: tuple[int, ...] = (), keep_table: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, `fits` (for each of `budgets`, the code points of the
    longest prefix within it) and, if kept, `steps`: the prefix table as a little-endian
    signed 32-bit number for each code point of the NFC form, whose running sum is the
    token count.

    One row for each row of `docs` (doc_id, text), repeated ones and null doc_ids too;
    further columns are left alone, no rows give none. Null text counts as empty, empty
    text has no tokens and the empty table. Words of any length are exact: they need
    memory for their own table only.
    """
    rows_per_batch(docs.sparkSession)
    schema = "doc_id {}, n_bytes bigint, n_tokens bigint, fits array<bigint>".format(docs.schema["doc_id"].dataType.simpleString())
    schema += ", steps binary" if keep_table else ""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = counter(vocabulary)
        for batch in batches:
            sizes, tokens, fits, tables = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                table = dp.table(text)
                sizes.append(len(text.encode()))
                counts = np.cumsum(table, dtype=np.int64)
                tokens.append(int(counts[-1]) if len(counts) else 0)
                fits.append([longest_prefix(counts, b) for b in budgets])
                if keep_table:
                    tables.append(table.astype("<i4").tobytes())
            out = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(fits, pa.list_(pa.int64()))]
            names = ["doc_id", "n_bytes", "n_tokens", "fits"]
            if keep_table:
                out, names = [*out, pa.array(tables, pa.binary())], [*names, "steps"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(count, schema)


def tokenised(docs: DataFrame, vocabulary: str, last_id: int | None) -> DataFrame:
    """part, before (ids of the same partition's rows before this one), doc_id, n_ids and
    ids (bytes, as wide as the vocabulary needs) of each row, with `last_id` at the end.
    """
    rows_per_batch(docs.sparkSession)
    schema = "doc_id {}, before bigint, n_ids bigint, ids binary".format(docs.schema["doc_id"].dataType.simpleString())

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = encoder(vocabulary), 0
        tail = b"" if last_id is None else np.array([last_id], own.dtype).tobytes()
        for batch in batches:
            ids = [own.ids(text or "") + tail for text in batch.column(1).to_pylist()]
            sizes = np.array([len(x) // own.dtype.itemsize for x in ids], np.int64)
            before = total + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(ids) else np.zeros(0, np.int64)
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(before, pa.int64()), pa.array(sizes), pa.array(ids, pa.binary())],
                ["doc_id", "before", "n_ids", "ids"],
            )

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(encode, schema).select(F.spark_partition_id().alias("part"), "*")
