"""Spelling variants of a corpus's words by bands of letter parities.

A word's mask has a bit for each letter that it holds an odd number of times. One edit
flips at most two bits, so of the mask's three bands one is equal in two words that are
one edit apart. Words meet by an equal band and the length of the longer word; as one edit
also leaves one half of the longer word's length untouched, at the beginning or at the end,
they meet by that half too, which splits the bands of short and of alike words. Every pair
is verified where it meets and belongs to the first band and the first half that it shares,
so it comes out once.

All joins are ones by shuffle at every size. The planner judges a table by its packed files, or
by what it is made of before keys are spread, and would send a vocabulary through the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.shared import rows_per_batch, shared_table

MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a letter.
DAMAGED = 97
#: Runs of letters of Latin-1 text, as bytes with A-Z in lower case.
RUNS = re.compile(rb"[a-z\xc0-\xff]+")
#: Distinct words, and their bytes, that a task holds before it hands on its counts.
HELD_WORDS, HELD_BYTES = 500_000, 50_000_000
BANDS, BAND_BITS = 3, 21
#: Letters from the most to the least frequent go to the bands in turn.
FREQUENT = b"etaoinshrdlcumwfgypbvkjxqz"


def letter_bits() -> dict[str, int]:
    """The mask of each letter. a-z have bits of their own; the letters from U+00C0 on share
    those that are left, which cannot raise the number of bits that an edit flips.
    """
    places = [band * BAND_BITS + i for i in range(BAND_BITS) for band in range(BANDS)]
    bits = {chr(c): 1 << places[i] for i, c in enumerate(FREQUENT)}
    spare = places[len(FREQUENT) :]
    return bits | {chr(c): 1 << spare[c % len(spare)] for c in range(0xC0, 0x100)}


BITS = letter_bits()


def parity_mask(word: str) -> int:
    mask = 0
    for letter in word:
        mask ^= BITS[letter]
    return mask


def counted_runs(name: str, text: str) -> Iterator[tuple[bytes, int]]:
    """The words of a text, each with its number, some runs with a letter left out."""
    begun = zlib.crc32(f"{name}:".encode())
    for run, n in Counter(RUNS.findall(text.encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the words of `docs` with at least so many characters and occurrences. Tasks
    count first; the shuffle gets a word once from each task, or each time a task has met
    HELD_WORDS of them.
    """
    rows_per_batch(docs.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0

        def handed_on() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in counted_runs(name or "", text or ""):
                    if len(word) >= min_chars:
                        if word not in held:
                            size += len(word)
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS or size > HELD_BYTES:
                    yield handed_on()
                    held.clear()
                    size = 0
        yield handed_on()

    counts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(count, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def masked(words: DataFrame) -> DataFrame:
    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array(map(parity_mask, batch.column("word").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, masks], ["word", "n", "mask"])

    return words.select("word", "n").mapInArrow(mask, "word string, n bigint, mask bigint")


def band(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(((1 << BAND_BITS) - 1) << (i * BAND_BITS)))


def keyed(words: DataFrame, longer: bool) -> DataFrame:
    """A row of `words` (word, n, mask) for each key by which it meets others, as the longer
    word of a pair or as any word of it. `meet` is the number of the band, doubled, and one
    more for the half at the end.
    """
    length = F.length("word")

    def key(i: int, end: int, long: Column) -> Column:
        half = (long / 2).cast("int")
        part = F.col("word").substr(length - half + 1, half) if end else F.col("word").substr(F.lit(1), half)
        return F.struct(F.lit(2 * i + end).alias("meet"), F.xxhash64(F.lit(2 * i + end), long, band(F.col("mask"), i), part).alias("key"))

    lengths = [length] if longer else [length, length + 1]
    keys = F.array(*[key(i, end, long) for i in range(BANDS) for end in (0, 1) for long in lengths])
    return words.select("word", "n", "mask", F.explode(keys).alias("k")).select("word", "n", "mask", "k.meet", "k.key")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words of `words` (word, n; distinct) that differ by exactly
    one inserted, deleted or replaced code point, once; a is the longer or the smaller one.
    """
    words = masked(words)
    long = keyed(words, True).select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"), "meet", "key")
    other = keyed(words, False).select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"), F.col("meet").alias("meet_b"), F.col("key").alias("key_b"))
    flipped = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    length, half = F.length("a"), (F.length("a") / 2).cast("int")
    first_band = F.when(band(flipped, 0) == 0, 0).when(band(flipped, 1) == 0, 1).otherwise(2)
    same_begin = F.col("a").substr(F.lit(1), half) == F.col("b").substr(F.lit(1), half)
    once = F.col("meet") == 2 * first_band + F.when(same_begin, 0).otherwise(1)
    ordered = (length == F.length("b") + 1) | ((length == F.length("b")) & (F.col("a") < F.col("b")))
    near = (F.bit_count(flipped) <= 2) & ordered & once & (F.levenshtein("a", "b", 1) == 1)
    met = (F.col("key") == F.col("key_b")) & (F.col("meet") == F.col("meet_b"))
    return long.join(other.hint("merge"), met & near).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root of `forms` (word, form): the last word that forms lead to. A form has at
    least RATIO times its word's number, so a way is no longer than the logarithm of the
    largest number; each round doubles the steps that every word has gone.
    """
    steps = max(1, most).bit_length()
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps.bit_length()):
        found = shared_table(found, "roots")
        on = found.select(F.col("word").alias("at"), F.col("root").alias("next"))
        found = found.join(on.hint("merge"), found["root"] == on["at"], "left").select("word", F.coalesce("next", "root").alias("root"))
    return found


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of `docs` (doc_id, text) with at
    least `min_chars` characters and `min_count` occurrences.

    `form` is the near word (one edit away) of the largest n, ties by code points, if that
    is at least RATIO times the word's own n, else null as form_n is; `root` is the last
    word that forms lead to, the word itself if it has none. Null texts have no words; a
    null doc_id counts as an empty name; repeated rows count again. No words give no rows.
    """
    words = shared_table(word_counts(docs, min_chars, min_count), "words")
    pairs = shared_table(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = words.join(best.hint("merge"), "word", "left")
    takes = -F.col("best.less") >= RATIO * F.col("n")
    chosen = chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    chosen = shared_table(chosen, "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(chosen.filter("form is not null"), most)
    return chosen.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
