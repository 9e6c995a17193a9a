"""SimHash near duplicates by meet-in-the-middle ball hashing.

Two fingerprints at r or fewer differing bits have a value within r/2 of both. So each
distinct fingerprint emits every variant within r/2 bits (65 for r = 2); equal variants
meet in one shuffle. Fingerprints that meet are within r of each other, so a variant
has no more of them than the ball has members (65), however many documents share
them: copies are merged into one fingerprint before. Each is verified against its
neighbour in the variant's sorted order, which links all that meet there without a row
for every pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.shared import forget, rows_per_batch, shared_table

SHINGLE = 3
SEED = 42
RADIUS = 2


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of each row."""
    rows_per_batch(docs.sparkSession)
    schema = "doc_id {}, fp bigint".format(docs.schema["doc_id"].dataType.simpleString())

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or "", shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(make, schema)


def ball(radius: int) -> list[int]:
    """All masks of at most `radius` bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links a < b between fingerprints of `distinct` (fp) that connect every
    two at `radius` (even) or fewer bits: neighbours in each variant's sorted order.
    """
    variant = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("bigint")) for m in ball(radius // 2)])).alias("variant")
    met = distinct.select("fp", variant)
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = met.select(before.alias("a"), F.col("fp").alias("b")).filter("a is not null")
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over `edges` (a, b), for all nodes in them.

    Large-star and small-star in turn (Kiveris et al., 2014) until nothing changes; every
    round is written, and the smallest neighbour is an aggregate that merges on the map
    side, so a hub is never gathered in one task.
    """
    edges = shared_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = shared_table(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        past, edges = edges, shared_table(small.filter("u != v").distinct(), "small-star")
        forget(past, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of at most
    `radius` differing bits) of each row of `docs` (doc_id, text).

    Null text counts as empty and has fingerprint zero, as any text without words; it
    links like any other. Null doc_ids are members but never a component's id, unless it
    has no other. Repeated rows are rows of their own.
    """
    prints = shared_table(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = shared_table(distinct, "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
