"""Near copies by the Jaccard similarity of their word shingles.

Candidates meet in two ways. SimHashes of the sets at RADIUS or fewer differing bits meet by
ball hashing (simhash.py). Documents that share four fifths of their five-word shingles
differ in about ten of 64 bits, far beyond any ball that can be emitted; so they meet by
MinHash as well: a document has 20 bands of five minima over its shingles, and two at
similarity 0.8 share a band but once in 2,000 cases. In a band's bucket each member is paired with the first and with its neighbour in the
order of the members' SimHashes, so a bucket makes two rows a member however many meet.
Pairs of both ways are verified on the shingles themselves, and the links join most of what
is alike.

Buckets that then still hold several components are compared whole, once: their members are
dealt into blocks of a bounded size, and every two blocks that do not belong to one and the
same component are a task, which verifies members of different components and hands on only
the links that join some. So no pair that shares a band goes unseen, and the members of a
large component are not compared with each other again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.shared import kept_rows, rows_per_batch, shared_table, whole_text
from caravel.llm.simhash import RADIUS, SEED, components, links

SHINGLE = 5
#: Hundredths of the Jaccard similarity from which on two documents are near copies.
ALIKE = 80
BANDS, BAND_MINIMA = 20, 5
#: Members of a block.
BLOCK = 512
#: Pairs of sets of at least FEW shingles whose SimHashes differ in more bits are not
#: verified: 9.7 are expected at similarity 0.8 (deviation 2.9), 32 between strangers.
FAR_BITS, FEW = 22, 64
#: Bits of a shingle's hash that are kept for verifying; two sets of a thousand shingles have
#: one in common by chance in a million pairs.
KEPT_BITS = 40


def shingles(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of `shingle` words."""
    words = text.encode().lower().split()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + k]), seed) for i in range(len(words) - k + 1)] if words else [], np.uint64))


def packed(hashes: np.ndarray) -> bytes:
    """A set of shingles as the steps between its sorted hashes, cut to KEPT_BITS, byte by
    byte of equal weight, which compress well.
    """
    steps = np.diff(np.unique(hashes >> np.uint64(64 - KEPT_BITS)), prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEPT_BITS // 8].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    steps = np.zeros((len(raw) * 8 // KEPT_BITS, 8), np.uint8)
    steps[:, : KEPT_BITS // 8] = np.frombuffer(raw, np.uint8).reshape(KEPT_BITS // 8, -1).T
    return np.cumsum(steps.view("<u8")[:, 0])


def are_alike(a: np.ndarray, b: np.ndarray, alike: int) -> bool:
    """Whether two sets, sorted, have `alike` hundredths of Jaccard similarity or more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < alike * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum()) * (100 + alike) >= both * alike


def simhash_of(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes)).view(np.int64)[0])


def bands_of(hashes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A number for each band: a mix of its minima over the shingles under hash functions of
    their own, and of the band itself.
    """
    odd, plus = np.random.default_rng(seed).integers(0, 2**64, (2, BANDS * BAND_MINIMA), np.uint64)
    least = np.full(BANDS * BAND_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = (hashes[at : at + 1024, None] ^ plus) * (odd | np.uint64(1))
        x ^= x >> np.uint64(32)
        np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=least)
    mixed = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_MINIMA).T:
        mixed = (mixed ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def shingled(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """row, doc_id, text_sha256, same (a digest of the set of shingles), fp (its SimHash),
    bands and shingles (packed) of each row of `docs`.
    """
    rows_per_batch(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, text_sha256 string, same binary, fp bigint, bands array<bigint>, shingles binary"

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, shingle, seed) for t in batch.column(3).to_pylist()]
            made = [
                pa.array([xxhash.xxh128_digest(h.tobytes()) for h in own], pa.binary()),
                pa.array([simhash_of(h) for h in own], pa.int64()),
                pa.array([bands_of(h, seed) for h in own], pa.list_(pa.int64())),
                pa.array(map(packed, own), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["row", "doc_id", "text_sha256", "same", "fp", "bands", "shingles"])

    text = whole_text().cast("string")
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("text_sha256"), text.alias("text")).mapInArrow(make, schema)


def bucketed(nodes: DataFrame) -> DataFrame:
    """band, node, fp and lead (an order of the bucket's members that differs between
    buckets) of the members of buckets with more than one.
    """
    rows = nodes.select(F.explode("bands").alias("band"), "node", "fp")
    # written, so that the join has a plain table on both sides and Spark can split a large bucket
    several = shared_table(rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"), "full-bands")
    return rows.join(several, "band").select("band", "node", "fp", F.xxhash64("band", "node").alias("lead"))


def near(pairs: DataFrame) -> DataFrame:
    """Distinct pairs a < b of (node, fp, other, other_fp), without those far apart: the
    blocks come back to these if the sets are small.
    """
    close = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= FAR_BITS).filter("node <> other")
    return close.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def in_balls(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, fp, other, other_fp) by ball hashing: nodes of one SimHash with the first of
    them, and the firsts of SimHashes that are neighbours in a variant; a written table.
    """
    firsts = shared_table(nodes.groupBy("fp").agg(F.min("node").alias("other"), F.count("*").alias("n")), "simhashes")
    several = firsts.filter("n > 1").select("fp", "other")
    equal = nodes.select("node", "fp").join(several, "fp").select("node", "fp", "other", F.col("fp").alias("other_fp"))
    met = shared_table(links(firsts.select("fp"), radius), "ball-links")
    a = firsts.select(F.col("fp").alias("a"), F.col("other").alias("node"))
    b = firsts.select(F.col("fp").alias("b"), "other")
    apart = met.join(a, "a").join(b, "b").select("node", F.col("a").alias("fp"), "other", F.col("b").alias("other_fp"))
    return shared_table(equal.unionByName(apart).filter("node <> other"), "in-balls")


def candidates(buckets: DataFrame, balls: DataFrame) -> DataFrame:
    """Each member of a bucket with its first and with its neighbour, and who met in balls."""
    firsts = shared_table(buckets.groupBy("band").agg(F.min(F.struct("lead", "node", "fp")).alias("first")), "firsts")
    with_first = buckets.join(firsts, "band").select("node", "fp", F.col("first.node").alias("other"), F.col("first.fp").alias("other_fp"))
    # a bucket is dealt by the top bits of its members' SimHashes, so that a large one is not one group
    order = Window.partitionBy("band", F.shiftright("fp", 60)).orderBy("fp", "node")
    beside = buckets.select("node", "fp", F.lag("node").over(order).alias("other"), F.lag("fp").over(order).alias("other_fp")).filter("other is not null")
    return near(with_first.unionByName(beside).unionByName(balls))


def sets_of(prints: DataFrame, buckets: DataFrame, balls: DataFrame) -> DataFrame:
    """node and its packed shingles for all nodes in `buckets` and `balls`; a written table.
    A node is the row of its first document. The nodes grow with the input, so the join is
    one by shuffle at every size.
    """
    met = balls.select(F.explode(F.array("node", "other")).alias("node"))
    nodes = buckets.select("node").unionByName(met).distinct()
    return shared_table(prints.select(F.col("row").alias("node"), "shingles").join(nodes.hint("merge"), "node"), "candidate-sets")


def verified(sets: DataFrame, pairs: DataFrame, alike: int) -> DataFrame:
    """The pairs (a, b) of at least `alike` hundredths of Jaccard similarity; a written table."""
    rows_per_batch(sets.sparkSession)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("of_a", "of_b"))
            linked = [are_alike(unpacked(a), unpacked(b), alike) for a, b in zip(x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    pairs = shared_table(pairs, "candidates")
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))
    return shared_table(pairs.join(a, "a").join(b, "b").mapInArrow(judge, "a bigint, b bigint"), "links")


def blocks_of(buckets: DataFrame, roots: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(members, tasks) of the buckets with several components.

    members: band, of, k, node, root, fp. A component with more than `block` members in a
    bucket has blocks (of = its root, k) of its own; the others share blocks (of = -1).
    tasks: task, band, and the two blocks of, k and of_2, k_2; a block of several components
    is also set against itself, one of a single component never.
    """
    rooted = shared_table(buckets.join(roots, "node", "left").select("band", "node", "fp", F.coalesce("root", "node").alias("root")), "rooted")
    parts = shared_table(rooted.groupBy("band", "root").agg(F.count("*").alias("n")), "bucket-components")
    large = F.col("n") > block
    mixed = parts.groupBy("band").agg(F.count("*").alias("several"), F.sum(F.when(~large, F.col("n"))).alias("rest")).filter("several > 1")
    dealt = parts.join(mixed, "band").select("band", "root", F.when(large, F.col("root")).otherwise(-1).alias("of"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("rest")) / block).alias("ks"))
    dealt = shared_table(dealt, "mixed-components")
    key = F.when(F.col("of") < 0, F.xxhash64("root")).otherwise(F.xxhash64("node"))
    members = shared_table(rooted.join(dealt, ["band", "root"]).select("band", "of", F.pmod(key, "ks").alias("k"), "node", "root", "fp"), "mixed-members")
    blocks = shared_table(members.groupBy("band", "of", "k").agg(F.min("root").alias("low"), F.max("root").alias("high")), "blocks")
    other = blocks.select("band", F.col("of").alias("of_2"), F.col("k").alias("k_2"), F.col("low").alias("low_2"), F.col("high").alias("high_2"))
    met = blocks.join(other, "band").filter("(of < of_2 or (of = of_2 and k <= k_2)) and not (low = high and low_2 = high_2 and low = low_2)")
    tasks = met.select("band", "of", "k", "of_2", "k_2").withColumn("task", F.monotonically_increasing_id())
    return members, shared_table(tasks, "block-pairs")


def links_in_blocks(sets: DataFrame, members: DataFrame, tasks: DataFrame, alike: int) -> DataFrame:
    """Links (a, b) that join components within the tasks; a written table."""
    first = tasks.select("task", "band", "of", "k", F.when((F.col("of") == F.col("of_2")) & (F.col("k") == F.col("k_2")), 0).otherwise(1).alias("side"))
    second = tasks.select("task", "band", F.col("of").alias("of_1"), F.col("k").alias("k_1"), F.col("of_2").alias("of"), F.col("k_2").alias("k"), F.lit(2).alias("side")).filter("of <> of_1 or k <> k_1").drop("of_1", "k_1")
    rows = first.unionByName(second).join(members, ["band", "of", "k"]).join(sets, "node").select("task", "side", "node", "root", "fp", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        side, node, root, fp = (table.column(c).to_numpy() for c in ("side", "node", "root", "fp"))
        fp = fp.view(np.uint64)
        own = [unpacked(x.as_py()) for x in table.column("shingles")]
        size = np.fromiter(map(len, own), np.int64, len(own))
        found, at = [], np.unique(root, return_inverse=True)[1]
        for i in np.flatnonzero(side < 2):
            others = np.flatnonzero(side == 2) if side[i] else np.arange(i + 1, len(node))
            small = np.minimum(size[others], size[i]) < FEW
            fits = (at[others] != at[i]) & (100 * np.minimum(size[others], size[i]) >= alike * np.maximum(size[others], size[i]))
            for j in others[fits & (small | (np.bitwise_count(fp[others] ^ fp[i]) <= FAR_BITS))]:
                if at[i] != at[j] and are_alike(own[i], own[j], alike):
                    found.append((node[i], node[j]))
                    at[at == at[j]] = at[i]
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return shared_table(rows.groupBy("task").applyInArrow(compare, "a bigint, b bigint").distinct(), "block-links")


def joined_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """node and root after the links `more` (a, b): only the roots that they join are gone
    over again. A written table.
    """
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # a component's smallest node is no row of `roots`; it is its own root
    known = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    every = shared_table(ends.join(known, "node", "full_outer").select("node", F.coalesce("root", "node").alias("root")), "roots")
    of = lambda c: every.select(F.col("node").alias(c), F.col("root").alias(f"of_{c}"))
    between = more.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    above = components(between).select(F.col("node").alias("root"), F.col("root").alias("__above"))
    return shared_table(every.join(above, "root", "left").select("node", F.coalesce("__above", "root").alias("root")), "joined-roots")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, alike: int = ALIKE, seed: int = SEED, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """row, doc_id, text_sha256 and component (a row's number) of each row of `docs`
    (doc_id, text; further columns are left alone), over links of at least `alike`
    hundredths of Jaccard similarity. Null text counts as empty; texts without words are
    alike. Repeated rows and null ids are rows of their own; no rows give none.
    """
    prints = shared_table(shingled(docs, shingle, seed), "shingled")
    # documents of one set of shingles are one node
    least = [F.min_by(c, "row").alias(c) for c in ("fp", "bands")]
    same = shared_table(prints.groupBy("same").agg(F.min("row").alias("node"), *least), "shingle-sets")
    buckets = shared_table(bucketed(same), "buckets")
    balls = in_balls(same, radius)
    sets = sets_of(prints, buckets, balls)
    roots = components(verified(sets, candidates(buckets, balls), alike))
    members, tasks = blocks_of(buckets, roots, block)
    roots = joined_roots(roots, links_in_blocks(sets, members, tasks, alike))
    named = same.join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("component"))
    return prints.select("row", "doc_id", "text_sha256", "same").join(named, "same").drop("same")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, alike: int = ALIKE, seed: int = SEED) -> DataFrame:
    """The rows of `docs` with exactly one row of each component, that of its smallest
    doc_id (nulls last). Rows are told apart by doc_id and text; of those with both the
    same, any one stays.
    """
    found = shared_table(near_copies(docs, shingle, alike, seed), "near-copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256", "row")).alias("first")
    groups = shared_table(found.groupBy("component").agg(first, F.count("*").alias("size")).filter("size > 1"), "near-groups")
    decided = found.join(groups, "component").select("doc_id", "text_sha256", (F.col("row") == F.col("first.row")).alias("kept"))
    return kept_rows(docs, decided, F.sha2(whole_text().cast("string"), 256))
