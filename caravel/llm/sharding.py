"""Sharding by balanced label propagation, with row counts at most one apart.

Linked documents begin in shards by a hash and move, round by round, to the shard most
of their neighbours are in, as far as its quota allows: between two shards as many go as
come, and beyond that a shard takes no more linked documents than its final size. A hash
of the round lets half of those that wish to move, so that two neighbours do not swap
places for ever. Rounds go on until two in a row cut no fewer links, or to ROUNDS of them;
the places with the fewest cut links are taken. Documents without links, and those beyond a quota, then fill
the shards to exactly their sizes.

Votes are counts by (document, shard) that merge on the map side. Quotas and fills use
ranks from per-bucket counts, so no shard's rows meet in one task; a hub of links is
one row a neighbour in joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.shared import forget, gapless_rank, shared_table, whole_text

SHARDS = 24
#: Rows of one shard, or of one group of copies, that are ranked in one bucket, until there
#: are so many buckets: their sizes are summed in one task, so they may not grow with the rows.
BUCKET_ROWS, BUCKETS = 200, 4096
#: Rounds at most. They only make the cut smaller; sizes are exact after any number.
ROUNDS = 12


def sized(docs: DataFrame) -> DataFrame:
    """A written narrow table: row (a unique number), doc_id, size, text_crc32, and the
    text's SHA-256 `same`. Null text counts as empty.
    """
    raw = F.encode(whole_text(), "UTF-8")
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.octet_length(whole_text()).cast("bigint") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.sha2(raw, 256).alias("same"),
    )
    return shared_table(narrow, "sized")


def buckets_for(rows: int) -> int:
    return min(1 + rows // BUCKET_ROWS, BUCKETS)


def links_of_copies(rows: DataFrame, most: int) -> DataFrame:
    """Links (row, other) of rows with equal `same`: each to the first of its group, not to
    each other. A group larger than `most` (a shard) is taken in chunks; each row is linked
    to the first of its chunk, and that to the first of the chunk before.
    """
    # written, so that the join has a plain table on both sides and Spark can split a large group
    groups = shared_table(rows.groupBy("same").agg(F.count("*").alias("members")).filter("members > 1"), "groups")
    members = shared_table(rows.join(groups, "same").select("row", "same", "members"), "copies")
    largest = members.agg(F.max("members")).first()[0] or 0
    ranked = gapless_rank(members, ["same"], ["row"], buckets_for(largest))
    chunked = shared_table(ranked.select("row", "same", F.floor(F.col("rank") / max(most, 1)).alias("chunk")), "chunks")
    firsts = shared_table(chunked.groupBy("same", "chunk").agg(F.min("row").alias("other")), "chunk-firsts")
    within = chunked.join(firsts, ["same", "chunk"]).filter("row != other").select("row", "other")
    before = firsts.select("same", (F.col("chunk") + 1).alias("chunk"), F.col("other").alias("before"))
    return within.unionByName(firsts.join(before, ["same", "chunk"]).select(F.col("other").alias("row"), F.col("before").alias("other")))


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _by_shard(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])[F.col("shard")]


def cut_links(places: DataFrame, links: DataFrame) -> DataFrame:
    """One row: links, and cut, those of them (row, other) between two shards."""
    shard = lambda c: places.select(F.col("row").alias(c), F.col("shard").alias(f"of_{c}"))
    both = links.join(shard("row"), "row").join(shard("other"), "other")
    return both.agg(F.count("*").alias("links"), F.coalesce(F.sum((F.col("of_row") != F.col("of_other")).cast("bigint")), F.lit(0)).alias("cut"))


def wishes_of(both: DataFrame, placed: DataFrame) -> DataFrame:
    """A written table of row, shard, `to` (the shard of most neighbours; of equal ones its
    own, then the lowest) and cut (its neighbours in other shards).
    """
    where = placed.select(F.col("row").alias("other"), F.col("shard").alias("at"))
    votes = both.join(where, "other").groupBy("row", "at").agg(F.count("*").alias("votes"))
    here = F.col("at") == F.col("shard")
    best = votes.join(placed, "row").groupBy("row", "shard").agg(
        F.max(F.struct("votes", here.alias("here"), (-F.col("at")).alias("low"))).alias("best"),
        F.sum(F.when(here, 0).otherwise(F.col("votes"))).alias("cut"),
    )
    return shared_table(best.select("row", "shard", (-F.col("best.low")).alias("to"), "cut"), "wishes")


def quotas(asked: dict[tuple[int, int], int], free: list[int]) -> list[int]:
    """How many may go from each shard to each other, in order of (from, to): as many as
    come the other way, and then as far as the other has places free.
    """
    shards, left = len(free), list(free)
    moves = []
    for s in range(shards):
        for t in range(shards):
            wish, back = asked.get((s, t), 0), asked.get((t, s), 0)
            more = max(0, min(wish - back, left[t]))
            left[t] -= more
            moves.append(min(wish, back) + more)
    return moves


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """row, shard and slot (gapless from 0 in its shard) of each of `rows` (row, unique; a
    written table), for undirected `links` (row, other). No rows give no shards; repeated
    links count once.
    """
    total = rows.count()
    sizes = shard_sizes(total, shards)
    buckets = buckets_for(max(sizes))
    both = shared_table(links.select("row", "other").unionByName(links.select(F.col("other").alias("row"), F.col("row").alias("other"))).distinct(), "links")
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    placed = lowest = shared_table(both.select("row").distinct().select("row", start), "placed")
    fewest, idle = None, 0
    for turn in range(rounds + 1):
        wishes = wishes_of(both, placed)
        cut = wishes.agg(F.sum("cut")).first()[0] or 0
        if fewest is None or cut < fewest:
            if lowest is not placed:
                forget(lowest)
            lowest, fewest, idle = placed, cut, 0
        else:
            idle += 1
        if idle == 2 or cut == 0 or turn == rounds:
            break
        load = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        half = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(2)) == 0
        wish = shared_table(wishes.filter((F.col("to") != F.col("shard")) & half).select("row", "shard", "to"), "moving")
        asked = {(r.shard, r.to): r.n for r in wish.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}  # shards x shards rows at most
        quota = F.array(*[F.lit(n) for n in quotas(asked, [size - load.get(s, 0) for s, size in enumerate(sizes)])])[F.col("shard") * shards + F.col("to")]
        allowed = gapless_rank(wish, ["shard", "to"], ["row"], buckets).filter(F.col("rank") < quota)
        moved = shared_table(allowed.select("row", "to"), "moves")
        past, placed = placed, shared_table(placed.join(moved, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")), "placed")
        forget(wishes, wish, moved, *([past] if past is not lowest else []))
    placed = lowest
    ranked = gapless_rank(placed, ["shard"], ["row"], buckets)
    kept = shared_table(ranked.filter(F.col("rank") < _by_shard(sizes)).select("row", "shard", F.col("rank").alias("slot")), "kept")
    load = {r.shard: r.n for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = [size - load.get(s, 0) for s, size in enumerate(sizes)]
    rest = shared_table(rows.join(kept, "row", "left_anti").select(F.lit(0).alias("all"), "row"), "rest")
    numbered = gapless_rank(rest, ["all"], ["row"], buckets_for(sum(free)))
    begins = [sum(free[:s]) for s in range(shards)]
    # the last shard whose free places begin at or before this number, and its place there
    shard = F.size(F.filter(F.array(*[F.lit(b) for b in begins]), lambda b: b <= F.col("rank"))) - 1
    fill = numbered.select("row", shard.alias("shard"), "rank")
    slot = F.col("rank") - _by_shard(begins) + _by_shard([load.get(s, 0) for s in range(shards)])
    return kept.unionByName(fill.select("row", "shard", slot.alias("slot")))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard and slot of each
    row of `docs` (doc_id, text; further columns are left alone); documents of equal texts
    are linked, null texts with empty ones.

    Every row has its place, rows of null and repeated doc_ids too; no rows give none.
    """
    rows = sized(docs)
    most = max(shard_sizes(rows.count(), shards), default=0)
    places = balanced_shards(rows.select("row"), links_of_copies(rows, most), shards)
    return rows.join(places, "row").select("doc_id", "size", "text_crc32", "shard", "slot")
