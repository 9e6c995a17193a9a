"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of code points. Distinct blocks are sorted
into integer names; then adjacent names are paired, distinct pairs are sorted into
integer names, and so on until one name is left of each document. Equal names at the
end mean equal texts and nothing else: no step trusts a hash.

The block contents cross the network once, as distinct blocks after a map-side merge,
under a 64-bit key. How many contents a key has is counted, not assumed: those of a key
that has several (at 10^10 blocks a few dozen keys do) are numbered in their order, and
only these few are looked up by content. From there on, rows are narrow: keys with
numbers, positions and names. A group of copies, however large, meets only in
aggregations that merge on the map side and in joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.shared import integer_names, kept_rows, shared_table, whole_text

BLOCK = 4096
#: Marks the missing right half of the last pair of an odd row of names; names are >= 0.
NONE = -1


def normalised(text: Column) -> Column:
    """Each run of the characters 09-0D and 20 becomes one space; the pattern leaves out
    the single space, which would be replaced by itself.
    """
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def blocks_of(text: Column, block: int) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.length(text) <= block, F.array(text)).otherwise(cut)


def _named_blocks(texts: DataFrame, block: int, key_bits: int) -> tuple[DataFrame, DataFrame]:
    """The documents' blocks (row, doc_id, text_sha256, blocks, at, key, nth), and the names of
    (key, nth): a key's nth content.
    """
    key = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - key_bits)
    contents = texts.select(F.explode(blocks_of(F.col("norm"), block)).alias("block")).withColumn("key", key("block"))
    keys = shared_table(contents.groupBy("key", "block").agg(F.count("*").alias("copies")).groupBy("key").agg(F.count("*").alias("contents")), "block-keys")
    row = F.monotonically_increasing_id().alias("row")
    spread = texts.select(row, "doc_id", F.sha2("norm", 256).alias("text_sha256"), blocks_of(F.col("norm"), block).alias("cut"))
    spread = spread.select("row", "doc_id", "text_sha256", F.size("cut").alias("blocks"), F.posexplode("cut").alias("at", "block")).withColumn("key", key("block"))
    shared = keys.filter("contents > 1").select("key")
    if shared.isEmpty():
        spread = spread.withColumn("nth", F.lit(0))
    else:
        # the contents of the few keys that have several; Spark broadcasts this table only if it is small
        few = contents.join(shared, "key").distinct()
        nth = (F.row_number().over(Window.partitionBy("key").orderBy("block")) - 1).alias("nth")
        few = shared_table(few.select("key", "block", nth), "shared-keys")
        spread = spread.join(few, ["key", "block"], "left").withColumn("nth", F.coalesce("nth", F.lit(0)))
    blocks = shared_table(spread.select("row", "doc_id", "text_sha256", "blocks", F.col("at").cast("long").alias("at"), "key", "nth"), "block-docs")
    names = keys.select("key", F.explode(F.sequence(F.lit(0), F.col("contents").cast("int") - 1)).alias("nth"))
    return blocks, integer_names(names, "block-names")


def exact_identities(docs: DataFrame, block: int = BLOCK, key_bits: int = 64) -> DataFrame:
    """row, doc_id, text_sha256 and `identity` (an integer, equal for equal normalised
    texts only) of each row of `docs` (doc_id, text; further columns are left alone).
    Null texts count as empty; null or repeated doc_ids are kept as rows of their own.
    """
    texts = docs.select("doc_id", normalised(whole_text()).alias("norm"))
    spread, names = _named_blocks(texts, block, key_bits)
    named = shared_table(spread.join(names, ["key", "nth"]).select("row", "blocks", "at", "name"), "level-0")
    done = [named.filter("blocks = 1").select("row", "blocks", "name")]
    longest = named.agg(F.max("blocks")).first()[0] or 0
    width, active = 1, named.filter("blocks > 1")
    while width < longest:
        width *= 2
        half = F.col("at") % 2
        pairs = active.groupBy("row", "blocks", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(NONE)).alias("right"),
        )
        pairs = shared_table(pairs, f"pairs-{width}")
        names = integer_names(pairs.select("left", "right").distinct(), f"names-{width}")
        level = shared_table(pairs.join(names, ["left", "right"]).select("row", "blocks", "at", "name"), f"level-{width}")
        done.append(level.filter(F.col("blocks") <= width).select("row", "blocks", "name"))
        active = level.filter(F.col("blocks") > width)
    last = done[0]
    for one in done[1:]:
        last = last.unionByName(one)
    # documents of as many blocks end at the same level: the pair tells all texts apart
    last = last.withColumnRenamed("name", "last")
    identities = integer_names(last.select("blocks", "last").distinct(), "identities").withColumnRenamed("name", "identity")
    rows = last.join(identities, ["blocks", "last"]).select("row", "identity")
    return spread.filter("at = 0").select("row", "doc_id", "text_sha256").join(rows, "row")


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256,
    identity. Of equal texts the row of the smallest doc_id stays (null doc_ids last);
    of rows that repeat that doc_id, exactly one.
    """
    found = shared_table(exact_identities(docs, block), "identified")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    # written, so that the join below has a plain table on both sides: Spark then splits the
    # rows of a large group, which it cannot do where it reuses the aggregate's partitioning
    groups = shared_table(found.groupBy("identity").agg(first, F.count("*").alias("group_size")), "groups")
    return found.join(groups, "identity").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        "identity",
    )


def drop_exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of `docs` that stay, with all their columns (of any type) and whole texts. Of
    rows with the same doc_id and text, which no key tells apart, any one stays. Null texts
    count as empty; no rows give none.
    """
    decided = exact_dedup(docs, block).select("doc_id", "text_sha256", "kept")
    return kept_rows(docs, decided, F.sha2(normalised(whole_text()), 256))
