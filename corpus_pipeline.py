"""The corpus pipeline: what a training corpus goes through, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, whole and with
the columns of `documents`; the last returns the packed pieces. run() writes what each
stage returns in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.llm import decontamination, exact_dedup, near_copies, packing, toxicity
from caravel.llm.queries import held_out, vocabulary
from caravel.llm.shared import read, shared_table

#: A document of this score or more goes.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the score, with the chains fitted on the labels that may be used."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    return toxicity.without_toxic(docs, model, TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null: empty), the one with the smallest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more) the
    document with the smallest doc_id; texts without words are one component.
    """
    return near_copies.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands; null texts have none."""
    return decontamination.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left; a null text is its last id alone."""
    pieces = packing.packed(docs, vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The chains, the components and the places in partition order have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
