"""Concatenate and cut: all documents' ids form one long row, cut every `seq_len` ids.

Pass one tokenises each document once and writes its ids with the running total of its
partition. The partitions' totals (one number each) are summed into the global offset
of every partition. Pass two reads the table, adds the offset and cuts each document at
the multiples of `seq_len`; a document over a boundary leaves a record on either side.
Nothing is shuffled but the totals, and only the last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.shared import rows_per_batch, shared_table
from caravel.llm.tokens import encoder, tokenised

SEQ_LEN = 4096


def packed(docs: DataFrame, vocabulary: str, seq_len: int = SEQ_LEN, last_id: int = 2) -> DataFrame:
    """One row for each piece: doc_id, start (the document's ids before it), length,
    doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit).

    Every row of `docs` (doc_id, text) is packed, repeated and null doc_ids too; null
    text counts as empty, an empty text is its last id alone. Documents follow each
    other in the order of the input's partitions. No rows give no pieces.
    """
    table = shared_table(tokenised(docs, vocabulary, last_id), "token-ids")
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # one row for each partition: bounded by the number of partitions
    placed = table.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n_ids", "ids")
    rows_per_batch(docs.sparkSession)
    schema = "doc_id {}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary".format(
        docs.schema["doc_id"].dataType.simpleString()
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(vocabulary).dtype
        for batch in batches:
            rows, starts, lengths, totals, places, ids = [], [], [], [], [], []
            for row, (at, n, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("at", "n_ids", "ids")))):
                own = np.frombuffer(raw, width).astype("<u4")
                edges = [at, *range((at // seq_len + 1) * seq_len, at + n, seq_len), at + n]
                for a, b in zip(edges, edges[1:]):
                    rows.append(row)
                    starts.append(a - at)
                    lengths.append(b - a)
                    totals.append(n)
                    places.append(a)
                    ids.append(own[a - at : b - at].tobytes())
            at = np.array(places, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array(at // seq_len),
                    pa.array(at % seq_len),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return placed.mapInArrow(cut, schema)
