"""What several corpus operators share: tables in the cluster's shared folder and
integer names and ranks that are found without one task seeing all rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Index bits of monotonically_increasing_id below the partition number.
ID_BITS = 33


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, under the
    application's id. Only a session on one machine may leave it unset; it gets a folder of
    its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return f"{folder}/{sc.applicationId}"


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again. Cuts the
    lineage, survives lost executors, freezes ids that depend on partitions, and tells
    the planner the table's real size, which its broadcast threshold then checks.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later result is read from: those of past rounds."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def rows_per_batch(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of one Arrow batch, so that very long texts fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def integer_names(keys: DataFrame, label: str) -> DataFrame:
    """A gapless integer `name` from 0 for each row of `keys` (distinct, orderable), in
    the order of all its columns.

    Range partitions are sorted, written with (partition, index), and the partitions'
    counts (one row a partition) are summed into offsets; no task sees all keys.
    """
    cols = keys.columns
    spot = F.monotonically_increasing_id()
    placed = shared_table(keys.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__spot", spot), label)
    part = F.shiftright("__spot", ID_BITS)
    totals = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    index = F.col("__spot").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    # one row for each partition of the range sort: bounded by the number of partitions
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").select(*cols, (F.col("__offset") + index).alias("name"))


def gapless_rank(df: DataFrame, key: list[str], order: list[str], buckets: int, out: str = "rank") -> DataFrame:
    """`df` with the row's gapless rank from 0 within `key`. Each key's rows are dealt
    over `buckets` by a hash of `order` (unique within the key); the rank is the row's
    place in its bucket plus the sizes of the buckets before it. No group that grows
    with a key meets in one task; only counts (keys x buckets rows) are summed.

    `df` is read twice and so should be a written table.
    """
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by = [*key, "__bucket"]
    sizes = dealt.groupBy(*by).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return dealt.withColumn("__place", place).join(offsets, by).withColumn(out, F.col("__offset") + F.col("__place")).drop("__bucket", "__place", "__offset")


def whole_text(name: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def kept_rows(docs: DataFrame, decided: DataFrame, sha: Column) -> DataFrame:
    """The rows of `docs` for `decided` (doc_id, text_sha256, kept), a row for each row that
    was judged: rows that no decision names or all keep stay whole; of rows with the same
    doc_id and text, one stays if any is kept.

    The join is one by shuffle at every size: what it drops grows with the input, and a
    broadcast that holds on small inputs only would hide that.
    """
    keys = decided.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("__stays"), F.count("*").alias("__times"))
    odd = shared_table(keys.filter("not __stays or __times > 1"), "dropped-or-repeated")
    odd = odd.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha256"), "__stays").hint("merge")
    named = docs.withColumn("__sha", sha)
    met = named.join(odd, named["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__sha256")), "left")
    single = met.filter("__stays is null").select(*[F.col(f"`{c}`") for c in docs.columns])
    if odd.filter("__stays").isEmpty():
        return single
    # a row's number is enough to choose by, whatever types the columns have
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    again = met.filter("__stays").select("__id", "__sha", F.monotonically_increasing_id().alias("__row"), whole)
    one = again.groupBy("__id", "__sha").agg(F.min_by("whole", "__row").alias("whole"))
    return single.unionByName(one.select("whole.*"))
