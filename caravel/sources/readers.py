"""Feeds as frames: files landed by a pull, read with a schema and shaped into rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SourceSpec:
    """A feed: where its files land, how they are read, what they become."""

    name: str
    path: str
    format: str = "json"
    schema: str | None = None
    options: dict = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        return (reader.schema(self.schema) if self.schema else reader).load(self.path)


def csv_trips(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report's CSV by its header; values that don't fit their type are null."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def csv_payments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions (trip_id, kind, fare, earnings, fee, cash, tip) as payments by trip and
    settlements: rows without a trip, and payouts. Sums of nothing stay null; adjustments
    are summed apart.
    """
    settled = F.col("trip_id").isNull() | (F.trim("trip_id") == "") | F.coalesce(F.lower("kind").contains("payout"), F.lit(False))
    adjust = F.coalesce(F.lower("kind").contains("adjust"), F.lit(False))
    sums = [F.sum(F.when(~adjust, F.col(c))).alias(c) for c in ("fare", "earnings", "fee", "cash", "tip")]
    trips = rows.filter(~settled).groupBy("trip_id").agg(*sums, F.sum(F.when(adjust, F.col("earnings"))).alias("adjustments"))
    return trips, rows.filter(settled)


def pivoted(tables: DataFrame, columns: str = "columns") -> DataFrame:
    """A provider's column-major tables, array<struct<key, cells>>, as rows of a map: one table
    a row of `tables`, whose other columns stay beside each line.
    """
    keys, n = F.col(columns)["key"], F.array_max(F.transform(F.col(columns), lambda c: F.size(c["cells"])))
    lines = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.map_from_arrays(keys, F.transform(F.col(columns), lambda c: F.get(c["cells"], i))))
    return tables.filter(n > 0).select(*[c for c in tables.columns if c != columns], F.posexplode(lines).alias("row", "cells"))


def timeline_rows(events: DataFrame) -> DataFrame:
    """Status rows of a timeline and a job row for each nested stateChange; of equal
    (driver, at, kind, status, state) one stays. `events`: driver, timestamp (ms), status,
    jobuuid, stateChange array<struct<timestamp, type>>.
    """
    at = lambda ms: F.timestamp_millis(ms)
    status = events.select("driver", at(F.col("timestamp")).alias("at"), F.lit("status").alias("kind"), "status", F.lit(None).cast("string").alias("state"), "jobuuid")
    jobs = events.select("driver", "jobuuid", "status", F.explode("stateChange").alias("c"))
    jobs = jobs.select("driver", at(F.col("c.timestamp")).alias("at"), F.lit("job").alias("kind"), "status", F.col("c.type").alias("state"), "jobuuid")
    return status.unionByName(jobs).dropDuplicates(["driver", "at", "kind", "status", "state"])


def status_rows(overviews: DataFrame, seen_at: Column) -> DataFrame:
    """Current states and changes at the provider's own instant, the sighting's where none
    is given. `overviews`: driver, status, changed_at, changes array<struct<at, status>>.
    """
    now = overviews.select("driver", F.coalesce("changed_at", seen_at).alias("at"), "status")
    past = overviews.select("driver", F.explode("changes").alias("c")).select("driver", "c.at", "c.status")
    return now.unionByName(past).filter("status is not null").dropDuplicates(["driver", "at", "status"])


def flattened(breakdowns: DataFrame, key: str, nodes: str, depth: int = 9) -> DataFrame:
    """A tree of amounts as key, path, amount, mixed_currency; siblings of one name are
    summed, and a node without a name goes with all below it. `nodes` is a JSON array of
    {name, amount, currency, children}, read to `depth` levels.
    """
    schema = "array<struct<name:string,amount:double,currency:string,children:string>>"
    up = lambda under, n: F.trim(n["name"]) if under is None else F.concat_ws(".", under["path"], F.trim(n["name"]))
    node = lambda under, n: F.struct(up(under, n).alias("path"), n["amount"].alias("amount"), n["currency"].alias("currency"), n["children"].alias("children"))

    def level(text: Column, under: Column | None = None) -> Column:
        named = F.filter(F.coalesce(F.from_json(text, schema), F.array().cast(schema)), lambda n: F.trim(n["name"]) != "")
        return F.transform(named, lambda n: node(under, n))

    # every tree is read once, level by level within its row
    rows = breakdowns.select(key, level(F.col(nodes)).alias("l1"))
    for i in range(2, depth + 1):
        above = F.filter(f"l{i - 1}", lambda n: n["children"].isNotNull())
        rows = rows.withColumn(f"l{i}", F.flatten(F.transform(above, lambda n: level(n["children"], n))))
    found = rows.select(key, F.explode(F.concat(*[f"l{i}" for i in range(1, depth + 1)])).alias("n")).select(key, "n.path", "n.amount", "n.currency")
    paths = found.groupBy(key, "path").agg(F.sum("amount").alias("amount"), F.min("currency").alias("__least"), F.max("currency").alias("__most"))
    whole = Window.partitionBy(key)
    mixed = F.coalesce(F.min("__least").over(whole) != F.max("__most").over(whole), F.lit(False))
    return paths.withColumn("mixed_currency", mixed).filter("amount is not null").select(key, "path", "amount", "mixed_currency")


def plan_days(spark: SparkSession, lo: date, hi: date, airports: list[str], covered: DataFrame) -> DataFrame:
    """Days and airports that no complete pull covers (airport, day, complete)."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(DATE '{lo}', DATE '{hi}')")).alias("day"))
    wanted = days.select("day", F.explode(F.array(*map(F.lit, airports))).alias("airport"))
    return wanted.join(covered.filter("complete"), ["airport", "day"], "left_anti")


def parameter_rows(spark: SparkSession, **columns: list) -> DataFrame:
    """Arrays of parameters as a relation with their order."""
    names = list(columns)
    return spark.createDataFrame([Row(n=i, **dict(zip(names, row))) for i, row in enumerate(zip(*columns.values()), 1)])


def paged(spark: SparkSession, fetch: Callable[[int, int], list[dict]], total: int, page_size: int, schema: str) -> DataFrame:
    """All rows of a paged API: each page is pulled by `fetch(first, size)` in the task that
    holds it, so a lost executor pulls its pages again and nothing passes the driver.
    """
    pages = spark.range(0, -(-total // page_size), 1, max(1, -(-total // page_size)))

    def pull(batches):
        import pandas as pd

        for batch in batches:
            for page in batch["id"]:
                yield pd.DataFrame(fetch(int(page) * page_size, page_size))

    return pages.mapInPandas(pull, schema)


NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
EPOCH = date(1899, 12, 30)


def _cells(book: bytes) -> Iterator[tuple[str, int, int, str | None]]:
    """(sheet, row, column, text) of each cell of a workbook."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/\w+\.xml", n)):
            for cell in ElementTree.fromstring(z.read(name)).iter(f"{NS}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                column = 0
                for c in letters:
                    column = column * 26 + ord(c) - 64
                value = cell.find(f"{NS}v")
                text = None if value is None else value.text
                if cell.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                elif cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{NS}t"))
                yield name.rsplit("/", 1)[1][:-4], int(row), column, text


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, column, text of all workbooks under a path: one file, one task."""
    return cells_of(spark.read.format("binaryFile").load(path))


def cells_of(files: DataFrame) -> DataFrame:
    """The same of workbooks that are rows (path, content)."""

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = [(p, *cell) for p, content in zip(batch["path"], batch["content"]) for cell in _cells(content)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "column", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, row bigint, column bigint, text string")


def headed_rows(cells: DataFrame, header: list[str]) -> DataFrame:
    """Rows of sheets whose first row is exactly `header`; other sheets give none. The cells
    are asked for once, so no workbook is read again for its head.
    """
    head = F.array_sort(F.collect_list(F.when(F.col("row") == 1, F.struct("column", "text"))))
    rows = cells.filter("row >= 1").groupBy("path", "sheet", "row").agg(*[F.max(F.when(F.col("column") == i, F.col("text"))).alias(h) for i, h in enumerate(header, 1)], head.alias("__head"))
    of_sheet = F.max(F.when(F.col("row") == 1, F.col("__head"))).over(Window.partitionBy("path", "sheet"))
    fits = F.transform("__of", lambda x: F.trim(x["text"])) == F.array(*map(F.lit, header))
    return rows.withColumn("__of", of_sheet).filter(fits).filter("row > 1").drop("__head", "__of")


def sheet_date(serial: Column) -> Column:
    """A workbook's day number as a date."""
    return F.date_add(F.lit(EPOCH), serial.cast("int"))


def statement_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pasted statement rows (line, day, amount as text) as valid rows and refused rows with
    the reason.
    """
    day, amount = F.try_to_date("day", "yyyy-MM-dd"), F.regexp_replace("amount", ",", "").try_cast("decimal(14,2)")
    reason = F.when(day.isNull(), "bad_day").when(amount.isNull(), "bad_amount")
    read = lines.select("*", day.alias("on"), amount.alias("value"), reason.alias("reason"))
    return read.filter("reason is null").select("line", "on", "value"), read.filter("reason is not null").select("line", "day", "amount", "reason")


def chunk(lo: date, hi: date, days: int) -> list[tuple[date, date]]:
    return [(lo + timedelta(days=i), min(hi, lo + timedelta(days=i + days - 1))) for i in range(0, (hi - lo).days + 1, days)]
