"""Writes that can be repeated: keyed upserts, replaced windows, refreshed partitions,
bounded exports. A table is a Parquet folder; a changed table is written beside and
returned, so a lost run leaves the old one whole.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key of a batch: the last by `order`."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return batch.withColumn("__n", n).filter("__n = 1").drop("__n")


def upserted(table: DataFrame, batch: DataFrame, key: list[str], order: str, merge_json: tuple[str, ...] = ()) -> DataFrame:
    """`table` after the batch: new keys added, changed rows replaced where a column differs
    null-safely, columns that the batch lacks kept; `merge_json` columns (objects) keep the
    old keys that the new object lacks. `changed` says which rows the batch touched.
    """
    new = last_wins(batch, key, order)
    cols = [c for c in table.columns if c not in key]
    right = new.select(*[F.col(k).alias(f"__k_{k}") for k in key], *[F.col(c).alias(f"__{c}") for c in cols if c in new.columns], F.lit(True).alias("__in"))
    both = table.withColumn("__was", F.lit(True)).join(right, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k_{k}") for k in key]), "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        fresh = F.col(f"__{c}")
        if c in merge_json:
            read = lambda x: F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>"))
            fresh = F.to_json(F.map_concat(F.map_filter(read(F.col(c)), lambda k, _: ~F.map_contains_key(read(F.col(f"__{c}")), k)), read(F.col(f"__{c}"))))
        return F.when(F.col("__in"), fresh).otherwise(F.col(c))

    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols if c in new.columns], F.lit(False))
    changed = F.coalesce(F.col("__in") & (F.col("__was").isNull() | differs), F.lit(False))
    return both.select(*[F.coalesce(F.col(k), F.col(f"__k_{k}")).alias(k) for k in key], *[value(c).alias(c) for c in cols], changed.alias("changed"))


def replaced_window(table: DataFrame, fresh: DataFrame, inside: Column) -> DataFrame:
    """`table` with the rows of one window (`inside`) replaced by fresh ones."""
    return table.filter(~F.coalesce(inside, F.lit(False))).unionByName(fresh)


def swept(segments: DataFrame, key: str = "plate") -> DataFrame:
    """Without segments that lie within a longer one of the same car: one that began earlier
    and ends no earlier, or began with it and ends later.
    """
    earlier = Window.partitionBy(key).orderBy(F.unix_micros(F.col("start").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    reach, longest = F.max("end").over(earlier), F.max("end").over(Window.partitionBy(key, "start"))
    marked = segments.withColumn("__within", F.coalesce(reach >= F.col("end"), F.lit(False)) | (longest > F.col("end")))
    return marked.filter(~F.col("__within")).drop("__within")


def replaced_day(landings: DataFrame, fresh: DataFrame, day: Column) -> DataFrame:
    """A day's landings after a pull of it: rows that it no longer returns go."""
    gone = landings.filter(F.to_date("landed_at") == day).join(fresh, ["icao24", "landed_at"], "left_anti").select("icao24", "landed_at")
    kept = landings.join(gone, ["icao24", "landed_at"], "left_anti").join(fresh, ["icao24", "landed_at"], "left_anti")
    return kept.unionByName(fresh)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that `df` has rows for are replaced; the rest stay."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def fitting_days(rows: DataFrame, day: str, limit: int) -> DataFrame:
    """Days of the longest recent suffix whose rows stay within a limit: day, n, running."""
    counts = rows.groupBy(day).agg(F.count("*").alias("n"))
    return counts.withColumn("running", F.sum("n").over(Window.orderBy(F.desc(day)))).filter(F.col("running") <= limit)


def export_csv(rows: DataFrame, path: str, limit: int) -> int:
    """A headed CSV of the rows; more than `limit` of them are refused, not cut."""
    n = rows.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"over {limit} rows; ask for fewer days")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return n


def workbook(rows: DataFrame, limit: int = 50_000) -> bytes:
    """A workbook of one sheet; more than `limit` rows are refused."""
    body = rows.limit(limit + 1).collect()
    if len(body) > limit:
        raise ValueError(f"over {limit} rows")
    return book_of(rows.columns, body)


def workbooks(rows: DataFrame, by: str, order: list[str], limit: int = 50_000) -> DataFrame:
    """path and content of a workbook for each value of `by`, with the other columns of its
    rows in the order of `order`. Each is built in a task, which reads its rows sorted, one
    workbook after another; more than `limit` rows are refused.
    """
    columns = [c for c in rows.columns if c != by]

    def book(name, body: list[tuple]) -> tuple[str, bytes]:
        return f"{name}.xlsx", book_of(columns, body)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, body = None, []
        for batch in batches:
            done = []
            for of, *row in zip(*(batch.column(c).to_pylist() for c in (by, *columns))):
                if body and of != name:
                    done.append(book(name, body))
                    body = []
                name = of
                body.append(tuple(row))
                if len(body) > limit:
                    raise ValueError(f"over {limit} rows")
            yield told(done)
        yield told([book(name, body)] if body else [])

    def told(done: list[tuple[str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.binary())], ["path", "content"])

    dealt = rows.repartition(by).sortWithinPartitions(by, *[F.asc_nulls_last(c) for c in order])
    return dealt.mapInArrow(build, "path string, content binary")


def book_of(columns: list[str], body: Sequence[tuple]) -> bytes:
    """A workbook of one sheet with a head."""

    def letters(n: int) -> str:
        return (letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26)

    def cell(at: str, v) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}"/>' if v is None else f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    names = [letters(i) for i in range(1, len(columns) + 1)]
    lines = [f'<row r="{n}">{"".join(cell(f"{c}{n}", v) for c, v in zip(names, row))}</row>' for n, row in enumerate([columns, *body], 1)]
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            kind = zipfile.ZIP_DEFLATED if "sheets/" in name else zipfile.ZIP_STORED  # the others are short
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}', kind)
    return out.getvalue()


class ResultCache:
    """Results by name and version of the data, kept as persisted frames; the oldest go
    first when there are more than `size`.
    """

    def __init__(self, size: int = 16):
        self.size, self.kept = size, {}

    def get(self, name: str, version: str, build) -> DataFrame:
        key = (name, version)
        if key in self.kept:
            self.kept[key] = self.kept.pop(key)
        else:
            self.kept[key] = build().persist()
            while len(self.kept) > self.size:
                self.kept.pop(next(iter(self.kept))).unpersist()
        return self.kept[key]
