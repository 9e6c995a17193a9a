"""Partial refreshes: cutoffs snapped to buckets, superseded live rows, settled verdicts,
finished units of a backfill.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.operators.intervals import thinned
from caravel.operators.joins import asof_nearest


def snap(since: date, grain: str) -> date:
    """A cutoff moved back to its bucket's first day, so that no bucket is derived in part."""
    return since - timedelta(days=since.weekday()) if grain == "week" else since.replace(day=1) if grain == "month" else since


def refreshed(table: DataFrame, fresh: DataFrame, bucket: str, since: date) -> DataFrame:
    """A roll-up with all buckets from the cutoff on taken from `fresh`, empty ones gone."""
    cut = F.lit(since)
    return table.filter(F.col(bucket) < cut).unionByName(fresh.filter(F.col(bucket) >= cut))


def superseded(live: DataFrame, confirmed: DataFrame, within_seconds: int = 1800) -> DataFrame:
    """Live landings (id, airport, icao24, landed_at) of confirmed days, each linked to the
    nearest confirmed landing (confirmed_id) of its airport and aircraft within the time.
    """
    days = confirmed.select("airport", F.to_date("landed_at").alias("day")).distinct()
    marked = live.withColumn("day", F.to_date("landed_at")).join(days.withColumn("superseded", F.lit(True)), ["airport", "day"], "left")
    near = confirmed.select("airport", "icao24", "confirmed_id", F.col("landed_at").alias("c_at"))
    linked = asof_nearest(live, near, ["airport", "icao24"], "id", "landed_at", "c_at", within_seconds // 60).select("id", "confirmed_id")
    joined = marked.join(linked, "id", "left")
    return joined.withColumn("superseded", F.coalesce("superseded", F.lit(False))).withColumn("confirmed_id", F.when(F.col("superseded"), F.col("confirmed_id"))).drop("day")


def settled(end: Column, now: Column, lag_minutes: int = 120) -> Column:
    """Whether late bookings can no longer change what ended then."""
    return now - end >= F.expr(f"INTERVAL '{lag_minutes}' MINUTE")


def unfinished(units: DataFrame, finished: DataFrame) -> DataFrame:
    """The (source, unit) rows of a backfill that no earlier run of the job has finished."""
    return units.join(finished, ["source", "unit"], "left_anti")


def retained(fixes: DataFrame, key: list[str], at: str, state: list[str], cutoff: Column, dry_run: bool = False) -> DataFrame:
    """Fixes after a retention pass: those before the cutoff thinned, later ones whole. A
    dry run counts what would go instead.
    """
    old, new = fixes.filter(F.col(at) < cutoff), fixes.filter(F.col(at) >= cutoff)
    kept = thinned(old, key, at, state)
    if dry_run:
        return old.agg(F.count("*").alias("old")).crossJoin(kept.agg(F.count("*").alias("kept"))).withColumn("dropped", F.col("old") - F.col("kept"))
    return kept.unionByName(new)


class Marks:
    """High-water marks by key, as a one-row table each in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def set(self, key: str, value: str) -> None:
        self.spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/{key}")

    def get(self, key: str) -> str | None:
        from pyspark.errors import AnalysisException

        try:
            row = self.spark.read.schema("value string").json(f"{self.folder}/{key}").first()
        except AnalysisException:
            return None
        return row.value if row else None
