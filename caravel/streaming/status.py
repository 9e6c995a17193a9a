"""Streams of fixes and status events: windows, states, sessions, alerts, upserts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Landed Parquet files as a stream, in bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, at: str, key: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums by window; a window is final once the watermark passes it."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width), *key)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *key, "n", "value")


def sliding(events: DataFrame, at: str, key: list[str], width: str, step: str, late: str) -> DataFrame:
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width, step), *key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *key, "n")


def sessions(events: DataFrame, at: str, key: list[str], gap: str, late: str) -> DataFrame:
    """Runs of events of a key no further apart than the gap."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), *key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *key, "n")


def once(events: DataFrame, at: str, key: list[str], late: str) -> DataFrame:
    """Each event key once, within the time that duplicates can arrive."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


DAY_MS, OFFSET_MS = 86_400_000, 4 * 3_600_000


def in_event_time(events: DataFrame, key: str, at: str, value: str, late: str, own: list, fold: Callable, out: str) -> DataFrame:
    """`fold` over the events of each key in the order of their times, whatever batches they
    came in: they wait in the state until the watermark has passed them.

    fold(key, own, ready, watermark) takes the key's own state (a list, `own` at first) and
    what is ready, [(ms, value), ...] in order, and gives its new state, rows to emit and a
    time at which it wants to be called again, or none. State is `own` and the events of the
    time that they may be late; batches of rows are read one by one.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mine, held = json.loads(state.get[0]) if state.exists else (own, [])
        if not state.hasTimedOut:
            for rows in batches:
                held += [list(r) for r in zip(rows[at].astype("datetime64[ms]").astype("int64").tolist(), rows[value].tolist())]
        watermark = state.getCurrentWatermarkMs()
        held.sort(key=lambda e: (e[0], e[1] is not None, e[1]))
        ready = [e for e in held if e[0] < watermark]
        held = held[len(ready) :]
        mine, found, call = fold(keys[0], mine, ready, watermark)
        times = [e[0] for e in held[:1]] + ([call] if call is not None else [])
        state.update((json.dumps([mine, held]),))
        if times:
            state.setTimeoutTimestamp(max(min(times), watermark + 1))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in out.split(", ")])

    marked = events.select(key, at, value).withWatermark(at, late).groupBy(key)
    return marked.applyInPandasWithState(run, out, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def instant(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def online_spans(events: DataFrame, online: str, late: str) -> DataFrame:
    """Spans from status events (driver, at, status): an online event opens one, the next
    event of the driver closes it; one still open when the watermark has passed its local
    day closes at the day's end.
    """

    def fold(driver, own: list, ready: list, watermark: int) -> tuple[list, list, int | None]:
        since, out = own[0], []

        def ends(ms: int) -> int:
            return ((ms + OFFSET_MS) // DAY_MS + 1) * DAY_MS - OFFSET_MS

        for at, status in ready:
            if since is not None:
                out.append((driver, instant(since), instant(min(at, ends(since))), "event" if at <= ends(since) else "day"))
            since = at if status == online else None
        if since is not None and ends(since) < watermark:
            out.append((driver, instant(since), instant(ends(since)), "day"))
            since = None
        return [since], out, None if since is None else ends(since)

    kind = events.schema["driver"].dataType.simpleString()
    return in_event_time(events, "driver", "at", "status", late, [None], fold, f"driver {kind}, start timestamp, end timestamp, closed_by string")


def notices(health: DataFrame, late: str, confirm: dict[str, int] = {"stalled": 9}, default: int = 60, quiet: int = 30) -> DataFrame:  # noqa: B006
    """Notices of changed health (key, at, state): a change counts once confirmed, a stall
    after 9 minutes, any other by a newer observation or after 60; no two notices of a key
    within 30 minutes.
    """

    def fold(key, own: list, ready: list, watermark: int) -> tuple[list, list, None]:
        told, pending, since, noticed = own
        out = []
        for at, now in ready:
            if now == told:
                pending = since = None
                continue
            fresh = now != pending
            if fresh:
                pending, since = now, at
            waited = (at - since) / 60_000
            confirmed = waited >= confirm.get(now, default) or (now not in confirm and not fresh)
            if (told is None or confirmed) and (noticed is None or at - noticed >= quiet * 60_000):
                out.append((key, instant(at), told, now))
                told, pending, since, noticed = now, None, None, at
        return [told, pending, since, noticed], out, None

    kind = health.schema["key"].dataType.simpleString()
    return in_event_time(health, "key", "at", "state", late, [None] * 4, fold, f"key {kind}, at timestamp, was string, state string")


def latest_state(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The newest row of each key, as a batch or within one micro-batch."""
    rest = [c for c in rows.columns if c not in (*key, at)]
    best = rows.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("m"))
    return best.select(*key, F.col(f"m.{at}").alias(at), *[F.col(f"m.{c}").alias(c) for c in rest])


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is now, each micro-batch once: what a scheduled job runs. Offsets
    and state are in the checkpoint, so a second run goes on where the first ended, and
    two runs on one checkpoint exclude each other.
    """
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(polls: DataFrame, roster: DataFrame, least: int = 2) -> DataFrame:
    """Fixes of cars on the roster, or seen in `least` polls of the batch; polled_at is the
    last sighting of a fix (source, plate, captured_at).
    """
    seen = polls.groupBy("plate").agg(F.countDistinct("polled_at").alias("polls"))
    allowed = seen.filter(F.col("polls") >= least).select("plate").union(roster.select("plate")).distinct()
    rest = [c for c in polls.columns if c not in ("source", "plate", "captured_at", "polled_at")]
    best = polls.join(allowed, "plate", "left_semi").groupBy("source", "plate", "captured_at").agg(F.max("polled_at").alias("polled_at"), *[F.max_by(c, "polled_at").alias(c) for c in rest])
    return best
