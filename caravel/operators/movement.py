"""A car's day or night as tiles: where it stood, when it drove, when nobody knows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.functions import geo, time
from caravel.operators.tracks import CADENCE, MOVING_MINUTES, SILENT_MINUTES, STAY_KM, STAY_MINUTES


@dataclass(frozen=True)
class Span:
    """A window of so many hours from each local midnight, read with some hours around it."""

    hours: float
    before: float
    after: float


DAY, NIGHT = Span(24, 6, 6), Span(5, 6, 7)
TILES = "plate string, day date, kind string, start timestamp_ntz, end timestamp_ntz, lat double, lng double, fixes bigint, since_at_least boolean, until_at_least boolean"


def windowed(fixes: DataFrame, span: Span) -> DataFrame:
    """The fixes (plate, source, at, lat, lng) that each window (day) of a car reads, of one
    source: that with most fixes in the window, else of the last fix before it, else of the
    first after it. Cars without a plate are nobody's; fixes of one instant are one.
    """
    local = time.local(F.col("at"))
    offset = F.explode(F.array(*[F.lit(i) for i in range(-1 - int(span.after // 24), 2 + int(span.before // 24))]))
    rows = fixes.filter("plate is not null").select("plate", "source", "at", "lat", "lng", local.alias("__local"), F.to_date(local).alias("__day"), offset.alias("__off"))
    rows = rows.withColumn("day", F.expr("date_add(__day, __off)"))
    since = (F.unix_micros(F.col("__local").cast("timestamp")) - F.unix_micros(F.col("day").cast("timestamp_ntz").cast("timestamp"))) / 3.6e9
    rows = rows.withColumn("__h", since).filter((F.col("__h") >= -span.before) & (F.col("__h") < span.hours + span.after))
    inside = (F.col("__h") >= 0) & (F.col("__h") < span.hours)
    by = rows.groupBy("plate", "day", "source").agg(F.count(F.when(inside, 1)).alias("n"), F.max(F.when(F.col("__h") < 0, F.col("__h"))).alias("last"), F.min(F.when(F.col("__h") >= span.hours, F.col("__h"))).alias("next"))
    nearest = F.coalesce(-F.col("last"), 1000 + F.col("next"), F.lit(1e9))
    best = by.groupBy("plate", "day").agg(F.min_by("source", F.struct(-F.col("n"), nearest, "source")).alias("source"))
    return rows.join(best, ["plate", "day", "source"]).groupBy("plate", "day", "source", "at").agg(F.min("lat").alias("lat"), F.min_by("lng", "lat").alias("lng"))


def tiles_of(table: pa.Table) -> pa.Table:
    """The tiles of one window of one car, from its fixes in order. Intervals of fixes within
    150 m of the first of their run are a stay if it lasts ten minutes, else a part of the
    drive around them; further ones are driving, or `moved` if the fixes are too far apart
    in time; beyond a day the car is silent. Neighbouring driving is one tile.
    """
    rows = table.sort_by("at")
    at = rows.column("at").cast(pa.int64()).to_numpy()
    lat, lng = (np.radians(rows.column(c).to_numpy().astype(float)) for c in ("lat", "lng"))
    cadence, n = CADENCE.get(rows.column("source")[0].as_py(), 30), len(rows)
    cos = np.cos(lat)

    def within(i: int, j: int) -> np.ndarray:
        """Which of the fixes i + 1 to j are near the ones before them (i: all near the first)."""
        h = np.sin((lat[i + 1 : j] - lat[i]) / 2) ** 2 + cos[i] * cos[i + 1 : j] * np.sin((lng[i + 1 : j] - lng[i]) / 2) ** 2
        return 2 * geo.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h))) <= STAY_KM

    h = np.sin(np.diff(lat) / 2) ** 2 + cos[:-1] * cos[1:] * np.sin(np.diff(lng) / 2) ** 2
    beside = 2 * geo.EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h))) <= STAY_KM
    gaps = np.diff(at) / 6e7
    # a run goes on until a step that is long or far
    stop = np.append(np.flatnonzero(~(beside & (gaps <= SILENT_MINUTES))), n - 1)
    minutes = lambda i, j: (at[j] - at[i]) / 6e7
    found, k = [], 0
    while k < n - 1:
        j = k + 1
        if gaps[k] > SILENT_MINUTES:
            kind = "silent"
        elif not beside[k]:
            kind = "drive" if gaps[k] <= MOVING_MINUTES else "moved"
        else:
            last = int(stop[np.searchsorted(stop, k)])
            j, step = k + 1, 16
            while j < last:
                far = np.flatnonzero(~within(k, min(last, j + step) + 1)[j - k :])
                if len(far):
                    j += int(far[0])
                    break
                j, step = min(last, j + step), 2 * step
            held = bool((gaps[k:j] > cadence).any())
            kind = "stay" if minutes(k, j) >= STAY_MINUTES else "parked" if held else "drive"
        if kind == "drive" and found and found[-1][0] == "drive":
            found[-1][2] = j
        else:
            found.append([kind, k, j])
        k = j
    out = []
    for place, (kind, i, j) in enumerate(found):
        stay = kind == "stay"
        after = found[place + 1][0] if place + 1 < len(found) else None
        spot = (float(np.degrees(lat[i])), float(np.degrees(lng[i]))) if stay else (None, None)
        out.append((kind, int(at[i]), int(at[j]), *spot, j - i + 1, stay and i == 0, stay and after in (None, "moved", "silent")))
    if not out:  # a single fix
        out.append(("seen", int(at[0]), int(at[0]), float(np.degrees(lat[0])), float(np.degrees(lng[0])), 1, True, True))
    kind, start, end, lats, lngs, fixes, since, until = map(list, zip(*out))
    time_type = rows.schema.field("at").type
    same = lambda c: pa.repeat(rows.column(c)[0], len(out))
    return pa.table({
        "plate": same("plate"), "day": same("day"), "kind": kind, "start": pa.array(start, pa.int64()).cast(time_type), "end": pa.array(end, pa.int64()).cast(time_type),
        "lat": pa.array(lats, pa.float64()), "lng": pa.array(lngs, pa.float64()), "fixes": pa.array(fixes, pa.int64()), "since_at_least": since, "until_at_least": until,
    }).select([c.split()[0] for c in TILES.split(", ")])


def movement(fixes: DataFrame, span: Span = DAY) -> DataFrame:
    """plate, day, kind (stay, drive, parked, moved, silent, before_first, after_last), start
    and end in the window, minutes, and of stays lat, lng, fixes, from_at and to_at (beyond
    the window too), since_at_least and until_at_least (the bound is where the record ends
    or went dark, not where the stay did). Tiles fill each window that reads a fix, without
    holes or overlaps.

    A group is one window of one car: the fixes of a day and a half at most.
    """
    whole = windowed(fixes, span).groupBy("plate", "day").applyInArrow(tiles_of, TILES)
    begin = F.col("day").cast("timestamp_ntz") - F.expr(time.OFFSET)
    until = begin + F.make_dt_interval(mins=F.lit(int(span.hours * 60)))
    ends = whole.groupBy("plate", "day").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    side = lambda kind, a, b: ends.select("plate", "day", F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"))
    edges = side("before_first", begin, F.col("first")).unionByName(side("after_last", F.col("last"), until))
    rows = whole.unionByName(edges, allowMissingColumns=True).withColumns({"from_at": F.col("start"), "to_at": F.col("end")})
    rows = rows.withColumns({"start": F.greatest("start", begin), "end": F.least("end", until)}).filter("end > start")
    minutes = (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 60_000_000
    of_stay = {c: F.when(F.col("kind") == "stay", F.col(c)) for c in ("from_at", "to_at", "fixes", "since_at_least", "until_at_least")}
    return rows.withColumns({"minutes": minutes, **of_stay}).select("plate", "day", "kind", "start", "end", "minutes", "lat", "lng", *of_stay)


def overnight(fixes: DataFrame) -> DataFrame:
    """plate, night, spot of the longest stay of each night (00:00 to 05:00), its minutes in
    it, from_at and to_at with what is only a bound, and the minutes of the night that were
    driven and not known.
    """
    tiles = movement(fixes, NIGHT)
    total = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("minutes"))), F.lit(0.0))
    best = F.max_by(F.struct("lat", "lng", "minutes", "from_at", "to_at", "since_at_least", "until_at_least"), F.when(F.col("kind") == "stay", F.struct("minutes", "start")))
    found = tiles.groupBy("plate", F.col("day").alias("night")).agg(best.alias("s"), F.count(F.when(F.col("kind") == "stay", 1)).alias("stays"), total("drive").alias("driven"), total("moved", "silent", "before_first", "after_last").alias("unknown"))
    named = ["lat", "lng", "minutes", "from_at", "to_at", "since_at_least", "until_at_least"]
    return found.select("plate", "night", *[F.col(f"s.{c}").alias(c) for c in named], "stays", "driven", "unknown")
