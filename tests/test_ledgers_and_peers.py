"""Operators of filings, rosters, peers and movement on small cases and against plain versions."""

from __future__ import annotations

import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caravel.operators import filings, intervals, movement, peers, reconcile, roster

DAY = date(2024, 1, 1)


def days(n):
    return DAY + timedelta(days=n)


def test_the_longest_of_a_chain_of_filings_supersedes_only_what_it_meets(spark):
    rows = [  # id, start, end, day it was ingested: a chain of three, two of one length, one alone
        ("a", 0, 2, 1), ("b", 2, 8, 1), ("c", 8, 10, 1), ("d", 20, 22, 1), ("e", 22, 24, 5), ("f", 40, 41, 1), ("g", 60, 61, None), ("h", 61, 62, 1),
    ]
    table = spark.createDataFrame([(i, "k", days(a), days(b), None if s is None else datetime(2024, 2, s)) for i, a, b, s in rows], "id string, key string, a date, b date, seen timestamp_ntz")
    found = {r.id: (r.restated, r.superseded) for r in filings.judged_filings(table, ["key"], "a", "b", "seen").collect()}
    assert found == {"a": (True, True), "b": (True, False), "c": (True, True), "d": (True, True), "e": (True, False), "f": (False, False), "g": (True, True), "h": (True, False)}
    nothing = spark.createDataFrame([("x", None, None, None, None)], table.schema)
    assert [(r.restated, r.superseded) for r in filings.judged_filings(nothing, ["key"], "a", "b", "seen").collect()] == [(False, False)]


def test_a_day_of_statements_goes_to_its_own_filing_then_to_the_root(spark):
    rows = [("u", 1, "Ann  B", 0, 6, False, 70.0), ("u", 1, "Ann  B", 2, 2, False, 5.0), ("u", 1, "Ann  B", 1, 3, True, 30.0), ("u", 2, "ann b", 0, 0, False, 1.0), ("u", 3, None, 0, 0, False, 9.0)]
    table = spark.createDataFrame([(p, d, n, days(a), days(b), r, x) for p, d, n, a, b, r, x in rows], "platform string, driver long, driver_name string, period_start date, period_end date, root_priced boolean, net double")
    found = {(r.person, r.day): (r.net, r.period_days, r.driver) for r in filings.statement_days(table, ["platform", "driver"], ["net"]).collect()}
    assert found == {
        ("ann b", days(0)): (11.0, 7, 2), ("ann b", days(1)): (10.0, 3, 1), ("ann b", days(2)): (5.0, 1, 1), ("ann b", days(3)): (10.0, 3, 1),
        **{("ann b", days(i)): (10.0, 7, 1) for i in (4, 5, 6)}, ("3", days(0)): (9.0, 1, 3),
    }


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 50, 51])
def test_medians_of_everyone_else(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random() * 1000, 7.0, None]) for _ in range(n)]
    table = spark.createDataFrame([(i, v, 5.0) for i, v in enumerate(values)], "person long, x double, same double")
    mid = peers.middles(table, ["x", "same"])
    rows = table.join(mid.filter("value = 'x'"), F.lit(True), "left")
    found = {r.person: r.m for r in rows.select("person", peers.median_of_others(F.col("x"), F.col("n"), F.col("v0"), F.col("v1"), F.col("v2")).alias("m")).collect()}
    for i in range(n):
        others = [v for j, v in enumerate(values) if j != i and v is not None]
        assert found[i] == (pytest.approx(statistics.median(others)) if others else None)


def test_count_once_against_all_pairs(spark):
    rng = random.Random(4)
    ranks = {"a": 0, "b": 1, "c": 2}
    rows = []
    for i in range(300):
        start = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(6000))
        rows.append((i, f"P{rng.randrange(3)}", rng.choice("abc"), rng.choice(["x", None]), start, start + timedelta(minutes=rng.choice([0, 30, 300, 3000]))))
    table = spark.createDataFrame(rows, "id long, plate string, source string, verdict string, start timestamp_ntz, end timestamp_ntz")
    beaten = {x[0] for x in rows for y in rows if x[1] == y[1] and x[3] == y[3] and ranks[y[2]] < ranks[x[2]] and y[4] < x[5] and y[5] > x[4]}
    assert {r.id for r in intervals.count_once(table, ranks).collect()} == {x[0] for x in rows} - beaten


def test_clock_lags_are_upper_medians(spark):
    rng = random.Random(6)
    base, rows = datetime(2024, 1, 1), []
    for group, n in (("a", 1), ("b", 2), ("c", 7), ("d", 200)):
        rows += [(group, base, base + timedelta(seconds=rng.choice([30, 31, 4000, rng.randrange(9000)]))) for _ in range(n)]
    rows += [("a", base, base - timedelta(hours=2)), ("e", base, None), ("f", base, base - timedelta(minutes=61))]
    found = {r.g: r.lag for r in reconcile.clock_lags(spark.createDataFrame(rows, "g string, captured_at timestamp_ntz, polled_at timestamp_ntz"), ["g"]).collect()}
    for group in "abcd":
        lags = sorted((p - c).total_seconds() / 60 for g, c, p in rows if g == group and p and p > c - timedelta(hours=1))
        assert found[group] == pytest.approx(lags[len(lags) // 2])
    assert set(found) == set("abcd")


def test_a_car_is_admitted_departs_and_comes_back(spark):
    polls = {"car": [1, 1, 1, 0, 1, 0, 0, 0, 1, 1, 0, 1, 1, 1], "once": [0, 1] + [0] * 12}
    rows = [("F", datetime(2024, 1, 1, h), car) for h in range(14) for car in [*[f"other{i}" for i in range(20 if h != 5 else 3)], *[c for c, p in polls.items() if p[h]]]]
    found = roster.memberships(spark.createDataFrame(rows, "fleet_id string, polled_at timestamp_ntz, plate string"), admit=3, depart=2, ratio=0.8)
    by = sorted((r.plate, r.first_listed.hour, r.admitted_at and r.admitted_at.hour, r.last_listed.hour, r.departed_at and r.departed_at.hour) for r in found.collect() if not r.plate.startswith("other"))
    # poll 5 lists three cars of twenty: nobody is missed in it
    assert by == [("car", 0, 2, 4, 7), ("car", 8, 13, 13, None), ("once", 1, None, 1, None)]


def test_movement_fills_windows_without_holes(spark):
    rng = random.Random(8)
    rows = []
    for car in range(6):
        at, lat = datetime(2024, 1, 1), 25.0
        for _ in range(60):
            at += timedelta(minutes=rng.choice([1, 5, 12, 25, 45, 300, 2000]))
            lat += rng.choice([0, 0, 0.0005, 0.01])
            rows.append((f"P{car}", rng.choice(["fms", "fms", "cabman"]), at, lat, 55.0))
    rows += [(None, "fms", datetime(2024, 1, 1), 25.0, 55.0), ("single", "fms", datetime(2024, 1, 5, 4), 25.0, 55.0)]
    fixes = spark.createDataFrame(rows, "plate string, source string, at timestamp_ntz, lat double, lng double")
    for span, whole in ((movement.DAY, 1440), (movement.NIGHT, 300)):
        tiles = movement.movement(fixes, span).collect()
        by = {}
        for r in tiles:
            by.setdefault((r.plate, r.day), []).append(r)
        for own in by.values():
            own.sort(key=lambda r: r.start)
            assert sum(r.minutes for r in own) == pytest.approx(whole) and all(a.end == b.start for a, b in zip(own, own[1:]))
            assert all((r.kind == "stay") == (r.lat is not None) for r in own)
        assert {p for p, _ in by} == {*[f"P{i}" for i in range(6)], "single"}
    assert movement.movement(fixes.limit(0)).count() == 0
