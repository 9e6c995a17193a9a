"""Steps that read or judge their input once."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime

import pyarrow as pa
import pytest

from caravel.operators import aggregates, filings, movement
from caravel.plans import catalogue
from caravel.sources import readers, sinks
from tests.test_oracles import SF


def test_a_breakdown_is_read_once_for_all_its_levels(spark):
    tree = '[{"name":"a","amount":1.0,"currency":"x","children":[{"name":"b","amount":2.0,"currency":"y","children":[{"name":"c","amount":4.0},{"name":" ","amount":9.0}]}]},{"name":"a","amount":8.0}]'
    found = readers.flattened(spark.range(2).selectExpr("id AS k", f"CASE WHEN id = 0 THEN '{tree}' END AS nodes"), "k", "nodes")
    assert {(r.k, r.path, r.amount, r.mixed_currency) for r in found.collect()} == {(0, "a", 9.0, True), (0, "a.b", 2.0, True), (0, "a.b.c", 4.0, True)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_two_way_matches_are_counted_before_the_pairs(spark):
    found = catalogue.queries()["C25_two_way_match"](spark, SF)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_stay_is_found_in_arrow_columns():
    def tiles(lats):
        n = len(lats)
        at = pa.array([datetime(2024, 1, 1, 0, 0)] * n, pa.timestamp("us"))
        at = pa.array([1_704_067_200_000_000 + 60_000_000 * i for i in range(n)], pa.int64()).cast(at.type)
        rows = pa.table({"plate": ["p"] * n, "day": pa.array([date(2024, 1, 1)] * n), "source": ["fms"] * n, "at": at, "lat": lats, "lng": [55.0] * n})
        return [(r["kind"], r["fixes"]) for r in movement.tiles_of(rows).to_pylist()]

    assert tiles([25.0] * 1000) == [("stay", 1000)]
    assert tiles([25.0] * 37 + [26.0] * 500 + [27.0]) == [("stay", 37), ("drive", 2), ("stay", 500), ("drive", 2)]
    # each step is short, but the run drifts away from its first fix
    assert tiles([25.0 + 0.0001 * i for i in range(29)]) == [("stay", 14), ("stay", 14), ("drive", 3)]
    assert tiles([25.0]) == [("seen", 1)]


def test_filings_of_one_period_go_before_its_days_are_spread(spark):
    at = lambda d: date(2024, 1, d)
    rows = [("x", at(1), at(4), 40, 1), ("x", at(1), at(4), 80, 2), ("x", at(1), at(4), 8, None), ("x", at(4), at(4), 5, None), ("x", at(2), at(5), 4, 2), ("x", at(6), at(7), 6, None), (None, at(1), at(1), None, 3), (None, at(1), at(1), 7, 2), ("y", None, at(2), 1, 1)]
    found = aggregates.period_to_days(spark.createDataFrame(rows, "k string, a date, b date, amount int, seen int"), ["k"], "a", "b", "amount", "seen")
    expected = [("x", 1, 4, 20.0), ("x", 2, 4, 20.0), ("x", 3, 4, 20.0), ("x", 4, 1, 5.0), ("x", 5, 4, 1.0), ("x", 6, 2, 3.0), ("x", 7, 2, 3.0), (None, 1, 1, None)]
    assert sorted(map(str, ((r.k, r.day.day, r.period_days, r.day_amount) for r in found.collect()))) == sorted(map(str, expected))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate explode") :]


def test_workbooks_are_built_and_read_once(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("b", 1, None), ("a", 1, "y"), ("a", None, "z"), (None, 5, "w")], "who string, n int, t string")
    books = sinks.workbooks(rows, "who", ["n"])
    found = readers.headed_rows(readers.cells_of(books), ["n", "t"])
    assert {(r.path, r.row, r.n, r.t) for r in found.collect()} == {("a.xlsx", 2, "1", "y"), ("a.xlsx", 3, "2", "x"), ("a.xlsx", 4, None, "z"), ("b.xlsx", 2, "1", None), ("None.xlsx", 2, "5", "w")}
    assert readers.headed_rows(readers.cells_of(books), ["n", "u"]).isEmpty()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert sinks.workbooks(rows, "who", ["n"], 3).count() == 3
    with pytest.raises(Exception, match="over 2 rows"):
        sinks.workbooks(rows, "who", ["n"], 2).collect()


def test_landed_files_make_as_many_batches_at_every_size(spark, tmp_path):
    """Events of five partitions came as five files a landing, each a micro-batch of its own."""
    from types import SimpleNamespace

    from caravel.plans import streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(5)
    stream = streams.in_files(SimpleNamespace(spark=spark, events=events), "landings")
    batches = []
    stream.writeStream.foreachBatch(lambda rows, n: batches.append(rows.count())).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert sum(batches) == events.count() and len(batches) <= 11


def test_the_sources_of_a_drivers_day_meet_without_joins(spark):
    """They were joined and aggregated in the few tasks that Spark made of them."""
    rng = random.Random(9)
    day = lambda: date(2024, 1, rng.randrange(1, 9))
    fare = lambda: rng.choice([None, 8.0, 16.0, 64.0])
    jobs = [(rng.choice(["1", "2", "3", None]), rng.choice("pq"), day(), rng.choice(["a", "b", None]), fare()) for _ in range(40)]
    statements = [(rng.choice("pqr"), rng.choice(["1", "4", None]), day(), rng.choice(["a", "b", "c", None]), fare(), rng.choice([1, 7, None])) for _ in range(30)]
    payouts = [(rng.choice("pqr"), rng.choice(["2", "5", None]), day(), fare(), fare()) for _ in range(12)]
    work = [(d, x, f, 1, 10) for d, x, f in sorted({(d, x): (d, x, rng.choice(["F", "E", None])) for d, _, x, _, _ in jobs if d}.values(), key=str)]
    online = [("1", date(2024, 1, 2), 4), ("1", date(2024, 1, 3), 90), ("9", date(2024, 1, 20), 5)]
    frames = [
        spark.createDataFrame(rows, schema)
        for rows, schema in (
            (work, "driver string, day date, fleet_id string, jobs long, on_job long"), (jobs, "driver string, person string, day date, platform string, fare double"),
            (statements, "person string, driver string, day date, platform string, net double, period_days int"), (payouts, "person string, driver string, day date, earnings double, cash double"), (online, "driver string, day date, online_min long"),
        )
    ]
    found = filings.driver_days(*frames)

    total = lambda values: sum(v for v in values if v is not None) if any(v is not None for v in values) else None
    top = lambda values: max((v for v in values if v is not None), default=None)
    money, pay = {}, {}
    for p, x in {(p, x) for _, p, x, _, _ in jobs} | {(r[0], r[2]) for r in [*statements, *payouts]}:
        mine = [r for r in jobs if (r[1], r[2]) == (p, x)]
        filed, paid = ([r for r in rows if (r[0], r[2]) == (p, x)] for rows in (statements, payouts))
        accounts = Counter(r[0] for r in mine)
        owner = min(accounts, key=lambda d: (-accounts[d], d is not None, d or "")) if accounts else None
        driver = owner or top([r[1] for r in filed]) or p
        parts = money.setdefault((driver, x), []) if mine or filed else []
        for platform in {r[3] for r in mine + filed}:
            nets, fares = [r for r in filed if r[3] == platform], [r[4] for r in mine if r[3] == platform]
            net = total([r[4] for r in nets])
            if platform is None and net is not None and total(fares) is not None:  # rows of no platform never meet
                parts.append((None, total(fares), 1, "fares"))
                fares = []
            if net is not None:
                vague = any(r[4] is not None and r[5] is None for r in nets)
                parts.append((net, net, None if vague else top([r[5] for r in nets]), "statement"))
            elif total(fares) is not None:
                parts.append((None, total(fares), 1, "fares"))
        if paid:
            pay.setdefault((owner or top([r[1] for r in paid]) or p, x), []).extend(paid)
    fleets = {d: min((r[2] for r in work if r[0] == d and r[2]), default=None) for d, *_ in work}
    expected = {}
    for k in {(r[0], r[1]) for r in work} | {*money, *pay} | {(r[0], r[1]) for r in online}:
        w, on = next((r for r in work if (r[0], r[1]) == k), None), next((r[2] for r in online if (r[0], r[1]) == k), None)
        parts, paid = money.get(k, []), pay.get(k, [])
        kinds = {r[3] for r in parts}
        expected[k] = (
            (w and w[2]) or fleets.get(k[0]), w[3] if w else 0, w[4] if w else 0, total([r[0] for r in parts]), total([r[1] for r in parts]), "mixed" if len(kinds) > 1 else [*kinds, "none"][0],
            None if any(r[2] is None for r in parts) else top([r[2] for r in parts]), total([r[3] for r in paid]), total([r[4] for r in paid]), on, None if on is None else max(0, on - (w[4] if w else 0)),
        )
    columns = ["fleet_id", "jobs", "on_job", "statement_net", "money", "money_source", "money_period_days", "payout", "payout_cash", "online_min", "idle_online"]
    rows = found.collect()
    assert len(rows) == len(expected) and {(r.driver, r.day): tuple(r[c] for c in columns) for r in rows} == expected
    assert {r.money_source for r in rows} == {"none", "statement", "fares", "mixed"}

    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert filings.driver_days(*frames, 7).rdd.getNumPartitions() == 7
    assert [filings.tasks(n) for n in (0, 150_000, 900_000, 9_000_000)] == [1, 8, 46, 200]
