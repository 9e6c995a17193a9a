"""What is found by sorting against all pairs, and that the rows shuffled grow with the input."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from caravel.operators import attribution, joins, segments

T0 = datetime(2024, 1, 1)


def at(minute):
    return T0 + timedelta(minutes=minute)


def shuffled(spark, frame):
    """Rows that a run of `frame` writes to shuffles."""
    sc = spark.sparkContext

    def written():
        stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    frame.collect()
    return written() - before


def ladder_tables(spark, seed, n, minutes, people):
    rng = random.Random(seed)
    trips = [("p", rng.randrange(people), a, None if rng.random() < 0.1 else a + rng.randrange(40)) for a in (rng.randrange(minutes) for _ in range(n))]
    segments = [(i, "p", a, a + rng.randrange(1, 60)) for i, a in enumerate(rng.randrange(minutes) for _ in range(n))]
    t = spark.createDataFrame([(p, who, at(a), None if b is None else at(b)) for p, who, a, b in trips], "plate string, person long, t_start timestamp_ntz, t_end timestamp_ntz")
    s = spark.createDataFrame([(i, p, at(a), at(b), 0) for i, p, a, b in segments], "segment_id long, plate string, start timestamp_ntz, end timestamp_ntz, lag int")
    return segments, trips, s, t


def plain_brackets(segments, trips, reach):
    found = {}
    for i, _, s0, s1 in segments:
        before, after = {}, {}
        for _, who, a, b in trips:
            if b is not None and s0 - reach <= b <= s0:
                before[who] = max(b, before.get(who, b))
            if s1 <= a <= s1 + reach:
                after[who] = min(a, after.get(who, a))
        both = before.keys() & after.keys()
        clear = [w for w in both if not any(x != w and (a if b is None else b) > before[w] and a < after[w] for _, x, a, b in trips)]
        found[i] = (bool(before), bool(after), bool(both), len(clear), clear[0] if len(clear) == 1 else None)
    return found


def test_brackets_against_all_pairs(spark):
    seen = set()
    for seed, n, minutes, people in ((1, 60, 3000, 3), (2, 120, 1500, 40), (3, 100, 9000, 12), (4, 80, 400, 200)):
        judged, trips, s, t = ladder_tables(spark, seed, n, minutes, people)
        rows = s.join(attribution.brackets(s, t, 60), ["plate", "start", "end"]).collect()
        found = {r.segment_id: (r.arrived is not None, r.resumed is not None, r.both, r.clear, r.person) for r in rows}
        assert found == plain_brackets(judged, trips, 60)
        seen |= {x[:3] + (min(x[3], 2),) for x in found.values()}
    assert {(True, True, True, 0), (True, True, True, 1), (True, True, False, 0), (True, False, False, 0), (False, True, False, 0)} <= seen


def test_the_ladder_pairs_no_segment_with_trips_or_holders(spark):
    def rows(n):
        _, _, s, t = ladder_tables(spark, 5, n, 1400, n)
        held = spark.createDataFrame([("p", T0.date(), i) for i in range(n)], "plate string, day date, person long")
        return shuffled(spark, attribution.attributed(s, t, held))

    assert rows(1600) < 6 * rows(400)


def test_attribution_pairs_no_segment_with_trips_or_holders(spark):
    def rows(n):
        _, _, s, t = ladder_tables(spark, 6, n, 1400, n)
        held = spark.createDataFrame([("p", T0.date(), i) for i in range(n)], "plate string, day date, person long")
        return shuffled(spark, segments.attributed(s, t, held))

    assert rows(1600) < 6 * rows(400)


def test_status_history_repeats_no_candidate_for_each_account(spark):
    def rows(n):
        candidates = spark.createDataFrame([(i, 1, at(i)) for i in range(n)], "segment_id long, person long, started_at timestamp_ntz")
        accounts = spark.createDataFrame([(1, i) for i in range(n)], "person long, account long")
        events = spark.createDataFrame([(i, at(2 * i), f"s{i}") for i in range(n)], "account long, at timestamp_ntz, status string")
        found = joins.status_at(candidates, accounts, events)
        moved = shuffled(spark, found)
        assert {r.segment_id: r.status for r in found.collect()} == {i: f"s{i // 2}" for i in range(n)}
        return moved

    assert rows(800) < 6 * rows(200)


def test_nearest_trips_against_all_pairs(spark):
    def tables(n, minutes):
        rng = random.Random(n)
        trips = [(rng.randrange(2), f"P{rng.randrange(3) if rng.random() < 0.3 else 0}", rng.randrange(minutes)) for _ in range(n)]
        sessions = [(i, rng.randrange(3), rng.randrange(minutes)) for i in range(n)]
        s = spark.createDataFrame([(i, d, at(m), None) for i, d, m in sessions], "session_id long, driver long, at timestamp_ntz, session_plate string")
        return trips, sessions, joins.nearest_trip(s, spark.createDataFrame([(d, p, at(m)) for d, p, m in trips], "driver long, plate string, trip_at timestamp_ntz"), 1)

    trips, sessions, found = tables(150, 9000)
    expected = {}
    for i, d, m in sessions:
        near = sorted((abs(m - x), x, p) for e, p, x in trips if e == d and abs(m - x) <= 60)
        basis = "no_link" if d == 2 else "no_trip" if not near else "only_car" if len({p for *_, p in near}) == 1 else "nearest_trip"
        expected[i] = (near[0][2] if near else None, basis)
    assert {r.session_id: (r.plate, r.basis) for r in found.collect()} == expected
    assert {b for _, b in expected.values()} == {"no_link", "no_trip", "only_car", "nearest_trip"}
    assert shuffled(spark, tables(1600, 200)[2]) < 6 * shuffled(spark, tables(400, 200)[2])


def test_components_move_no_more_than_a_few_times_the_links_however_long_the_chains(spark):
    def rows(n):
        before = written_rows(spark)
        found = joins.connected(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(-5, -5), (None, 3), (n + 9, n + 7)], "a long, b long"))
        moved = written_rows(spark) - before
        assert {r.node: r.component for r in found.collect()} == {**dict.fromkeys(range(n + 1), 0), -5: -5, n + 7: n + 7, n + 9: n + 7}
        return moved

    assert rows(3000) < 3000 * 12


def written_rows(spark):
    """Rows written to tables so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).outputRecords() for i in range(stages.size()))
