"""Queries against their SQL on small tables made to be odd: large keys, times at the edge of a slot."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from caravel.plans import catalogue
from tests.test_oracles import in_order, plain


def matches(spark, folder, name, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, frame in tables.items():
        path = f"{folder}/{table}.parquet"
        frame.coalesce(1).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    found = catalogue.queries()[name](spark, str(folder))
    result = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    expected = [tuple(map(plain, r)) for r in result.fetchall()]
    assert expected and in_order([tuple(plain(r[c]) for c in names) for r in found.collect()]) == in_order(expected)


def test_plus_codes_of_suppliers_past_the_codes_range(spark, tmp_path):
    suppliers = spark.createDataFrame([(k, f"S{k}", k % 25, 1.0) for k in (1, 24_903, 24_904, 60_000, 900_001)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    matches(spark, tmp_path, "F16_plus_codes_suppliers", supplier=suppliers)


@pytest.mark.parametrize("name", ["S06_polls", "S06_roster"])
def test_polls_at_the_edge_of_a_slot(spark, tmp_path, name):
    first = datetime(2024, 1, 1)
    rows = []
    for n, part in enumerate((0.0, 0.49, 0.5, 0.51, 0.999999)):
        for slot in range(1, 12):  # just before the slot's end, every slot or every third
            rows += [(3 * n, first + timedelta(hours=6 * slot, seconds=part - 1)), (3 * n + 1, first + timedelta(hours=18 * slot, seconds=part - 1))]
    events = spark.createDataFrame([(i, at, u, "view", 1.0, "") for i, (u, at) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    matches(spark, tmp_path, name, events=events)


def test_journeys_without_an_end_or_a_start_and_of_parts_of_an_hour(spark, tmp_path):
    rows = []
    for car in (1, None):
        for at, hours in [(0, None), (0, 3.0), (1, None), (3, 0.5), (3, 1.5), (4, None), (5, 2.5), (7, 1.0), (8, -1.0), (9, None), (None, 5.0), (None, None)]:
            rows.append((len(rows), car, 1, hours, None if at is None else datetime(2024, 1, 1) + timedelta(hours=at)))
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")
    matches(spark, tmp_path, "W17_supersede", lineitem=lines)


def test_journeys_of_equal_spans_are_of_one_group(spark, tmp_path):
    first, rows = datetime(2024, 1, 1), []
    for n in range(400):  # every span stands six times and overlaps the next but not each tenth
        rows += [(6 * n + k, 1, 1, 5.0 if n % 10 else 4.0, first + timedelta(hours=4 * n)) for k in range(6)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    groups, begun = [], [0]
    for n in range(1, 400):
        if (n - 1) % 10 == 0:
            groups.append(begun)
            begun = []
        begun.append(n)
    groups.append(begun)
    found = catalogue.queries()["W17_supersede"](spark, str(tmp_path)).collect()
    assert sorted((r.plate, r.ingested_at, r.members) for r in found) == sorted(("S1", (6 * g[-1] + 5) * 10 + 1, 6 * len(g)) for g in groups)
