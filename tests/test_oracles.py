"""Every analytics query against its SQL in DuckDB, on the smallest tables, and with rows
to compare.
"""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from caravel.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    """Numbers to nine digits, NaN as null, nested values as tuples."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(plain(r[i]) for i in at) for r in result.fetchall()]
    assert in_order(rows) == in_order(expected)
    assert rows
