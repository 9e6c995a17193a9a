"""All analytics queries by name, and their SQL."""

from __future__ import annotations

from caravel.plans import domain, feeds, ledgers, outlook, people, relational, reports, rollups, scalars, streams, tiles, verdicts, words  # noqa: F401  they register their queries
from caravel.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
