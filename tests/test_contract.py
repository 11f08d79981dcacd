"""Every registered query against its DuckDB oracle on sf0.001 (the driver
runs the same comparison at sf0.01)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as ENTRY
from reviewlens.plans import registry as REG

from .conftest import SF_SMALL

TABLES = "events documents pages labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    """Queries of the training-data subpackage without SQL are tested against brute force in tests/llm."""
    assert set(REG.QUERIES) <= set(ENTRY.queries()) and set(REG.QUERIES) <= set(ENTRY.oracle_sql())
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())


@pytest.mark.parametrize("name", sorted(ENTRY.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = ENTRY.queries()[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(ENTRY.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == _rows(cols, res.fetchall())


def test_entry_flagship(spark):
    rows = {r.complaint: r for r in ENTRY.entry(spark).collect()}
    assert set(rows) == {"App crashing", "Bugs / Errors"}
    crash, bugs = rows["App crashing"], rows["Bugs / Errors"]
    assert (crash.recent_count, crash.change, crash.avg_rating, crash.mentions, crash.is_critical) == (46, 10.7, 2.1, 126, True)
    assert (bugs.recent_count, bugs.change, bugs.avg_rating, bugs.mentions, bugs.is_critical) == (52, 7.9, 3.0, 183, False)
