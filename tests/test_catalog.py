"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

from depotlake import catalog
from depotlake.sources.fixtures import RAW

ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in RAW:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(found):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck, data):
    ours = catalog.queries()[name](spark, data)
    columns = sorted(ours.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows(tuple(r) for r in ours.select(columns).collect()) == rows(tuple(r[i] for i in at) for r in cursor.fetchall())


def test_all_queries_with_sql_are_queries():
    assert set(ORACLES) <= set(catalog.queries())


def test_queries_are_listed_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
