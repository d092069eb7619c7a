"""The queries with SQL against DuckDB, and the guard of the entry module."""

from __future__ import annotations

import duckdb
import pytest

from depotlake.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(name, spark, data):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    ours = registry.QUERIES[name](spark, data)
    cursor = c.execute(registry.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(repr, (tuple(r) for r in ours.select(names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_one_query_for_each_operator():
    import __spark_entry__ as e

    numbers = [int(n[2:].split("_")[0]) for n in registry.QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(registry.QUERIES) | {"pipeline"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
