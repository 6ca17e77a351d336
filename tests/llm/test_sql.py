"""The operators' queries that have SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from tidewire.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    have = sorted(str(tuple(r)) for r in got.select(*columns).collect())
    assert have and have == sorted(map(str, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))
