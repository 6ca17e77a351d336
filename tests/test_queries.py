"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidewire.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(table):
    def plain(x):
        return None if x is None else round(x, 5) if isinstance(x, float) else bool(x) if isinstance(x, bool) else x

    return sorted(str([plain(v) for v in r]) for r in table)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    have = rows(tuple(r) for r in got.select(*columns).collect())
    assert have and have == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
