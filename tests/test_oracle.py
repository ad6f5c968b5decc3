"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from catalog.queries import QUERIES
from catalog.derived import _TABLES

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in _TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    yield connection
    connection.close()


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    assert got, "a query without rows checks nothing"
    rel = con.execute(ORACLE[name])
    order = [[d[0] for d in rel.description].index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE) and set(ORACLE) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 50
