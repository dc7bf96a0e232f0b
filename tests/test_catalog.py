"""Every query with a SQL twin gives the same rows in DuckDB; the others give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="session")
def duck(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def canonical(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else repr(v) for v in row)
                  for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, folder, name):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    found = canonical([tuple(row[c] for c in columns) for row in df.collect()])
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert found == canonical([tuple(row[i] for i in order) for row in result.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
