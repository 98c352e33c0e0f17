"""Every registered query against its SQL, on the smallest tables."""

import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

SF = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="test tables are not there")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def comparable(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = comparable(tuple(r[c] for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = tables.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == comparable(tuple(row[i] for i in order) for row in found.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
