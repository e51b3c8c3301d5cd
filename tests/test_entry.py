"""The driver's contract, and the library's queries against their SQL on a small table."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom import queries as core

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@needs_data
@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(con.execute(f"select {', '.join(columns)} from ({core.ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want
