"""The queries that SQL can express against DuckDB."""

import os

import duckdb
import pytest

from roadtrace.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.execute(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
