"""Every query of the telemetry catalogue against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from roadtrace.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in values], key=repr)


def _plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v if v is None or isinstance(v, (bool, str)) else round(float(v), 6)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    assert sorted(got.columns) == sorted(c[0] for c in want.description)
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
