"""Devices with positions on the slanted edges of area 5, which a test with differences of doubles puts inside: queries equal their SQL."""

import os

import duckdb
import pytest

from roadtrace.plans import catalog
from tests.test_catalog import SF, rows

EVENTS = "/root/testdata/sf0.1/events.parquet"
#: Users of sf0.1 and by how many times the table's length their events are moved on, as in copies with shifted keys.
DEVICES = [(52, 5), (1308, 25), (486, 54), (225, 37), (196, 38), (1439, 47), (454, 41)]


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("edge")), duckdb.connect()
    moved = " UNION ALL ".join(f"SELECT * REPLACE (event_id + {100_000 * k} AS event_id, user_id + {1_500 * k} AS user_id) FROM '{EVENTS}' WHERE user_id = {u}" for u, k in DEVICES)
    con.execute(f"copy ({moved} ORDER BY event_id) to '{folder}/events.parquet' (format parquet)")
    for name in os.listdir(SF):
        path = f"{folder}/{name}" if name == "events.parquet" else f"{SF}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return folder, con


@pytest.mark.parametrize("name", [
    "ev_geofence_calendar",
    "event_visibility",
    "event_with_position",
    "geofence_polygon",
    "geofence_tagging",
    "overspeed_limits",
    "overspeed_limits_lowest",
])
def test_edge_points_equal_sql(spark, edge, name):
    folder, con = edge
    got = catalog.QUERIES[name](spark, folder)
    want = con.execute(catalog.SQL[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall()) != []
