"""Points on the edges of areas: the test gives what the SQL gives, whose vertices are decimal numbers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from roadtrace.functions import geo
from roadtrace.plans.catalog import _contains
from roadtrace.sources.adapter import GEOFENCES


@pytest.mark.parametrize("area", [a for _, _, a in GEOFENCES if not a.startswith("CIRCLE")])
def test_points_of_the_grid_equal_sql(spark, area):
    """Sums of whole steps as in positions, along each edge and beside it."""
    n = [tuple(map(float, x.split())) for x in area[area.rindex("(") + 1 : area.index(")")].split(",")]
    points = set()
    for (a, b), (c, d) in zip(n, n[1:] + n[:1], strict=True):
        for k in range(501):
            y, x = round(((c - a) * k / 500 + a - 40) * 10000), round(((d - b) * k / 500 + b + 3.7) * 10000)
            points |= {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    rows = [(i, 40 + y / 10000, -3.7 + x / 10000) for i, (y, x) in enumerate(sorted(points))]
    con = duckdb.connect()
    con.execute("create table p (id bigint, latitude double, longitude double)")
    con.executemany("insert into p values (?, ?, ?)", rows[:4000])
    df = spark.createDataFrame(rows[:4000], "id long, lat double, lon double").withColumn("ring", geo.points(F.lit(area)))
    inside = (geo.in_polygon if area.startswith("POLYGON") else lambda *x: geo.near_line(*x, F.lit(400.0)))(F.col("lat"), F.col("lon"), F.col("ring"))
    got = {r.id for r in df.where(inside).select("id").collect()}
    assert got == {r[0] for r in con.execute(f"select id from p where {_contains(0, area)}").fetchall()} and 0 < len(got)


def test_lines_equal_the_plain_distance(spark):
    df = spark.range(3000).selectExpr("id", "39.95 + id % 60 / 600D as lat", "-3.75 + id div 60 / 500D as lon")
    line = [(39.98, -3.72), (40.0, -3.7), (40.02, -3.72), (40.02, -3.72)]
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in line])
    plain = [geo.distance_to_line("lat", "lon", *map(F.lit, a + b)) <= 900 for a, b in zip(line, line[1:], strict=False)]
    want = df.where(plain[0] | plain[1] | plain[2]).count()
    assert 0 < want < 3000 and df.where(geo.near_line(F.col("lat"), F.col("lon"), ring, F.lit(900.0)) != (plain[0] | plain[1] | F.coalesce(plain[2], F.lit(False)))).count() == 0
    text = df.select(geo.near_line(F.col("lat"), F.col("lon"), ring, F.lit(900.0)).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert text.upper().count("ATAN2") <= 3
