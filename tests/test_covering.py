"""Geofences of any size and place: tags equal the exact test over all pairs."""

import random

from pyspark.sql import functions as F

from roadtrace.functions import geo
from roadtrace.operators import pipeline

DATE_LINE = "POLYGON ((66.9494 179.838, 66.9508 -179.8496, 66.8406 -180.0014))"


def tags(spark, fences, points):
    g = spark.createDataFrame(fences, "geofence_id long, area string")
    p = spark.createDataFrame([(i, 1, i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, device_id long, fix_ms long, latitude double, longitude double")
    found = [(r.id, r.geofence_id) for r in pipeline.tagged(p, g).collect()]
    assert len(found) == len(set(found))
    whole = g.select("geofence_id", "area", geo.points(F.col("area")).alias("ring"), geo.numbers(F.col("area")).alias("n")).cache()
    ring, n, at = F.col("ring"), F.col("n"), (F.col("latitude"), F.col("longitude"))
    exact = F.when(F.col("area").startswith("CIRCLE"), geo.in_circle(*at, n)).when(F.col("area").startswith("POLYGON"), geo.in_polygon(*at, ring)).otherwise(geo.near_line(*at, ring, F.lit(pipeline.LINE_M)))
    return set(found), {(r.id, r.geofence_id) for r in p.crossJoin(whole).where(exact).collect()}


def test_date_line(spark):
    got, want = tags(spark, [(1, DATE_LINE)], [(66.9015, -180.0096), (66.9015, 179.991), (66.8368, -179.8792)])
    assert got == want == {(0, 1), (1, 1)}


def test_all_sizes(spark):
    r = random.Random(2)
    fences, points = [(0, DATE_LINE), (1, "POLYGON ((30 10, 30 30, 50 30, 50 10))"), (2, "CIRCLE (89.9 10, 30000)"), (3, "LINESTRING (10 179.9, 10.1 -179.9)"), (4, "LINESTRING (0 100, 1 178, 1 -178, 0 -80)"), (5, "POLYGON ((-80 -170, -80 170, 80 170, 80 -170))")], []
    for k in range(60):
        lat, lon, size = r.uniform(-75, 75), r.choice([r.uniform(-180, 180), r.choice([-179.99, 179.99])]), 10 ** r.uniform(-3, 1.3)
        wrap = lambda x: (x + 180) % 360 - 180
        corners = [(max(-89, min(89, lat + r.uniform(-size, size))), wrap(lon + r.uniform(-size, size))) for _ in range(4)]
        fences.append((10 + k, f"CIRCLE ({lat:.5f} {lon:.5f}, {size * 50_000:.1f})" if k % 3 == 0 else ("POLYGON ((" if k % 3 == 1 else "LINESTRING (") + ", ".join(f"{a:.5f} {b:.5f}" for a, b in corners) + ("))" if k % 3 == 1 else ")")))
        points += [(lat + r.gauss(0, size / 2), wrap(lon + r.gauss(0, size / 2))) for _ in range(8)] + [(a, b) for a, b in corners]
    points += [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(100)] + [(89.95, -170), (10.05, 180), (10.05, -180), (66.9, 180.0), (0, 0)]
    points = [(max(-90, min(90, a)), b) for a, b in points]
    got, want = tags(spark, fences, points)
    assert got == want and len(want) > 300
    cells = pipeline.covering(spark.createDataFrame(fences, "geofence_id long, area string")).groupBy("geofence_id").count().collect()
    assert len(cells) == len(fences) and max(r["count"] for r in cells) <= 36
