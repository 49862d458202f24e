"""Literal scenarios: motion, trips, overspeed, geofences, distances, ordering traps."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from roadtrace.functions import geo, text
from roadtrace.operators import events, folds, pipeline, reports, request

M = 60_000


def positions(spark, rows, **more):
    df = spark.createDataFrame([(i, 1, m * M, float(s), d * 1000, s > 0, None) for i, m, s, d in rows], "id long, device_id long, fix_ms long, speed double, total_mm long, motion boolean, ignition boolean")
    return df.withColumns({"fuel": F.lit(0.0), "hours_ms": F.lit(0).cast("long"), **more})


def slow(df, trips, **options):
    spans = reports.slow_spans(df, trips, **options)
    rows = (reports.trips(spans) if trips else reports.stops(spans)).orderBy("start_ms").collect()
    return [(r.start_ms // M, r.end_ms // M) for r in rows], rows


#: Minutes, speeds and metres of a ride with a short stop, whose trip and stops are known.
RIDE = [(1, 0, 0, 0), (2, 1, 0, 0), (3, 2, 10, 0), (4, 3, 10, 1000), (5, 4, 10, 2000), (6, 5, 10, 3000), (7, 6, 10, 4000), (8, 7, 0, 5000), (9, 8, 10, 6000), (10, 9, 0, 7000), (11, 19, 0, 7000), (12, 29, 0, 7000)]
GAP = [(1, 0, 7, 100), (2, 1, 7, 300), (3, 2, 5, 500), (4, 3, 5, 600), (5, 4, 3, 700), (6, 23, 2, 700), (7, 24, 5, 800), (8, 25, 5, 900)]


def test_trip_simple(spark):
    df = positions(spark, [(1, 0, 0, 0), (2, 1, 0, 0), (3, 2, 10, 0), (4, 3, 10, 1000), (5, 4, 10, 2000), (6, 5, 0, 3000), (7, 15, 0, 3000), (8, 25, 0, 3000)])
    _, t = slow(df, True, trip_s=300, parking_s=180)
    assert [(r.start_ms, r.end_ms, r.duration, r.distance, r.max_speed) for r in t] == [(2 * M, 5 * M, 180_000, 3000.0, 10.0)]
    assert math.isclose(t[0].average_speed, 32.4, abs_tol=0.01)


def test_trips_and_stops_of_a_ride(spark):
    df = positions(spark, RIDE)
    assert slow(df, True, parking_s=180)[0] == [(2, 9)]
    assert slow(df, False, parking_s=180)[0] == [(0, 2), (9, 29)]


def test_stops_from_the_first_row(spark):
    """The first row decides what the range begins with."""
    at = lambda speeds, minutes=range(6): positions(spark, [(i + 1, m, v, 0) for i, (m, v) in enumerate(zip(minutes, speeds, strict=True))])
    stops = lambda df: slow(df, False, parking_s=200)[0]
    assert stops(at([0, 0, 1, 0, 1, 0])) == [(0, 5)] and stops(at([0, 0, 0, 0, 1, 2])) == [(0, 5)]
    assert stops(at([2, 1, 0, 0, 0, 0], [0, 1, 2, 12, 22, 32])) == [(2, 32)] and stops(at([5, 5, 3, 5, 5, 5])) == []


def test_trip_and_stop_by_gap(spark):
    df = positions(spark, GAP)
    found, t = slow(df, True, trip_s=200, parking_s=200)
    assert found[0] == (0, 4) and (t[0].distance, t[0].max_speed) == (600.0, 7.0) and math.isclose(t[0].average_speed, 4.86, abs_tol=0.01)
    assert slow(df, False, trip_s=200, parking_s=200)[0][0] == (4, 25)


def test_fast_spans_start_from_a_moving_edge(spark):
    df = positions(spark, GAP)
    events = spark.createDataFrame([(1, "deviceStopped", 5, 4 * M), (1, "deviceMoving", 7, 24 * M)], "device_id long, type string, position_id long, event_ms long")
    ends = lambda trips: [(r.start_ms // M, r.end_ms // M, r.max_speed) for r in reports.fast_spans(df, events, trips).orderBy("start_ms").collect()]
    assert ends(True) == [(0, 4, 0.0), (24, 25, 0.0)] and ends(False) == [(4, 24, 0.0)]
    assert ends(True) == [(r.start_ms // M, r.end_ms // M, r.max_speed) for r in reports.spans(df, events, 0, 2 * 86_400_000, True).orderBy("start_ms").collect()]
    with pytest.raises(ValueError):
        reports.spans(df, events, 0, 2 * 86_400_000, True, limit_s=86_400)


def test_odometer_and_fuel_rules(spark):
    df = positions(spark, [(1, 0, 5, 0), (2, 10, 5, 900)]).withColumns({"odometer": F.col("id") * 500.0, "fuel": F.lit(None).cast("double"), "fuel_level": 50.0 - F.col("id") * 10})
    spans = reports.slow_spans(df, True).withColumn("capacity", F.lit(60.0))
    r = reports.trips(spans, capacity="capacity").first()
    assert (r.distance, r.spent_fuel) == (500.0, 6.0) and reports.trips(spans, ignore_odometer=True).first().distance == 900.0
    assert reports.trips(spans.withColumns({"start_fuel": F.lit(1.0), "end_fuel": F.lit(3.0)})).first().spent_fuel == -2.0


def moves(algorithm, rows, **options):
    """Events of rows (seconds, metres east on the equator), with more fields by position."""
    made, last = [], None
    for i, (t, x, *more) in enumerate(rows):
        r = SimpleNamespace(id=i, device_id=1, fix_ms=t * 1000, latitude=0.0, longitude=(x + 5000) / 111_320, distance_mm=0 if last is None else round(abs(x - last) * 1000), **dict(more[0] if more else {}))
        made += [(kind, p.fix_ms // 1000) for kind, p in algorithm.decide(r)]
        last = x
    return made


def new(moving=False, d=500, t=300, gap=10**9):
    return folds.NewMotion(distance_m=d, duration_s=t, gap_s=gap, moving=moving)


def test_new_motion():
    assert moves(new(), [(0, 0), (120, 0), (240, 0), (300, 600)]) == [("deviceMoving", 240)]
    assert moves(new(True), [(0, 0), (120, 100), (240, 100), (360, 100)]) == [("deviceStopped", 360)]
    burst = [(0, 0), (60, 0), (120, 0), (150, 60), (180, 120), (181, 150)]
    assert moves(new(True, 200, 180), burst) == [] and moves(new(True, 200, 180), burst + [(241, 150)]) == [("deviceStopped", 241)]
    assert moves(new(True), [(0, 0), (60, 100), (120, 100)]) == [] and moves(new(True), [(0, 0), (120, 0), (180, 600)]) == []
    # The leg to the row itself may be slow; the walk back stops at slow legs and at the last event.
    assert moves(new(), [(0, 0), (60, 0), (100, 200), (140, 400), (200, 520)]) == [("deviceMoving", 60)]
    assert moves(new(True, gap=600), [(0, 0), (60, 0), (700, 5000)]) == [("deviceStopped", 60), ("deviceMoving", 60), ("deviceStopped", 700)]
    assert moves(new(gap=600), [(0, 0), (60, 0), (700, 5000)]) == [("deviceMoving", 60), ("deviceStopped", 700)]


def test_motion_of_four_states():
    say = lambda speed=0.0, quality="GOOD", valid=True: {"speed": speed, "quality": quality, "valid": valid}
    v2 = lambda rows: moves(folds.MotionV2(), rows)
    still = [(1000 + t, 0, say()) for t in range(0, 70, 10)]
    assert v2(still) == [("PAUSED", 1000), ("STOPPED", 1050)]  # the first fix is decided by Doppler alone
    assert v2([(1000, 0, say(20.0)), (1010, 100, say(20.0)), (1020, 101, say(0.0))]) == [("MOVING", 1000), ("PAUSED", 1020)]
    assert v2([(1000, 0, say(0.0)), (1010, 100, say(0.0))]) == [("PAUSED", 1000), ("MOVING", 1010)]
    assert v2([*still, (1070, 60, say())]) == [("PAUSED", 1000), ("STOPPED", 1050), ("MOVING", 1070)]
    assert v2([(1000, 0, say()), (1400, 0, say()), (1410, 0, say())]) == [("PAUSED", 1000), ("UNKNOWN", 1400), ("PAUSED", 1410)]
    # An invalid row moves the time on, not the place: the next step counts from the last place.
    assert v2([(1000, 0, say()), (1010, 500, say(valid=False)), (1020, 2, say())]) == [("PAUSED", 1000), ("UNKNOWN", 1010), ("PAUSED", 1020)]
    assert v2([(1000, 0, say()), (1010, 0, say(quality="POOR")), (1010, 0, say())]) == [("PAUSED", 1000), ("UNKNOWN", 1010)]


def test_filters_together(spark):
    rows = [(1, 0, 0, 0.0, "a"), (2, 0, 0, 0.0, "a"), (3, 0, 0, 0.0, None), (4, 10, 10, 0.001, None), (5, 20, 9000, 0.001, None), (6, 30, 9010, 0.5, "a")]
    df = spark.createDataFrame([(i, 1, f * 1000, t * 1000, 1.0, x, alarm) for i, f, t, x, alarm in rows], "id long, device_id long, fix_ms long, server_ms long, latitude double, longitude double, alarm string")
    got = {r.id: r.filters for r in folds.judged(df, {"Static": F.col("id") == 4}, keys=["alarm"], duplicates=True, min_distance_m=200, max_speed_kn=500, skip_limit_s=600).collect()}
    assert got == {1: "", 2: "Distance,Duplicate", 3: "Distance,Duplicate", 4: "Distance,Static", 5: "", 6: "MaxSpeed"}
    assert folds.judged(df, keys=["alarm"], duplicates=True, min_distance_m=200, max_speed_kn=500, skip_keys=["alarm"], exempt=F.col("id") == 6).where("filters = ''").count() == 3


def test_motion_by_duration_or_distance(spark):
    df = positions(spark, [(1, 0, 0, 0), (2, 2, 1, 100), (3, 2, 1, 700), (4, 3, 0, 700), (5, 10, 0, 700)])
    e = folds.motion_events(df, distance_m=500, trip_s=300, parking_s=300, no_data_s=0).orderBy("event_ms").collect()
    assert [(r.type, r.event_ms) for r in e] == [("deviceMoving", 2 * M), ("deviceStopped", 3 * M)]


def test_overspeed_fires_once_a_stretch(spark):
    df = spark.createDataFrame([(i, 1, t * 1000, float(v)) for i, (t, v) in enumerate([(0, 50), (10, 55), (20, 55), (30, 55), (31, 30)])], "id long, device_id long, fix_ms long, speed double")
    e = events.overspeed(df, F.lit(40.0), 15).collect()
    assert [(r.event_ms, r.speed, r.speed_limit) for r in e] == [(20_000, 55.0, 40.0)]


def test_polygons(spark):
    cases = [
        ("POLYGON ((55.75474 37.61823, 55.75513 37.61888, 55.7535 37.6222, 55.75315 37.62165))", 55.75476, 37.61915, True),
        ("POLYGON ((55.75474 37.61823, 55.75513 37.61888, 55.7535 37.6222, 55.75315 37.62165))", 55.75545, 37.61921, False),
        ("POLYGON ((66.9494 179.838, 66.9508 -179.8496, 66.8406 -180.0014))", 66.9015, -180.0096, True),
        ("POLYGON ((66.9494 179.838, 66.9508 -179.8496, 66.8406 -180.0014))", 66.9015, 179.991, True),
        ("POLYGON ((66.9494 179.838, 66.9508 -179.8496, 66.8406 -180.0014))", 66.8368, -179.8792, False),
        ("POLYGON ((51.1966 -0.6207, 51.1897 0.4147, 50.9377 0.5136, 50.8675 -0.6082))", 51.0466, 0.017, True),
        ("POLYGON ((51.1966 -0.6207, 51.1897 0.4147, 50.9377 0.5136, 50.8675 -0.6082))", 50.9477, 0.5836, False),
    ]
    df = spark.createDataFrame(cases, "area string, lat double, lon double, want boolean")
    assert df.where(geo.in_polygon(F.col("lat"), F.col("lon"), geo.points(F.col("area"))) != F.col("want")).count() == 0


def test_distances(spark):
    r = spark.range(1).select(
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.05), F.lit(0.05)).alias("h"),
        geo.distance_to_line(*map(F.lit, (56.83801, 60.59748, 56.83777, 60.59833, 56.83766, 60.5968))).alias("d"),
    ).first()
    assert abs(r.h - 7863) < 10 and abs(r.d - 33) < 5


def test_last_of_equal_times_is_smallest_id(spark):
    df = spark.createDataFrame([(3, 1, 10), (2, 1, 10), (1, 1, 5)], "id long, device_id long, fix_ms long")
    assert request.latest(df).first().id == 2
    assert [r.id for r in request.query(df, order=request.Order("fix_ms", True)).collect()] == [2, 3, 1]


def test_midnight_is_in_both_days(spark):
    day = 86_400_000
    df = spark.createDataFrame([(1, 1, day - 1), (2, 1, day), (3, 1, day + 1)], "id long, device_id long, fix_ms long").withColumns({"speed": F.lit(1.0), "total_mm": F.col("id"), "fuel": F.lit(1.0), "hours_ms": F.lit(0).cast("long")})
    assert [(r.day, r.start_ms, r.end_ms) for r in reports.daily_summary(df).orderBy("day").collect()] == [(0, day - 1, day), (1, day, day + 1)]


def test_maintenance_truncates(spark):
    df = spark.createDataFrame([(i, 1, i, v) for i, v in enumerate([0.0, 90.0, 110.0, 150.0, 210.0])], "id long, device_id long, fix_ms long, v double")
    assert [r.value for r in events.maintenance(df, "v", 100, 100).orderBy("event_ms").collect()] == [110.0, 210.0]


def test_geofence_exit_and_enter(spark):
    p = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3)], "id long, device_id long, fix_ms long")
    t = spark.createDataFrame([(1, 7), (2, 7), (2, 8), (3, 8)], "id long, geofence_id long")
    assert sorted((r.position_id, r.type, r.geofence_id) for r in events.geofence(t, p).collect()) == [(1, "geofenceEnter", 7), (2, "geofenceEnter", 8), (3, "geofenceExit", 7)]


def test_rollover_and_text(spark):
    week = 7 * 86_400_000
    r = spark.range(1).select(
        pipeline.rollover(F.lit(1_000_000_000_000) - 1024 * week, 1_000_000_000_000).alias("t"), text.nmea_checksum(F.lit("GPRMC,1")).alias("c"),
        text.flexible_millis(F.lit("1700000000")).alias("s"), text.flexible_millis(F.lit("2023-11-14T22:13:20Z")).alias("i"), text.dm_to_degrees(F.lit("4030.0"), F.lit("S")).alias("d"),
    ).first()
    assert r.t == 1_000_000_000_000 and r.s == r.i == 1_700_000_000_000 and r.d == -40.5
    x = 0
    for ch in "GPRMC,1":
        x ^= ord(ch)
    assert r.c == f"{x:02X}"


def test_empty_tables(spark):
    df = positions(spark, [(1, 0, 0, 0)]).where("false")
    assert folds.motion_events(df).count() == 0 and reports.trips(reports.slow_spans(df, True)).count() == 0
    assert reports.stops(reports.fast_spans(df, folds.motion_events(df), False)).count() == 0
