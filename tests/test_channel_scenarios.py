"""The mobile channel, OBD values and group hierarchies on small scenarios."""

from pyspark.sql import functions as F

from roadtrace.functions import codec
from roadtrace.operators import channel, hierarchy


def test_refused_requests_are_no_attempts(spark):
    rows = [(1, i, t * 1000, True, "t", False) for i, t in enumerate((0, 600, 1200, 1900, 2100, 3000, 3599, 3600, 3601, 4500))]
    rows += [(2, 1, 0, False, "t", False), (2, 2, 1000, True, None, False), (2, 3, 2000, True, "t", True), (2, 4, 3000, True, "t", False), (2, 5, 3000, True, "t", False)]
    df = spark.createDataFrame(rows, "device_id long, id long, ts long, enabled boolean, token string, active boolean")
    got = {(r.device_id, r.id): r.decision for r in channel.eligibility(df, 900, 3).collect()}
    assert [got[1, i] for i in range(10)] == ["allow", "cooldown", "allow", "cooldown", "allow", "hourly_limit", "hourly_limit", "hourly_limit", "allow", "cooldown"]
    assert [got[2, i] for i in range(1, 6)] == ["disabled", "no_token", "active", "allow", "cooldown"]


def test_telemetry_needs_both_values(spark):
    schema = "device_id long, id long, fix_ms long, gps_on boolean, network string, battery double, journey_started boolean, journey_ended boolean, net_cause string, net_conf string"
    rows = [
        (None, None, None, None, None, None, None), (True, "wifi", 50.0, True, None, None, None), (None, None, None, None, False, None, None),
        (False, "mobile", -1.0, None, None, "airplane", "confirmed"), (True, "none", 12.0, None, None, " ", "sure"), (None, "wifi", 10.0, None, True, None, "suspected"), (None, "none", 9.0, None, None, "x", None),
    ]
    df = spark.createDataFrame([(1, i, i * 1000, *r) for i, r in enumerate(rows)], schema)
    got = sorted(((r.position_id, r.type, r.cause, r.confidence) for r in channel.telemetry_changes(df).collect()), key=repr)
    assert got == sorted([
        (1, "journeyStart", None, None), (3, "gpsOff", None, None), (3, "wifiLost", "airplane", "confirmed"), (4, "gpsOn", None, None), (4, "networkLost", "inferred", "inferred"),
        (5, "networkRestored", "inferred", "suspected"), (5, "batteryLow", None, None), (5, "journeyEnd", None, None), (6, "networkLost", "x", "inferred"),
    ], key=repr)


def test_movement_ends_the_wait(spark):
    at = [(0, 1.0), (300, 1.0), (360, 2.0), (600, 2.0), (660, 2.0), (700, 3.0)]
    df = spark.createDataFrame([(1, i, t * 1000, x, x, True) for i, (t, x) in enumerate(at)], "device_id long, id long, fix_ms long, latitude double, longitude double, motion boolean")
    assert [r.event_ms for r in channel.stalled(df, 240, 360, 360).collect()] == [300_000, 600_000]


def test_mqtt_connects_again_in_two_steps(spark):
    minutes = {1: [(0, True)], 2: [(0, True), (10, True)], 3: [(0, True), (10, True), (11, True)], 4: [(0, False), (1, False)], 5: [(0, True), (2, False), (4, False)], 6: [(0, True), (10, True), (20, False)]}
    rows = [(d, i, m * 60_000, q) for d, arrivals in minutes.items() for i, (m, q) in enumerate(arrivals)]
    df = spark.createDataFrame(rows, "device_id long, id long, server_ms long, mqtt boolean")
    at = lambda m: dict(map(tuple, channel.mqtt_states(df, m * 60_000).collect()))
    assert at(12) | {6: None} == {1: "DISCONNECTED", 2: "CONNECTING", 3: "CONNECTED", 4: "UNKNOWN", 5: "DISCONNECTED", 6: None}
    assert at(21)[6] == "CONNECTING" and at(30)[3] == "DISCONNECTED"
    latest = spark.createDataFrame([(1, 0, True, "wifi", True, -1, 5), (2, 0, True, "wifi", True, 3, 5), (9, 0, False, None, True, 3, 3)], "device_id long, fix_ms long, gps_ok boolean, network string, validated boolean, pending long, pending_before long")
    got = {r.device_id: (r.mqtt, r.outbox) for r in channel.dimensions(latest, channel.mqtt_states(df, 720_000), 720_000).collect()}
    assert got == {1: ("DISCONNECTED", "EMPTY"), 2: ("CONNECTING", "DRAINING"), 9: ("UNKNOWN", "PENDING")}


def test_obd_divides_whole_numbers(spark):
    cases = [(0x0C, 1001, 250), (0x04, 7, 2), (0x05, 10, -30), (0x0F, 50, 10), (0x0B, 99, 99), (0x11, 255, 100), (0x21, 70000, 70000), (0x2F, 128, 50), (0x31, 3, 3), (0x0D, 88, 88), (0x99, 5, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "pid int, value long")
    assert [r.v for r in df.select(codec.obd(F.col("pid"), F.col("value"))[1].alias("v")).collect()] == [c[2] for c in cases]


def test_groups_of_any_depth(spark):
    """Twelve levels, a cycle, a group that is its own, and one whose parent is missing."""
    links = [(i, i - 1 if i > 1 else None) for i in range(1, 14)] + [(20, 22), (21, 20), (22, 21), (30, 30), (40, 99)]
    groups = spark.createDataFrame(links, "id long, group_id long")
    got = {(r.group_id, r.ancestor_id): r.distance for r in hierarchy.closure(groups).collect()}
    want = {(i, j): i - j for i in range(1, 14) for j in range(1, i + 1)} | {(30, 30): 0, (40, 40): 0, (40, 99): 1}
    want |= {(20, 20): 0, (21, 21): 0, (22, 22): 0, (20, 22): 1, (20, 21): 2, (21, 20): 1, (21, 22): 2, (22, 21): 1, (22, 20): 2}
    assert got == want
    assert sorted(r.id for r in hierarchy.descendants(groups, [11, 20]).collect()) == [11, 12, 13, 20, 21, 22]
    devices = spark.createDataFrame([(100, 13), (101, 4), (102, 1), (103, 21), (104, None), (105, 13)], "id long, group_id long")
    own, of = spark.createDataFrame([(105, 9.0)], "id long, value double"), spark.createDataFrame([(2, 2.0), (9, 90.0), (20, 20.0), (1, None)], "group_id long, value double")
    assert {r.id: r.value for r in hierarchy.looked_up(devices, groups, own, of, 7.0).collect()} == {100: 90.0, 101: 2.0, 102: 7.0, 103: 20.0, 104: 7.0, 105: 9.0}
    assert {r.id: r.value for r in hierarchy.looked_up(devices, groups, own, of, 7.0, server=5.0).collect()}[104] == 5.0
    user = spark.createDataFrame([(1, 2)], "user_id long, group_id long")
    none = spark.createDataFrame([], "user_id long, device_id long")
    assert sorted(r.device_id for r in hierarchy.permitted_devices(none, user, groups, devices).collect()) == [100, 101, 105]
