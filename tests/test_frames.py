"""Frames of devices, as literal messages, and the cursor over bytes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadtrace.functions import frames


def ms(text):
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp() * 1000)


def test_text_frames(spark):
    cases = [
        ("*HQ,9001000002,V8,213945,A,3542.2043,N,38.6508,W,0.00,170,221025,FBFFF9FF,0,0,0,0,22,31,126,0#", "9001000002", "2025-10-22T21:39:45", True, 35.70340, -0.64418),
        ("*HQ,4210051415,V1,164549,A,0956.3869,N,08406.7068,W,000.00,000,221215,FFFFFBFF,712,01,0,0,6#", "4210051415", "2015-12-22T16:45:49", True, 9.93978, -84.11178),
        ("*HQ,355488020119695,V1,050418,,2827.61232,N,07703.84822,E,0.00,0,031015,FFFEFBFF#", "355488020119695", "2015-10-03T05:04:18", False, 28.46021, 77.06414),
        ("*HQ,1451316409,V1,030149,A,-23-29.0095,S,-46-51.5852,W,2.4,065,070315,FFFFFFFF#", "1451316409", "2015-03-07T03:01:49", True, -23.48349, -46.85975),
    ]
    none = ["", None, "*HQ,1#", "*HQ,353588020068342,V1,000000,V,0.0000,0,0.0000,0,0.00,0.00,000000,ffffffff,000106#", cases[0][0] + "x", cases[0][0][:-1] + "\x1f#"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate([c[0] for c in cases] + none)], "i int, f string")
    got = df.select("i", *[c.alias(n) for n, c in frames.position(F.col("f"), *frames.STAR).items()]).orderBy("i").collect()
    for r, (_, uid, at, valid, lat, lon) in zip(got, cases):
        assert (r.unique_id, r.fix_ms, r.valid) == (uid, ms(at), valid) and abs(r.latitude - lat) < 1e-5 and abs(r.longitude - lon) < 1e-5
    assert all(v is None for r in got[len(cases):] for v in r[1:])
    rmc = spark.createDataFrame([("$GPRMC,123519.00,V,4807.038,N,01131.000,W,022.4,,230394,003.1,W*6A",), ("$GPGGA,1",)], "f string")
    r, bad = rmc.select(*[c.alias(n) for n, c in frames.position(F.col("f"), *frames.RMC).items()]).collect()
    assert (r.valid, r.speed, r.course, r.unique_id, r.fix_ms) == (False, 22.4, None, None, ms("2094-03-23T12:35:19")) and abs(r.latitude - 48.1173) < 1e-6 and abs(r.longitude + 11.516667) < 1e-6
    assert bad.latitude is None and bad.valid is None


def test_location_bytes(spark):
    good = "78781f120f0a140e150bc505e51e780293a9e800540000f601006e0055da00035f240d0a"
    df = spark.createDataFrame([(bytes.fromhex(x) if x is not None else None,) for x in (good, good[:-2], "78780d01", "", None, "7979" + good[4:])], "b binary")
    got = df.select(*[c.alias(n) for n, c in frames.location(F.col("b")).items()]).collect()
    assert (got[0].fix_ms, got[0].valid, got[0].satellites, got[0].course) == (ms("2015-10-20T14:21:11"), True, 5, 0)
    assert abs(got[0].latitude - 54.94535) < 1e-5 and abs(got[0].longitude - 24.01762) < 1e-5
    assert all(v is None for r in got[1:] for v in r)


def test_cursor(spark):
    data = bytes([2, 0xFF, 0xFE, 1, 0x80, 0x00, 9, 0x01])
    df = spark.createDataFrame([(data,), (b"",), (None,)], "b binary")
    fields = [("a", -2), ("", 0), ("c", 1)]
    rows = df.select(
        frames.records(F.col("b"), frames.unsigned(F.col("b"), 0, 1), fields, 1).alias("r"), frames.records(F.col("b"), F.lit(99), fields, 1, little=True).alias("l"),
        frames.unsigned(F.col("b"), 1, 4).alias("u"), frames.bits(frames.unsigned(F.col("b"), 4, 1), 7).alias("bit"), frames.unsigned(F.col("b"), 7, 2).alias("past"),
    ).collect()
    assert [tuple(x) for x in rows[0].r] == [(-2, 1), (-32768, 9)] and [tuple(x) for x in rows[0].l] == [(-257, 1), (128, 9)]
    assert (rows[0].u, rows[0].bit, rows[0].past) == (0xFFFE0180, 1, None) and rows[1].r == [] and rows[1].u is None and not rows[2].r


@pytest.mark.parametrize("q, want", [
    ("id=123456&timestamp=1377177267&lat=60.0&lon=30.0&bearing=5&speed=2&batt=9%25&note=a+b", ("123456", 1_377_177_267_000, True, 60.0, 30.0, 2.0, 5.0, {"batt": "9%", "note": "a b"})),
    ("?deviceid=x&timestamp=1377177267000&location=-1.5,2&valid=false&id=", ("x", 1_377_177_267_000, False, -1.5, 2.0, None, None, {})),
    ("id=1&id=2&timestamp=2024-02-29T10:11:12Z&lat=here&=5&x", ("2", ms("2024-02-29T10:11:12"), True, None, None, None, None, {"x": ""})),
    ("", (None, None, True, None, None, None, None, {})),
    (None, (None, None, None, None, None, None, None, None)),
])
def test_query_strings(spark, q, want):
    r = spark.createDataFrame([(q,)], "q string").select(*[c.alias(n) for n, c in frames.query_string(F.col("q")).items()]).first()
    assert (r.unique_id, r.fix_ms, r.valid, r.latitude, r.longitude, r.speed, r.course, r.attributes) == want
