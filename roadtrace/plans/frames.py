"""Queries over frames of tracking devices. Frames are put together from positions; their SQL has the values that went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames
from .catalog import pos, query

DAY = 86_400_000


def _digits(c, n: int):
    return F.lpad(c.cast("string"), n, "0")


def _hex(c, width: int):
    return F.lpad(F.hex(c.cast("long").bitwiseAND(F.lit((1 << 8 * width) - 1))), 2 * width, "0")


def _clock():
    s = F.floor(F.pmod("fix_ms", F.lit(DAY)) / 1000)
    return [F.floor(s / 3600), F.floor(s / 60) % 60, s % 60]


def _date():
    return F.date_from_unix_date(F.floor(F.col("fix_ms") / DAY).cast("int"))


def _shown(df, columns, *more, places: int = 9):
    return df.select("id", *[F.round(c, places).alias(n) if n in ("latitude", "longitude", "speed") else c.alias(n) for n, c in columns.items()], *more)


# A whole frame that has something behind its end is none: one of eleven rows.
@query("decode_text_frames", """SELECT id, CASE WHEN ok THEN CAST(device_id AS VARCHAR) END AS unique_id, CASE WHEN ok THEN fix_ms END AS fix_ms, CASE WHEN ok THEN id % 3 = 0 END AS valid,
  CASE WHEN ok THEN round((id % 90 + id * 7919 % 600000 / 600000e0) * CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END, 9) END AS latitude,
  CASE WHEN ok THEN round((id * 7 % 180 + id * 104729 % 600000 / 600000e0) * CASE WHEN id % 5 = 0 THEN -1 ELSE 1 END, 9) END AS longitude,
  CASE WHEN ok THEN id % 200 + 0.5e0 END AS speed, CASE WHEN ok AND id % 4 <> 0 THEN CAST(id % 360 AS DOUBLE) END AS course, CASE WHEN ok AND id % 7 <> 0 THEN 'FFFFFBFF' END AS status
FROM (SELECT *, id % 11 <> 0 AS ok FROM p)""")  # fmt: skip
def _(s, d):
    i = F.col("id")
    axis = lambda deg, n, ten: F.when(i % 6 == 1, F.concat(F.lit("-"), _digits(deg, n), F.lit("-"), _digits(F.floor(ten / 10000), 2), F.lit("."), _digits(ten % 10000, 4))).when(i % 6 == 2, F.concat(_digits(deg, n), _digits(ten, 6))).otherwise(F.concat(_digits(deg, n), _digits(F.floor(ten / 10000), 2), F.lit("."), _digits(ten % 10000, 4)))
    frame = F.concat(
        F.lit("*HQ,"), F.col("device_id").cast("string"), F.lit(",V1,"), *[_digits(x, 2) for x in _clock()], F.lit(","), F.element_at(F.array(F.lit("A"), F.lit("V"), F.lit("")), (i % 3 + 1).cast("int")), F.lit(","),
        axis(i % 90, 2, i * 7919 % 600000), F.when(i % 2 == 0, ",N,").otherwise(",S,"), axis(i * 7 % 180, 3, i * 104729 % 600000), F.when(i % 5 == 0, ",W,").otherwise(",E,"),
        (i % 200).cast("string"), F.lit(".5,"), F.when(i % 4 != 0, (i % 360).cast("string")).otherwise(""), F.lit(","), F.date_format(_date(), "ddMMyy"), F.when(i % 7 != 0, ",FFFFFBFF,0,1").otherwise(""), F.lit("#"), F.when(i % 11 == 0, "?").otherwise(""),
    )
    return _shown(pos(s, d).select("id", frame.alias("frame")), frames.position(F.col("frame"), *frames.STAR))


@query("decode_query_strings", """SELECT id, CAST(device_id AS VARCHAR) AS unique_id, fix_ms, id % 4 <> 0 AS valid, round(id % 90 + 0.25e0, 9) AS latitude, round(-(id % 180) - 0.5e0, 9) AS longitude,
  CAST(id % 100 AS DOUBLE) AS speed, CASE WHEN id % 5 <> 0 THEN CAST(id % 360 AS DOUBLE) END AS course, alarm, CAST(CASE WHEN alarm IS NULL THEN 1 ELSE 2 END AS INTEGER) AS attributes FROM p""")
def _(s, d):
    i = F.col("id")
    text = lambda c: c.cast("string")
    q = F.concat_ws(
        "&", F.concat(F.lit("id="), text(F.col("device_id"))), F.concat(F.lit("timestamp="), text(F.when(i % 2 == 0, F.col("fix_ms")).otherwise(F.floor(F.col("fix_ms") / 1000)))), F.when(i % 4 == 0, F.lit("valid=false")),
        F.when(i % 3 == 0, F.concat(F.lit("location="), text(i % 90), F.lit(".25%2C-"), text(i % 180), F.lit(".5"))).otherwise(F.concat(F.lit("lat="), text(i % 90), F.lit(".25&lon=-"), text(i % 180), F.lit(".5"))),
        F.concat(F.lit("speed="), text(i % 100)), F.when(i % 5 != 0, F.concat(F.lit("bearing="), text(i % 360))), F.lit("batt=9"), F.concat(F.lit("alarm="), F.url_encode("alarm")),
    )
    c = frames.fields_of(F.col("x"))
    m = c.pop("attributes")
    return _shown(pos(s, d).select("id", frames.query_fields(q).alias("x")), {n: x for n, x in c.items() if n not in ("altitude", "accuracy")}, F.element_at(m, "alarm").alias("alarm"), F.size(m).alias("attributes"))


@query("decode_location_bytes", """SELECT id, fix_ms, id % 5 <> 0 AS valid, id % 13 AS satellites, round(id * 7919 % 162000000 / 1800000e0 * CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END, 9) AS latitude,
  round(id * 104729 % 324000000 / 1800000e0 * CASE WHEN id % 3 = 0 THEN -1 ELSE 1 END, 9) AS longitude, round(id % 200 * 0.539957e0, 9) AS speed, id % 360 AS course FROM p""")  # fmt: skip
def _(s, d):
    i, day = F.col("id"), _date()
    flags = i % 360 + F.when(i % 2 == 0, 1 << 10).otherwise(0) + F.when(i % 3 == 0, 1 << 11).otherwise(0) + F.when(i % 5 != 0, 1 << 12).otherwise(0)
    parts = [(F.lit(0x7878), 2), (F.lit(23), 1), (F.lit(0x12), 1), (F.year(day) - 2000, 1), (F.month(day), 1), (F.dayofmonth(day), 1), *[(x, 1) for x in _clock()], (0xC0 + i % 13, 1), (i * 7919 % 162000000, 4), (i * 104729 % 324000000, 4), (i % 200, 1), (flags, 2), (i % 60000, 2), (F.lit(0), 2), (F.lit(0x0D0A), 2)]
    return _shown(pos(s, d).select("id", F.unhex(F.concat(*[_hex(c, w) for c, w in parts])).alias("b")), frames.location(F.col("b")))


#: A batch: the device, the number of its records, and the records.
RECORD = [("id", 4), ("value", -4), ("", 1), ("speed", 2)]


@query("decode_record_batches", "SELECT device_id, id, id * 7919 % 1000000 - 500000 AS value, id % 60000 AS speed FROM p")
def _(s, d):
    i = F.col("id")
    one = F.concat(_hex(i, 4), _hex(i * 7919 % 1000000 - 500000, 4), F.lit("00"), _hex(i % 60000, 2))
    batches = pos(s, d).groupBy("device_id", F.floor(i / 100).alias("k")).agg(F.array_sort(F.collect_list(one)).alias("r"))
    data = batches.select(F.unhex(F.concat(_hex(F.col("device_id"), 4), _hex(F.size("r"), 1), F.array_join("r", ""))).alias("b"))
    b = F.col("b")
    return data.select(frames.unsigned(b, 0, 4).alias("device_id"), F.explode(frames.records(b, frames.unsigned(b, 4, 1), RECORD, 5)).alias("x")).select("device_id", "x.id", "x.value", "x.speed")
