"""Queries over calendars. Their SQL tells by arithmetic on the zone's clock whether a rule holds, without expanding it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars
from ..sources import adapter
from ..sources.adapter import START_MS
from .catalog import GEO_EVENTS, SETS, TAGS, by, geo_events, pos, query

ZONES = ["Europe/Madrid", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "UTC"]
#: By nation key modulo 4: start, end and rule; INTERVAL=k stands for one, two or three, by the key.
SHOPS = [
    ("19920101T080000", "19920101T173000", "FREQ=DAILY;INTERVAL=k"),
    ("19920101T090000", "19920101T180000", "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,WE,FR"),
    ("19920106T060000", "19920106T200000", "FREQ=MONTHLY;BYDAY=-1FR,1MO"),
    ("19920101T100000", "19920101T160000", "FREQ=MONTHLY;BYMONTHDAY=1,15,-1;UNTIL=19961231T235959"),
]
#: Two calendars of the hours that `events` covers, open for 40 minutes of two hours and for 3 of 7 minutes.
HOURS = [(0, "20240101T000500Z", "20240101T004500Z", "FREQ=HOURLY;INTERVAL=2"), (1, "20240101T000000Z", "20240101T000300Z", "FREQ=MINUTELY;INTERVAL=7")]
#: calendar_id, and the condition in SQL that it is open at {t}.
OPEN = {0: f"{{t}} >= {START_MS + 300_000} AND ({{t}} - {START_MS + 300_000}) % 7200000 < 2400000", 1: f"{{t}} >= {START_MS} AND ({{t}} - {START_MS}) % 420000 < 180000"}


def _text(start, end, rule, zone=""):
    return F.concat(F.lit("BEGIN:VCALENDAR\nBEGIN:VEVENT\nDTSTART"), zone, F.lit(":"), start, F.lit("\nDTEND"), zone, F.lit(":"), end, F.lit("\nRRULE:"), rule, F.lit("\nEND:VEVENT\nEND:VCALENDAR\n"))


def _shops(s, d):
    """A calendar for each nation, in iCalendar text."""
    n = F.col("n_nationkey")
    of = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (n % by + 1).cast("int"))
    start, end, rule = (of([x[i] for x in SHOPS], 4) for i in range(3))
    zone = F.concat(F.lit(";TZID="), of(ZONES, 5))
    return adapter.read(s, d, "nation").select(n.cast("long").alias("calendar_id"), _text(start, end, F.regexp_replace(rule, F.lit("=k"), F.concat(F.lit("="), (n % 3 + 1).cast("string"))), zone).alias("data"))


@query("calendar_moments", f"""SELECT o_orderkey AS id, n AS calendar_id FROM (
  SELECT *, CAST(w AS DATE) AS day, epoch(CAST(w AS TIME)) / 60 AS minute FROM (
    SELECT o_orderkey, c_nationkey AS n, to_timestamp(epoch(CAST(o_orderdate AS DATE)) + o_orderkey % 1440 * 60) AT TIME ZONE (['{"', '".join(ZONES)}'][c_nationkey % 5 + 1]) AS w
    FROM orders JOIN customer ON o_custkey = c_custkey))
WHERE CASE n % 4
  WHEN 0 THEN day >= DATE '1992-01-01' AND (day - DATE '1992-01-01') % (n % 3 + 1) = 0 AND minute >= 480 AND minute < 1050
  WHEN 1 THEN day >= DATE '1992-01-01' AND (day - DATE '1991-12-30') // 7 % 2 = 0 AND isodow(day) IN (1, 3, 5) AND minute >= 540 AND minute < 1080
  WHEN 2 THEN day >= DATE '1992-01-06' AND ((isodow(day) = 1 AND day(day) <= 7) OR (isodow(day) = 5 AND last_day(day) - day < 7)) AND minute >= 360 AND minute < 1200
  ELSE day >= DATE '1992-01-01' AND day <= DATE '1996-12-31' AND (day(day) IN (1, 15) OR last_day(day) = day) AND minute >= 600 AND minute < 960 END""")  # fmt: skip
def _(s, d):
    at = F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86_400_000 + F.col("o_orderkey") % 1440 * 60_000
    customers = adapter.read(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("calendar_id"))
    rows = adapter.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", at.alias("fix_ms")).join(customers, "o_custkey")
    return calendars.open_at(rows, calendars.periods_for(rows.select("fix_ms"), calendars.events(_shops(s, d)))).select("id", "calendar_id")


def _hours(s):
    rows = s.createDataFrame(HOURS, "calendar_id long, a string, b string, rule string")
    return calendars.events(rows.select("calendar_id", _text(F.col("a"), F.col("b"), F.col("rule"), F.lit("")).alias("data")))


@query("filter_calendar_rules", f"SELECT id FROM p WHERE CASE device_id % 3 WHEN 0 THEN {OPEN[0]} WHEN 1 THEN {OPEN[1]} ELSE true END".format(t="fix_ms"))
def _(s, d):
    rows = pos(s, d).withColumn("calendar_id", F.when(F.col("device_id") % 3 < 2, F.col("device_id") % 3))
    return calendars.open_at(rows, calendars.periods_for(rows, _hours(s))).select("id")


def _gated(s, d):
    fences = adapter.geofences(s).select("geofence_id", F.when(F.col("geofence_id").isin(1, 3, 5), 0).when(F.col("geofence_id") == 2, 1).cast("long").alias("calendar_id"))
    found = geo_events(s, d)
    return calendars.geofence_gate(found, fences, calendars.periods_for(pos(s, d).select("fix_ms"), _hours(s))).select("device_id", "position_id", "event_ms", "type", "geofence_id")


by("ev_geofence_calendar", f"SELECT device_id, position_id, event_ms, type, geofence_id FROM ge WHERE CASE WHEN geofence_id IN (1, 3, 5) THEN {OPEN[0]} WHEN geofence_id = 2 THEN {OPEN[1]} ELSE true END".format(t="event_ms"), _gated, TAGS, SETS, GEO_EVENTS)
