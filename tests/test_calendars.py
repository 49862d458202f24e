"""Calendars: rules against plain expectations, and periods against a walk over every day."""

import datetime as dt
import random
import re
from zoneinfo import ZoneInfo

import pytest

from roadtrace.operators import calendars


def event(start, end, *more, zone=None):
    tz = f";TZID={zone}" if zone else ""
    return "\r\n".join(["BEGIN:VCALENDAR", "VERSION:2.0", "BEGIN:VEVENT", "UID:1", f"DTSTART{tz}:{start}", f"DTEND{tz}:{end}", *more, "END:VEVENT", "END:VCALENDAR"])


def ms(text):
    return int(dt.datetime.fromisoformat(text).timestamp() * 1000)


def opened(spark, text, *moments):
    at = [ms(m) for m in moments]
    cal = spark.createDataFrame([(1, text)], "calendar_id long, data string")
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(at)], "id long, fix_ms long, calendar_id long")
    got = {r.id for r in calendars.open_at(rows, calendars.periods(calendars.events(cal), min(at), max(at))).collect()}
    return [i in got for i in range(len(at))]


NIGHT = """BEGIN:VCALENDAR
BEGIN:VTIMEZONE
TZID:Asia/Yekaterinburg
BEGIN:STANDARD
DTSTART:19700101T000000
END:STANDARD
END:VTIMEZONE
BEGIN:VEVENT
RRULE:FREQ=DAILY
DTSTART;TZID=Asia/Yekaterinburg:20161130T230000
DTEND;TZID=Asia/Yekaterinburg:20161201T070000
END:VEVENT
END:VCALENDAR"""


@pytest.mark.parametrize("text, moments, want", [
    (NIGHT, ["2016-12-13T22:59:59+05:00", "2016-12-13T23:00:01+05:00", "2016-12-13T06:59:59+05:00", "2016-12-13T07:00:01+05:00"], [False, True, True, False]),
    (event("20240420T060000", "20240421T060000", "RRULE:FREQ=DAILY", zone="America/Los_Angeles"), ["2014-05-13T07:00:00-07:00", "2024-05-13T05:00:00-07:00", "2024-05-13T08:00:00-07:00"], [False, True, True]),
    (event("20250809T100000Z", "20250809T110000Z"), ["2025-08-09T09:30:00+00:00", "2025-08-09T10:30:00+00:00"], [False, True]),
    (event("20250809T120000", "20250809T130000", zone="Asia/Dubai"), ["2025-08-09T11:30:00+04:00", "2025-08-09T12:30:00+04:00"], [False, True]),
    (event("20250809T150000", "20250811T150000"), ["2025-08-01T12:00:00+00:00", "2025-08-10T12:00:00+00:00"], [False, True]),
    (event("20250809", "20250811"), ["2025-08-01T12:00:00+00:00", "2025-08-10T12:00:00+00:00"], [False, True]),
    (event("20250809T100000Z", "20250809T110000Z", "RRULE:FREQ=WEEKLY;COUNT=4"), ["2025-08-16T09:30:00+00:00", "2025-08-16T10:30:00+00:00", "2025-08-30T10:30:00+00:00", "2025-09-06T10:30:00+00:00"], [False, True, True, False]),
    (event("20250809T093000", "20250809T103000", "RRULE:FREQ=MONTHLY;COUNT=6", zone="Asia/Dubai"), ["2025-10-09T09:00:00+04:00", "2025-10-09T10:00:00+04:00"], [False, True]),
    # Days on which clocks change: the wall's time stays, and the length is elapsed time.
    (event("20240301T080000", "20240301T090000", "RRULE:FREQ=DAILY", zone="Europe/Madrid"), ["2024-03-30T07:30:00+00:00", "2024-03-31T06:30:00+00:00", "2024-03-31T07:30:00+00:00", "2024-10-27T07:30:00+00:00"], [True, True, False, True]),
    (event("20240330T230000", "20240331T070000", "RRULE:FREQ=DAILY", zone="Europe/Madrid"), ["2024-03-31T04:59:00+00:00", "2024-03-31T05:00:00+00:00", "2024-04-01T03:59:00+00:00", "2024-04-01T04:00:00+00:00"], [True, False, True, False]),
    (event("20240131T100000Z", "20240131T110000Z", "RRULE:FREQ=MONTHLY"), ["2024-02-29T10:30:00+00:00", "2024-03-02T10:30:00+00:00", "2024-03-31T10:30:00+00:00"], [False, False, True]),
    (event("20240101T100000Z", "20240101T110000Z", "RRULE:FREQ=DAILY;UNTIL=20240103", "EXDATE:20240102T100000Z", "RDATE:20240109T100000Z"), [f"2024-01-{d:02}T10:30:00+00:00" for d in (1, 2, 3, 4, 9)], [True, False, True, False, True]),
    (event("20240101T001000Z", "20240101T002000Z", "RRULE:FREQ=HOURLY;INTERVAL=2"), ["2024-03-05T02:15:00+00:00", "2024-03-05T03:15:00+00:00"], [True, False]),
    (event("20240101T100000Z", "20240101T110000Z", "RRULE:FREQ=DAILY;BYSETPOS=1"), ["2024-01-01T10:30:00+00:00"], [False]),
    ("BEGIN:VCALENDAR\nBEGIN:VEVENT\nDTSTART;TZID=No/Where:20240101T100000\nDURATION:P1DT\n  2H30M\nBEGIN:VALARM\nDURATION:P9D\nEND:VALARM\nEND:VEVENT\nEND:VCALENDAR", ["2024-01-02T12:29:00+00:00", "2024-01-02T12:30:00+00:00"], [True, False]),
])
def test_moments(spark, text, moments, want):
    assert opened(spark, text, *moments) == want


def plain(start, until, freq, interval, parts):
    """Days of a rule between two dates, by looking at each day."""
    names = "MO TU WE TH FR SA SU".split()
    day = start
    while day <= until:
        last = ((day.replace(day=28) + dt.timedelta(4)).replace(day=1) - dt.timedelta(1)).day
        months = (day.year - start.year) * 12 + day.month - start.month
        weeks = ((day - dt.timedelta(day.weekday())) - (start - dt.timedelta(start.weekday()))).days // 7
        on = {"DAILY": (day - start).days, "WEEKLY": weeks, "MONTHLY": months, "YEARLY": day.year - start.year}[freq] % interval == 0
        name, n, m = names[day.weekday()], (day.day - 1) // 7 + 1, (last - day.day) // 7 + 1
        if "BYDAY" in parts:
            on &= bool({name, f"{n}{name}", f"-{m}{name}"} & set(parts["BYDAY"].split(",")))
        elif freq == "WEEKLY":
            on &= day.weekday() == start.weekday()
        if "BYMONTHDAY" in parts:
            on &= bool({day.day, day.day - last - 1} & set(map(int, parts["BYMONTHDAY"].split(","))))
        elif freq in ("MONTHLY", "YEARLY") and "BYDAY" not in parts:
            on &= day.day == start.day
        if "BYMONTH" in parts:
            on &= day.month in map(int, parts["BYMONTH"].split(","))
        elif freq == "YEARLY":
            on &= "BYDAY" in parts or day.month == start.month
        if on or day == start:
            yield day
        day += dt.timedelta(1)


def test_rules_are_brute_force(spark):
    r = random.Random(3)
    zones = ["Europe/Madrid", "America/New_York", "Asia/Kolkata", "Pacific/Auckland"]
    lo, hi = dt.date(2023, 1, 1), dt.date(2025, 12, 31)
    cals, want = [], set()
    for i in range(120):
        freq = r.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
        parts = {}
        if r.random() < 0.6:
            days = r.sample("MO TU WE TH FR SA SU".split(), 2)
            parts["BYDAY"] = ",".join(f"{r.choice([1, 2, -1])}{d}" if freq == "MONTHLY" and r.random() < 0.5 else d for d in days)
        elif r.random() < 0.4 and freq != "WEEKLY":
            parts["BYMONTHDAY"] = "1,15,31,-2"
        if r.random() < 0.3:
            parts["BYMONTH"] = "2,3,11"
        interval, start, zone = r.randrange(1, 4), dt.date(2019, 1, 1) + dt.timedelta(r.randrange(2000)), r.choice(zones)
        days = list(plain(start, hi, freq, interval, parts))
        rule = f"RRULE:FREQ={freq};INTERVAL={interval}" + "".join(f";{k}={v}" for k, v in parts.items())
        if r.random() < 0.3:
            n = r.randrange(1, 60)
            rule, days = f"{rule};COUNT={n}", days[:n]
        cals.append((i, event(f"{start:%Y%m%d}T093000", f"{start:%Y%m%d}T113000", rule, zone=zone)))
        for d in days:
            a = int(dt.datetime(d.year, d.month, d.day, 9, 30, tzinfo=ZoneInfo(zone)).timestamp() * 1000)
            want |= {(i, a, a + 7_200_000)} if a + 7_200_000 > ms(f"{lo}T00:00:00+00:00") and a <= ms(f"{hi}T00:00:00+00:00") else set()
    found = calendars.events(spark.createDataFrame(cals, "calendar_id long, data string"))
    got = calendars.periods(found, ms(f"{lo}T00:00:00+00:00"), ms(f"{hi}T00:00:00+00:00")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_rows_without_calendars_and_plan(spark):
    cals = spark.createDataFrame([(i, event("20240101T100000Z", "20240101T110000Z", "RRULE:FREQ=DAILY")) for i in range(10_000)] + [(-1, None), (-2, ""), (-3, "BEGIN:VEVENT\nDTSTART:soon\nEND:VEVENT")], "calendar_id long, data string")
    low = ms("2024-02-01T00:00:00+00:00")
    rows = spark.createDataFrame([(1, None, None), (2, low, None), (3, None, 5), (4, low + 36_000_000, 5), (4, low + 36_000_000, 5), (5, low + 39_600_000, 5), (6, low + 36_000_000, -1)], "id long, fix_ms long, calendar_id long").selectExpr("*", "id as start_ms")
    got = calendars.open_at(rows, calendars.periods(calendars.events(cals), low, low + 3 * calendars.DAY))
    assert sorted(x.id for x in got.collect()) == [1, 2, 4, 4] and got.columns == rows.columns
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().toString())
    assert calendars.periods(calendars.events(cals.where("false")), low, low).count() == 0
