"""iCalendar calendars: recurrence rules as periods, and rows that fall into a calendar's periods.

Texts are taken apart, and rules expanded, by column expressions. An event's occurrences are made for the asked range only: the
first step of its rule that can reach the range follows from arithmetic, unless COUNT makes all steps before it matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000
#: Fixed values of RFC 5545.
WEEKDAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
SHORTEST = {"DAILY": 1, "WEEKLY": 7, "MONTHLY": 28, "YEARLY": 365}
LONGEST = {"DAILY": 1, "WEEKLY": 7, "MONTHLY": 31, "YEARLY": 366}
CLOCK = {"HOURLY": 3_600_000, "MINUTELY": 60_000}
PARTS = ["FREQ", "INTERVAL", "COUNT", "UNTIL", "WKST", "BYDAY", "BYMONTHDAY", "BYMONTH"]


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _wall(value: Column) -> Column:
    """A date, or date and time, as milliseconds since 1970 on the wall's clock."""
    day = F.unix_date(F.try_to_timestamp(F.substring(value, 1, 8), F.lit("yyyyMMdd")).cast("date")).cast("long")
    part = lambda at: F.coalesce(F.substring(value, at, 2).try_cast("long"), F.lit(0))
    return day * DAY + F.when(F.length(value) >= 15, part(10) * 3_600_000 + part(12) * 60_000 + part(14) * 1000).otherwise(0)


def instant(wall: Column, zone: Column) -> Column:
    """The moment at which clocks of a zone show wall; the earlier one of two, and past a gap as much as wall is in it."""
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(wall), zone))


def events(calendars: DataFrame) -> DataFrame:
    """The events of calendars (calendar_id, data), data being iCalendar text.

    calendar_id, zone, dated (a day without a time), start (on the wall's clock), length_ms, the rule's parts, except and more
    (EXDATE and RDATE, on the wall's clock) and unsupported, which names what periods() can't expand. A zone that isn't known,
    as that of a time without one, is UTC. Without an end or duration an event takes its day, if dated, or no time. Events
    without a readable start are left out, as are null and empty texts.
    """
    unfolded = F.regexp_replace(F.regexp_replace("data", r"\r\n?", "\n"), r"\n[ \t]", "")
    bodies = F.regexp_extract_all(F.regexp_replace(unfolded, r"(?s)BEGIN:VALARM.*?END:VALARM", ""), F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), 1)
    e = calendars.select("calendar_id", F.explode(bodies).alias("body"))
    line = lambda name, group: _filled(F.regexp_extract("body", rf"(?m)^\s*{name}((?:;[^:\n]*)?):[ ]*(.*?)\s*$", group))
    values = lambda name: F.flatten(F.transform(F.regexp_extract_all("body", F.lit(rf"(?m)^\s*{name}(?:;[^:\n]*)?:[ ]*(.*?)\s*$"), 1), lambda x: F.split(x, ",")))
    part = lambda name: _filled(F.regexp_extract("rule", rf"(?:^|;){name}=([^;]*)", 1))
    number = lambda name: part(name).try_cast("int")
    numbers = lambda name: F.transform(F.split(part(name), ","), lambda x: x.try_cast("int"))
    named = F.regexp_extract(F.coalesce(line("DTSTART", 1), F.lit("")), 'TZID="?([^;"]+)', 1)
    known = F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), named), F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull()
    e = e.select("calendar_id", "body", line("DTSTART", 2).alias("begin"), F.upper(F.coalesce(line("RRULE", 2), F.lit(""))).alias("rule"), F.when((named != "") & known, named).otherwise("UTC").alias("zone"))
    e = e.withColumn("zone", F.when(F.col("begin").endswith("Z"), "UTC").otherwise(F.col("zone"))).withColumn("start", _wall(F.col("begin"))).where("start is not null")
    # Other values of the event may be in UTC though its start isn't.
    local = lambda v: F.when(v.endswith("Z"), F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(_wall(v)), F.col("zone")))).otherwise(_wall(v))
    span = F.coalesce(line("DURATION", 2), F.lit(""))
    unit = lambda letter, ms, after="": F.coalesce(F.regexp_extract(span, rf"{after}([0-9]+){letter}", 1).try_cast("long"), F.lit(0)) * ms
    duration = unit("W", 7 * DAY) + unit("D", DAY) + unit("H", 3_600_000) + unit("M", 60_000, "T.*?") + unit("S", 1000, "T.*?")
    dated = F.length("begin") == 8
    end = instant(local(line("DTEND", 2)), F.col("zone")) - instant(F.col("start"), F.col("zone"))
    other = F.regexp_extract_all("rule", F.lit(r"(?:^|;)([A-Z]+)="), 1)
    freq = part("FREQ")
    strange = F.array_join(F.array_except(other, F.array(*map(F.lit, PARTS))), ",")
    clock = freq.isin(*CLOCK) & F.col("rule").contains(";BY")
    unsupported = (
        F.when(F.col("rule") == "", None).when(~F.coalesce(freq.isin(*SHORTEST, *CLOCK), F.lit(False)), F.coalesce(freq, F.lit("FREQ"))).when(strange != "", strange)
        .when(clock, freq).when((freq == "YEARLY") & part("BYDAY").rlike("[0-9]") & part("BYMONTH").isNull(), "BYDAY")
    )
    return e.select(
        "calendar_id", "zone", dated.alias("dated"), "start", F.greatest(F.lit(0), F.coalesce(end, F.when(span != "", duration), F.when(dated, DAY), F.lit(0))).cast("long").alias("length_ms"),
        freq.alias("freq"), F.greatest(F.lit(1), F.coalesce(number("INTERVAL"), F.lit(1))).alias("interval"), number("COUNT").alias("count"), unsupported.alias("unsupported"),
        F.when(F.length(part("UNTIL")) == 8, _wall(part("UNTIL")) + DAY - 1).otherwise(local(part("UNTIL"))).alias("until"),
        F.greatest(F.lit(0), F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.coalesce(part("WKST"), F.lit("MO"))) - 1).cast("int").alias("wkst"),
        F.split(part("BYDAY"), ",").alias("byday"), numbers("BYMONTHDAY").alias("bymonthday"), numbers("BYMONTH").alias("bymonth"),
        F.transform(values("EXDATE"), lambda v: F.struct((F.length(v) == 8).alias("dated"), local(v).alias("at"))).alias("except"),
        F.transform(values("RDATE"), local).alias("more"),
    )


def _by_freq(table: dict[str, int]) -> Column:
    return reduce(lambda c, kv: c.when(F.col("freq") == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0))


def _fits(day: Column) -> Column:
    """Whether the rule's parts hold on a day (a date); parts that the rule hasn't follow from its start, as its frequency asks."""
    first = F.date_from_unix_date(F.col("first_day").cast("int"))
    of_month, last, weekday = F.dayofmonth(day), F.dayofmonth(F.last_day(day)), F.weekday(day)
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), weekday + 1)
    nth = F.concat(F.ceil(of_month / 7).cast("string"), name)
    nth_last = F.concat(F.lit("-"), F.ceil((last - of_month + 1) / 7).cast("string"), name)
    by_name = F.exists("byday", lambda d: F.ltrim(d, F.lit("+")).isin(name, nth, nth_last))
    by_date = F.exists("bymonthday", lambda m: m.isin(of_month, of_month - last - 1))
    no_day, no_date = F.col("byday").isNull(), F.col("bymonthday").isNull()
    free = F.col("freq").isin("MONTHLY", "YEARLY") & no_day & no_date
    named = F.when(~no_day, by_name).otherwise((F.col("freq") != "WEEKLY") | (weekday == F.weekday(first)))
    dated = F.when(~no_date, by_date).otherwise(~free | (of_month == F.dayofmonth(first)))
    month = F.when(F.col("bymonth").isNotNull(), F.array_contains("bymonth", F.month(day))).otherwise((F.col("freq") != "YEARLY") | ~no_day | (F.month(day) == F.month(first)))
    return F.coalesce(named & dated & month, F.lit(False))


def periods(events: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    """calendar_id, start_ms, end_ms: what events() gives in [low_ms, high_ms], as moments; those of a calendar that meet or overlap are one.

    An event's start is its first occurrence, whether its rule fits it or not, and counts for COUNT. Days that a month lacks are
    passed over. All occurrences last as long in elapsed time as the first one. Events that are unsupported give none.
    """
    e = events.where("unsupported is null").withColumn("first_day", F.floor(F.col("start") / DAY))
    # Both ends with two days to spare for zones.
    low, high = F.lit(low_ms // DAY - 2).cast("long") - F.ceil(F.col("length_ms") / DAY), F.lit(high_ms // DAY + 2).cast("long")
    base = F.when(F.col("freq") == "WEEKLY", F.col("first_day") - F.pmod(F.weekday(F.date_from_unix_date(F.col("first_day").cast("int"))) - F.col("wkst"), F.lit(7))).otherwise(F.col("first_day"))
    skipped = lambda unit, at: F.when(F.col("count").isNotNull(), 0).otherwise(F.greatest(F.lit(0), F.floor((at - base) / (unit * F.col("interval")))))
    e = e.withColumn("base", F.date_from_unix_date(base.cast("int")))
    e = e.withColumn("i0", skipped(_by_freq(LONGEST), low) - 1).withColumn("i1", F.floor((high - base) / (_by_freq(SHORTEST) * F.col("interval"))) + 1)
    step = F.transform(F.when(F.col("i1") >= F.greatest("i0", F.lit(0)), F.sequence(F.greatest("i0", F.lit(0)), "i1")), lambda i: (i * F.col("interval")).cast("int"))
    month, year = F.trunc("base", "month"), F.trunc("base", "year")
    whole = lambda a, n: F.sequence(a, F.date_sub(F.add_months(a, n), 1))
    days = F.flatten(
        F.when(F.col("freq") == "DAILY", F.transform(step, lambda i: F.array(F.date_add("base", i))))
        .when(F.col("freq") == "WEEKLY", F.transform(step, lambda i: F.sequence(F.date_add("base", i * 7), F.date_add("base", i * 7 + 6))))
        .when(F.col("freq") == "MONTHLY", F.transform(step, lambda i: whole(F.add_months(month, i), 1)))
        .when(F.col("freq") == "YEARLY", F.transform(step, lambda i: whole(F.add_months(year, i * 12), 12)))
    )
    e = e.withColumn("x_days", days)
    at_days = F.transform(F.filter("x_days", _fits), lambda d: F.unix_date(d).cast("long") * DAY + F.col("start") % DAY)
    tick = _by_freq(CLOCK).cast("long") * F.col("interval")
    from_, to = F.when(F.col("count").isNotNull(), 0).otherwise(F.greatest(F.lit(0), F.floor((low * DAY - F.col("start")) / tick))), F.floor((high * DAY - F.col("start")) / tick)
    at_ticks = F.transform(F.when(to >= from_, F.sequence(from_, to)), lambda i: F.col("start") + i * tick)
    ruled = F.filter(F.coalesce(F.when(F.col("freq").isin(*CLOCK), at_ticks).otherwise(at_days), F.array().cast("array<long>")), lambda x: (x > F.col("start")) & (F.col("until").isNull() | (x <= F.col("until"))))
    e = e.withColumn("x_ruled", F.concat(F.array("start"), ruled))
    ruled = F.when(F.col("count").isNotNull(), F.slice("x_ruled", 1, F.greatest(F.col("count"), F.lit(1)))).otherwise(F.col("x_ruled"))
    gone = lambda x: F.exists("except", lambda d: F.when(d["dated"], F.floor(x / DAY) * DAY == d["at"]).otherwise(x == d["at"]))
    at = F.filter(F.concat(ruled, "more"), lambda x: x.isNotNull() & ~F.coalesce(gone(x), F.lit(False)))
    found = e.select("calendar_id", "zone", "length_ms", F.explode(at).alias("wall")).select("calendar_id", instant(F.col("wall"), F.col("zone")).alias("start_ms"), "length_ms")
    found = found.withColumn("end_ms", F.col("start_ms") + F.col("length_ms")).where((F.col("end_ms") > low_ms) & (F.col("start_ms") <= high_ms) & (F.col("length_ms") > 0))
    w = Window.partitionBy("calendar_id").orderBy("start_ms", "end_ms")
    new = F.coalesce(F.col("start_ms") > F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    found = found.withColumn("x_new", new.cast("int")).withColumn("x_run", F.sum("x_new").over(w))
    return found.groupBy("calendar_id", "x_run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("x_run")


def open_at(rows: DataFrame, periods: DataFrame, at: str = "fix_ms", calendar: str = "calendar_id") -> DataFrame:
    """The rows without a calendar, and those whose moment lies in one of its periods, from start_ms and before end_ms.

    Periods are cut at days, so that rows meet those of their calendar and day only, by an equality join in which a hot
    calendar's days are keys of their own. A row without a moment stays only if it has no calendar.
    """
    day = lambda c: F.floor(F.col(c) / DAY)
    cut = periods.select(F.col("calendar_id").alias("x_calendar"), "start_ms", "end_ms", F.explode(F.sequence(day("start_ms"), F.floor((F.col("end_ms") - 1) / DAY))).alias("x_on"))
    cut = cut.select("x_calendar", "x_on", F.col("start_ms").alias("x_from"), F.col("end_ms").alias("x_to"))
    gated = rows.where(F.col(calendar).isNotNull()).withColumn("x_day", day(at))
    hit = (F.col("x_calendar") == F.col(calendar)) & (F.col("x_on") == F.col("x_day")) & (F.col(at) >= F.col("x_from")) & (F.col(at) < F.col("x_to"))
    return rows.where(F.col(calendar).isNull()).unionByName(gated.join(cut, hit, "left_semi").drop("x_day"))


def geofence_gate(events: DataFrame, geofences: DataFrame, periods: DataFrame) -> DataFrame:
    """Geofence events, without those of geofences (geofence_id, calendar_id) whose calendar isn't open at the event."""
    return open_at(events.join(geofences.select("geofence_id", F.col("calendar_id").alias("x_gate")), "geofence_id", "left"), periods, "event_ms", "x_gate").drop("x_gate")


def periods_for(rows: DataFrame, events: DataFrame, at: str = "fix_ms") -> DataFrame:
    """periods() over the span of the rows' moments, which one small job finds; none without rows."""
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return periods(events, low, high) if low is not None else periods(events, 0, 0).where(F.lit(False))
