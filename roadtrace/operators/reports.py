"""Reports over positions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import KNOTS
from ..sources.adapter import DAY, by_time
from .folds import motion_spans
from .hierarchy import Access


def summary(df: DataFrame, by: list[str], max_speed: bool = True, ignore_odometer: bool = False, capacity: str | None = None) -> DataFrame:
    """First and last position, distance, fuel, engine hours and speeds per group. One aggregation.

    Of equal fix times the last position is the smallest id's. Distance and fuel go by metres() and spent_fuel() of the first and last position;
    capacity is a column of df. The mean speed is over engine hours. Fast mode leaves the top speed at 0.
    """
    first, last = F.struct("fix_ms", "id"), F.struct("fix_ms", -F.col("id"))
    fields = [f for f in (*FIELDS, capacity) if f in df.columns]
    row = F.struct(*fields)
    g = df.groupBy(*by).agg(
        F.min("fix_ms").alias("start_ms"), F.max("fix_ms").alias("end_ms"), (F.max("speed") if max_speed else F.lit(0.0)).alias("max_speed"), F.min_by(row, first).alias("x_a"), F.max_by(row, last).alias("x_z"),
    )
    g = g.select(*by, "start_ms", "end_ms", "max_speed", *[F.col(f"{x}.{f}").alias(f"{n}_{f}") for f in fields for x, n in (("x_a", "start"), ("x_z", "end"))])
    hours, distance = F.col("end_hours_ms") - F.col("start_hours_ms"), metres(g, ignore_odometer)
    return g.select(
        *by, "start_ms", "end_ms", distance.alias("distance"), "max_speed", spent_fuel(g, f"end_{capacity}" if capacity else None).alias("spent_fuel"), F.col("start_hours_ms").alias("start_hours"),
        F.col("end_hours_ms").alias("end_hours"), F.round(F.when(hours > 0, distance * 1000 / hours * KNOTS["mps"]).otherwise(0.0), 6).alias("average_speed"),
    )


def daily_summary(df: DataFrame) -> DataFrame:
    """Per device and day. A fix exactly at midnight is in both days."""
    day = F.floor(F.col("fix_ms") / DAY).cast("long")
    days = F.when(F.col("fix_ms") % DAY == 0, F.array(day, day - 1)).otherwise(F.array(day))
    return summary(df.withColumn("day", F.explode(days)), ["device_id", "day"])


def paired(events: DataFrame, start_type: str, stop_type: str) -> DataFrame:
    """(device_id, start_id, start_ms, end_id, end_ms) from an event to the next one of the other type; a repeated start
    replaces the one before, and one without an end has none."""
    w = Window.partitionBy("device_id").orderBy("event_ms", "position_id")
    e = events.where(F.col("type").isin(start_type, stop_type))
    e = e.withColumns({"nt": F.lead("type").over(w), "end_id": F.lead("position_id").over(w), "end_ms": F.lead("event_ms").over(w)})
    e = e.where((F.col("type") == start_type) & (F.col("nt").isNull() | (F.col("nt") == stop_type)))
    return e.select("device_id", F.col("position_id").alias("start_id"), F.col("event_ms").alias("start_ms"), "end_id", "end_ms")


def check_period(low: int, high: int, limit_s: int) -> None:
    """Refuses a range of over limit_s seconds; 0 allows any."""
    if limit_s > 0 and high - low > limit_s * 1000:
        raise ValueError("Time period exceeds the limit")


#: Ranges of more seconds take the fast path.
FAST_S = 86_400


def spent_fuel(df: DataFrame, capacity: str | None = None) -> Column:
    """Of start_ and end_ columns: fuel used, else the drop of fuel, else that of its level in percent of the capacity; else 0.
    The first that both ends have counts, also where it is negative."""
    rules = [("fuel_used", lambda a, b: b - a), ("fuel", lambda a, b: a - b)] + ([("fuel_level", lambda a, b: (a - b) / 100 * F.col(capacity))] if capacity else [])
    known = [rule(F.col(f"start_{c}"), F.col(f"end_{c}")) for c, rule in rules if f"start_{c}" in df.columns]
    return F.coalesce(*known, F.lit(0.0))


def metres(df: DataFrame, ignore_odometer: bool = False) -> Column:
    """Of start_ and end_ columns: the odometers' difference where both are there and not 0, else that of the total distance."""
    total = (F.col("end_total_mm") - F.col("start_total_mm")) / 1000.0
    if ignore_odometer or "start_odometer" not in df.columns:
        return total
    return F.when((F.col("start_odometer") != 0) & (F.col("end_odometer") != 0), F.col("end_odometer") - F.col("start_odometer")).otherwise(total)


FIELDS = ["total_mm", "odometer", "fuel_used", "fuel", "fuel_level", "hours_ms", "driver_unique_id", "latitude", "longitude"]


def trips(spans: DataFrame, ignore_odometer: bool = False, capacity: str | None = None) -> DataFrame:
    """Trips with distance, mean and top speed, fuel and driver, from spans with start_ and end_ of FIELDS as far as they are known."""
    ms, d = F.col("end_ms") - F.col("start_ms"), metres(spans, ignore_odometer)
    return spans.select(
        "device_id", "start_id", "start_ms", "end_id", "end_ms", ms.alias("duration"), d.alias("distance"), F.round(F.when(ms > 0, d * 1000 / ms * KNOTS["mps"]).otherwise(0.0), 6).alias("average_speed"),
        "max_speed", spent_fuel(spans, capacity).alias("spent_fuel"), *([F.coalesce("start_driver_unique_id", "end_driver_unique_id").alias("driver")] if "start_driver_unique_id" in spans.columns else []),
    )


def stops(spans: DataFrame, ignore_odometer: bool = False, capacity: str | None = None) -> DataFrame:
    """Stops with their duration, engine hours and fuel."""
    return spans.select(
        "device_id", "start_id", "start_ms", "end_id", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration"),
        (F.col("end_hours_ms") - F.col("start_hours_ms")).alias("engine_hours"), spent_fuel(spans, capacity).alias("spent_fuel"),
    )


def slow_spans(df: DataFrame, is_trips: bool, algorithm: str = "old", **options) -> DataFrame:
    """Spans by the motion of the positions themselves."""
    return motion_spans(df, is_trips, [f for f in FIELDS if f in df.columns], algorithm, **options)


def fast_spans(df: DataFrame, events: DataFrame, is_trips: bool) -> DataFrame:
    """Spans between stored events deviceMoving and deviceStopped. A device whose first position moves has one open from there,
    trips and stops alike; what is open at the end ends at the last position. The top speed stays 0.

    Each event brings its position along by a join on the id, so positions are neither sorted nor windowed.
    """
    fields = [f for f in FIELDS if f in df.columns]
    at = df.select("device_id", "id", "fix_ms", "motion", *fields)
    first, last = F.struct("fix_ms", "id"), F.struct("fix_ms", -F.col("id"))
    row = F.struct("id", "fix_ms", *fields)
    edge = at.groupBy("device_id").agg(F.min_by(F.struct(row.alias("row"), "motion"), first).alias("a"), F.max_by(row, last).alias("z"))
    marks = events.where(F.col("type").isin("deviceMoving", "deviceStopped")).select(
        "device_id", F.col("position_id").alias("id"), "event_ms", ((F.col("type") == "deviceMoving") == F.lit(is_trips)).alias("opens"))
    known = marks.join(at.drop("device_id"), "id").select("device_id", F.col("event_ms").alias("ms"), "opens", F.col("id").alias("key"), row.alias("row"))
    known = known.union(edge.where("a.motion").select("device_id", F.lit(-1).cast("long"), F.lit(True), F.lit(-1).cast("long"), "a.row"))
    w = Window.partitionBy("device_id").orderBy("ms", "key")
    known = known.withColumns({"next": F.lead("opens").over(w), "end": F.lead("row").over(w)}).where(F.col("opens") & ~F.coalesce("next", F.lit(False)))
    spans = known.join(edge.select("device_id", "z"), "device_id").withColumn("end", F.coalesce("end", "z"))
    both = [F.col(f"{c}.{f}").alias(f"{n}_{f}") for f in fields for c, n in (("row", "start"), ("end", "end"))]
    return spans.select("device_id", F.col("row.id").alias("start_id"), F.col("row.fix_ms").alias("start_ms"), F.col("end.id").alias("end_id"), F.col("end.fix_ms").alias("end_ms"), F.lit(0.0).alias("max_speed"), *both)


def spans(df: DataFrame, events: DataFrame, low: int, high: int, is_trips: bool, limit_s: int = 0, fast_s: int = FAST_S, algorithm: str = "old", **options) -> DataFrame:
    """Spans of a range: by the stored events where it is longer than fast_s, else by the positions."""
    check_period(low, high, limit_s)
    rows = df.where(F.col("fix_ms").between(low, high))
    if high - low > fast_s * 1000:
        return fast_spans(rows, events.where(F.col("event_ms").between(low, high)), is_trips)
    return slow_spans(rows, is_trips, algorithm, **options)


def geofence_visits(events: DataFrame) -> DataFrame:
    """Enter to exit per device and geofence; a later enter replaces an open one, and unclosed ones are left out."""
    w = Window.partitionBy("device_id", "geofence_id").orderBy("event_ms", "position_id", "type")
    e = events.withColumns({"nt": F.lead("type").over(w), "end_ms": F.lead("event_ms").over(w)})
    return e.where("type = 'geofenceEnter' and nt = 'geofenceExit'").select("device_id", "geofence_id", F.col("event_ms").alias("start_ms"), "end_ms")


def journeys(df: DataFrame, starts: Column, ends: Column, stats_from: int, stats_to: int) -> DataFrame:
    """Intervals that a start opens and an end, or the next start, closes, with statistics of their positions in the window.

    A gap counts in whole seconds, from 60 on, where either end moves at over 3 knots.
    """
    w = by_time()
    marks = df.where(starts | ends).withColumn("s", starts)
    marks = marks.withColumn("end_ms", F.lead("fix_ms").over(w)).where("s").select("device_id", F.col("id").alias("journey_id"), F.col("fix_ms").alias("start_ms"), "end_ms")
    rows = df.select("device_id", "fix_ms", "id", "speed", "distance_mm", F.when(starts, F.struct(F.col("id").alias("journey_id"), F.col("fix_ms").alias("start_ms"))).alias("j"), ends.alias("e"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.last(F.when(F.col("j").isNotNull(), F.col("j.journey_id")).when(F.col("e"), F.lit(-1)), ignorenulls=True).over(running))
    rows = rows.withColumn("end_of", F.when(F.col("e"), F.lag("open").over(w)))
    inside = rows.withColumn("journey_id", F.coalesce("end_of", "open")).where((F.col("journey_id") > 0) & F.col("fix_ms").between(stats_from, stats_to))
    jw = Window.partitionBy("journey_id").orderBy("fix_ms", "id")
    gap = F.floor((F.col("fix_ms") - F.lag("fix_ms").over(jw)) / 1000)
    inside = inside.withColumn("gap", F.when((F.col("speed") > 3) | (F.lag("speed").over(jw) > 3), gap)).withColumn("step", F.when(F.lag("id").over(jw).isNotNull(), F.col("distance_mm")))
    stats = inside.groupBy("journey_id").agg(F.count("*").alias("points"), (F.coalesce(F.sum("step"), F.lit(0)) / 1000.0).alias("distance_m"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_s"), F.count_if(F.col("gap") > 60).alias("gaps_over_60"))
    zero = F.lit(0)
    return marks.join(stats, "journey_id", "left").select(
        "device_id", "journey_id", "start_ms", "end_ms", F.coalesce("points", zero).alias("points"), F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"),
        F.coalesce("max_gap_s", zero).alias("max_gap_s"), F.coalesce("gaps_over_60", zero).alias("gaps_over_60"),
    )


def continuity(df: DataFrame, most_ms: int = 300_000) -> DataFrame:
    """Per device: time tracked, each step between distinct fix times counting up to most_ms, and the steps over that."""
    times = df.select("device_id", "fix_ms").distinct()
    dt = F.col("fix_ms") - F.lag("fix_ms").over(Window.partitionBy("device_id").orderBy("fix_ms"))
    g = times.withColumn("dt", dt).groupBy("device_id").agg(
        F.count("*").alias("fixes"), F.min("fix_ms").alias("first_ms"), F.max("fix_ms").alias("last_ms"), F.coalesce(F.sum(F.least("dt", F.lit(most_ms))), F.lit(0)).alias("tracking_ms"), F.count_if(F.col("dt") > most_ms).alias("gaps"), F.coalesce(F.max("dt"), F.lit(0)).alias("longest_gap_ms")
    )
    whole = F.col("last_ms") - F.col("first_ms")
    return g.withColumn("continuity_pct", F.round(F.when(whole > 0, F.col("tracking_ms") * 100.0 / whole).otherwise(100.0), 2))


def capture_gaps(df: DataFrame, low: int, high: int, least_ms: int = 300_000) -> DataFrame:
    """Gaps over least_ms between fixes, and between the window's edges and the first and last fix (clipped)."""
    rows = df.where(F.col("fix_ms").between(low, high)).select("device_id", "fix_ms")
    edge = rows.select("device_id").distinct().select("device_id", F.lit(high).alias("fix_ms"))
    w = Window.partitionBy("device_id").orderBy("fix_ms", "last")
    all_ = rows.withColumn("last", F.lit(False)).union(edge.withColumn("last", F.lit(True)))
    all_ = all_.withColumn("start_ms", F.coalesce(F.lag("fix_ms").over(w), F.lit(low))).withColumn("clipped", F.lag("fix_ms").over(w).isNull() | F.col("last"))
    return all_.where(F.col("fix_ms") - F.col("start_ms") > least_ms).select("device_id", "start_ms", F.col("fix_ms").alias("end_ms"), "clipped")


def runs(df: DataFrame, condition: Column, value: Column) -> DataFrame:
    """Stretches of rows for which a condition holds: start, end, rows and the largest value."""
    w = by_time()
    df = df.withColumn("x_in", F.coalesce(condition, F.lit(False))).withColumn("x_value", value)
    df = df.withColumn("x_new", (F.col("x_in") & ~F.coalesce(F.lag("x_in").over(w), F.lit(False))).cast("int"))
    df = df.withColumn("x_run", F.sum("x_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where("x_in").groupBy("device_id", "x_run").agg(F.min("fix_ms").alias("start_ms"), F.max("fix_ms").alias("end_ms"), F.count("*").alias("n"), F.max("x_value").alias("largest")).drop("x_run")


def delivery_delays(df: DataFrame, late_ms: int = 300_000, critical_ms: int = 3_600_000) -> DataFrame:
    delay = F.col("server_ms") - F.col("fix_ms")
    r = runs(df, delay >= late_ms, delay)
    return r.withColumn("severity", F.when(F.col("largest") >= critical_ms, "critical").otherwise("warning"))


def recovery(df: DataFrame, success: str, timeout_after: int) -> DataFrame:
    """Attempts (device_id, attempt, stage, ts): start, end, stages seen and how they ended: well with the stage success, in a timeout
    with timeout_after reports or more, else they are open."""
    g = df.groupBy("device_id", "attempt").agg(F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"), F.count("*").alias("n"), F.array_sort(F.collect_set("stage")).alias("s"))
    outcome = F.when(F.array_contains("s", success), "success").when(F.col("n") >= timeout_after, "timeout").otherwise("open")
    return g.select("device_id", "attempt", "start_ms", "end_ms", "n", F.array_join("s", ",").alias("stages"), outcome.alias("outcome"))


def daily_statistics(df: DataFrame, protocols: list[str]) -> DataFrame:
    """Per day: messages, devices, and the devices whose last message came by each of the protocols."""
    day = F.floor(F.col("fix_ms") / DAY).cast("long")
    per = df.groupBy(day.alias("day"), "device_id").agg(F.count("*").alias("n"), F.max_by("protocol", F.struct("server_ms", "id")).alias("protocol"))
    return per.groupBy("day").agg(F.sum("n").alias("messages"), F.count("*").alias("devices"), *[F.count_if(F.col("protocol") == p).alias(f"devices_{p}") for p in protocols])


def admin_alerts(latest: DataFrame, now_ms: int) -> DataFrame:
    """Silent and badly charged devices by severity, the worst and latest first."""
    silent = F.lit(now_ms) - F.col("fix_ms")
    kinds = F.array(
        F.when(silent >= 1_800_000, F.struct(F.lit("silence").alias("kind"), F.lit("critical").alias("severity"))).when(silent >= 600_000, F.struct(F.lit("silence").alias("kind"), F.lit("warning").alias("severity"))),
        F.when(F.col("fuel") <= 5, F.struct(F.lit("battery").alias("kind"), F.lit("critical").alias("severity"))).when(F.col("fuel") <= 15, F.struct(F.lit("battery").alias("kind"), F.lit("info").alias("severity"))),
    )
    return latest.withColumn("a", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).select("device_id", F.col("fix_ms").alias("ts"), "a.kind", "a.severity")


def notifications(events: DataFrame, rules: DataFrame, users: Access) -> DataFrame:
    """(user_id, notification_id, position_id, notificator): events (device_id, type, alarm_type) met by rules
    (notification_id, type, alarms, notificators) for the users of the device. Alarm events need their alarm in the list."""
    r = rules.withColumnRenamed("type", "r_type")
    hit = events.join(r, (F.col("type") == F.col("r_type")) & ((F.col("type") != "alarm") | F.array_contains(F.split("alarms", ","), F.col("alarm_type"))))
    told = hit.select("device_id", "notification_id", "position_id", F.explode(F.split("notificators", ",")).alias("notificator"))
    return users.users(told).select("user_id", "notification_id", "position_id", "notificator")
