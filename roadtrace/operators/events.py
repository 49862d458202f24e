"""Event detectors. Each returns device_id, position_id, event_ms and what the event holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import KNOTS
from ..sources.adapter import by_time


def _at(df: DataFrame, *more) -> DataFrame:
    return df.select("device_id", F.col("id").alias("position_id"), F.col("fix_ms").alias("event_ms"), *more)


def overspeed(df: DataFrame, limit: Column, minimal_s: int = 15, multiplier: float = 1.0) -> DataFrame:
    """Once per stretch of rows over the limit: the first row at least minimal_s after the stretch began."""
    w = by_time()
    over = F.coalesce((limit > 0) & (F.col("speed") > limit * multiplier), F.lit(False))
    df = df.withColumn("x_limit", limit).withColumn("x_over", over)
    df = df.withColumn("x_new", (F.col("x_over") & ~F.coalesce(F.lag("x_over").over(w), F.lit(False))).cast("int"))
    df = df.withColumn("x_run", F.sum("x_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("x_over")
    run = Window.partitionBy("device_id", "x_run").orderBy("fix_ms", "id")
    due = F.col("fix_ms") - F.first("fix_ms").over(run) >= minimal_s * 1000
    df = df.withColumn("x_due", due).where("x_due").withColumn("x_rank", F.row_number().over(run)).where("x_rank = 1")
    return _at(df, "speed", F.col("x_limit").alias("speed_limit"))


def behavior(df: DataFrame, acceleration: float = 0.5, braking: float = 0.5) -> DataFrame:
    w = by_time()
    dt = F.col("fix_ms") - F.lag("fix_ms").over(w)
    rate = F.round((F.col("speed") - F.lag("speed").over(w)) / KNOTS["mps"] * 1000 / dt, 9)
    kind = F.when(dt > 0, F.when(rate >= acceleration, "hardAcceleration").when(rate <= -braking, "hardBraking"))
    return _at(df.withColumn("type", kind).where("type is not null"), "type")


def fuel(df: DataFrame, increase: float, drop: float) -> DataFrame:
    change = F.col("fuel") - F.lag("fuel").over(by_time())
    kind = F.when(change >= increase, "deviceFuelIncrease").when(-change >= drop, "deviceFuelDrop")
    return _at(df.withColumn("type", kind).withColumn("change", change).where("type is not null"), "type", "change")


def alarms(df: DataFrame, ignore_repeated: bool = False) -> DataFrame:
    now = F.array_distinct(F.split("alarm", ","))
    if ignore_repeated:
        now = F.array_except(now, F.coalesce(F.split(F.lag("alarm").over(by_time()), ","), F.array().cast("array<string>")))
    return _at(df.withColumn("x_alarms", now).where("alarm is not null"), F.explode("x_alarms").alias("alarm_type"))


def ignition(df: DataFrame) -> DataFrame:
    before = F.lag("ignition").over(by_time())
    kind = F.when(F.col("ignition") & ~before, "ignitionOn").when(~F.col("ignition") & before, "ignitionOff")
    return _at(df.withColumn("type", kind).where("type is not null"), "type")


def maintenance(df: DataFrame, value: str, start: float, period: float) -> DataFrame:
    """The value reaches start, or another whole period after it. Zero counts as absent; division truncates."""
    new, old = F.col(value), F.lag(value).over(by_time())
    cycles = lambda x: ((x - start) / period).cast("long")
    due = (old != 0) & (new != 0) & (new >= start) & ((old < start) | (cycles(old) < cycles(new)))
    return _at(df.withColumn("x_due", due).where("x_due"), F.col(value).alias("value"))


def driver(df: DataFrame) -> DataFrame:
    before = F.lag("driver_unique_id").over(by_time())
    return _at(df.withColumn("x_before", before).where("driver_unique_id <> coalesce(x_before, '')"), "driver_unique_id")


def geofence(tags: DataFrame, df: DataFrame) -> DataFrame:
    """Exit for geofences that the row before was in and this one isn't, enter the other way round."""
    sets = tags.groupBy("id").agg(F.collect_set("geofence_id").alias("now"))
    none = F.array().cast("array<long>")
    rows = df.select("device_id", "id", "fix_ms").join(sets, "id", "left").withColumn("now", F.coalesce("now", none))
    rows = rows.withColumn("old", F.coalesce(F.lag("now").over(by_time()), none))
    named = lambda kind, a, b: F.transform(F.array_except(a, b), lambda g: F.struct(F.lit(kind).alias("type"), g.alias("geofence_id")))
    rows = rows.withColumn("e", F.explode(F.concat(named("geofenceExit", "old", "now"), named("geofenceEnter", "now", "old"))))
    return _at(rows, "e.type", "e.geofence_id")


def command_result(df: DataFrame, result: str) -> DataFrame:
    """An event per position that has the attribute result."""
    return _at(df.where(F.col(result).isNotNull()), F.col(result).alias("result"))


def proximity(df: DataFrame, links: DataFrame, metres: float, leave: float | None = None) -> DataFrame:
    """Linked devices (device_id, linked_id) that come within metres, or go farther than leave (metres, unless given), by the other's
    last position at that time. Between the two distances things stay as they were.

    Both devices' rows are merged in time order and carried forward, so no row meets a range of others.
    """
    from ..functions.geo import distance_mm

    both = df.select("device_id", "id", "fix_ms", "latitude", "longitude")
    own = both.join(links, "device_id").withColumn("own", F.lit(True))
    other = both.select(F.col("device_id").alias("linked_id"), "id", "fix_ms", "latitude", "longitude").join(links, "linked_id").withColumn("own", F.lit(False))
    w = Window.partitionBy("device_id", "linked_id").orderBy("fix_ms", "id")
    seen = lambda c: F.last(F.when(~F.col("own"), F.col(c)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = own.unionByName(other).withColumns({"la": seen("latitude"), "lo": seen("longitude")}).where("own and la is not null")
    far = distance_mm("latitude", "longitude", "la", "lo")
    side = F.when(far <= int(metres * 1000), True).when(far > int((leave or metres) * 1000), False)
    m = m.withColumn("near", F.coalesce(F.last(side, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    m = m.withColumn("old", F.lag("near").over(w))
    kind = F.when(F.col("near") & ~F.coalesce("old", F.lit(False)), "proximityEnter").when(~F.col("near") & F.col("old"), "proximityExit")
    return _at(m.withColumn("type", kind).where("type is not null"), "type", "linked_id")


def unaccompanied(df: DataFrame, links: DataFrame, metres: float) -> DataFrame:
    """Positions at which a device begins to move while none of its linked devices (device_id, linked_id) is within metres, by their
    last positions at that time. Devices without links have none; a linked device that hasn't sent yet is nowhere near.

    Beginnings are merged in time order with the linked devices' rows and take the last one along, so no row meets a range of others.
    """
    from ..functions.geo import distance_mm

    links = links.select("device_id", "linked_id").distinct()
    begins = df.withColumn("x_was", F.lag("motion").over(by_time())).where(F.col("motion") & ~F.col("x_was"))
    at = lambda d: d.select("device_id", "id", "fix_ms", "latitude", "longitude")
    own = at(begins).join(links, "device_id").withColumn("own", F.lit(True))
    other = at(df).withColumnRenamed("device_id", "linked_id").join(links, "linked_id").withColumn("own", F.lit(False))
    w = Window.partitionBy("device_id", "linked_id").orderBy("fix_ms", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda c: F.last(F.when(~F.col("own"), F.col(c)), ignorenulls=True).over(w)
    m = own.unionByName(other).withColumns({"la": seen("latitude"), "lo": seen("longitude")}).where("own")
    near = F.coalesce(distance_mm("latitude", "longitude", "la", "lo") <= int(metres * 1000), F.lit(False))
    alone = m.groupBy("device_id", "id", "fix_ms").agg(F.bool_or(near).alias("near")).where("not near")
    return _at(alone, F.lit("unaccompaniedMotion").alias("type"))


def inactive(latest: DataFrame, now_ms: int, start_s: int, period_s: int, check_s: int = 900) -> DataFrame:
    """Devices whose silence passed start, or a whole period after it, in the last check_s seconds."""
    silent = F.lit(now_ms) - F.col("fix_ms")
    over = silent - start_s * 1000
    due = (over >= 0) & ((over < check_s * 1000) | (over % (period_s * 1000) < check_s * 1000))
    return latest.where(due).select("device_id", silent.alias("silent_ms"))


def presence(latest: DataFrame, now_ms: int, suspect_s: int = 300, offline_s: int = 600) -> DataFrame:
    age = F.lit(now_ms) - F.col("fix_ms")
    return latest.select("device_id", F.when(age > offline_s * 1000, "OFFLINE").when(age > suspect_s * 1000, "SUSPECT").otherwise("ONLINE").alias("state"))


def battery_low(df: DataFrame, level: str = "fuel", low: float = 10) -> DataFrame:
    before = F.lag(level).over(by_time())
    return _at(df.withColumn("x_before", before).where((F.col("x_before") > low) & (F.col(level) <= low)), level)


def media(df: DataFrame, names: list[str]) -> DataFrame:
    """An event per media attribute that a position has."""
    kinds = F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("media"), F.col(n).alias("file"))) for n in names]), lambda x: x.isNotNull())
    return _at(df.withColumn("m", F.explode(kinds)), "m.media", "m.file")
