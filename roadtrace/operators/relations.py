"""Joins, guards and counts that stand beside the pipeline: calendars, visibility, names, arrival order, trailing history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import DAY, by_time


def in_calendar(df: DataFrame, periods: DataFrame, key: str = "calendar_id") -> DataFrame:
    """Rows whose fix_ms is in a period (start inclusive, end exclusive) of their calendar; rows without a calendar stay.

    Periods are dealt to the days that they touch, so that the join is by calendar and day and not by range alone.
    """
    day = lambda c: F.floor(c / DAY).cast("long")
    p = periods.where("end_ms > start_ms").select(F.col(key).alias("x_key"), "start_ms", "end_ms", F.explode(F.sequence(day(F.col("start_ms")), day(F.col("end_ms") - 1))).alias("x_day"))
    held = (F.col(key) == F.col("x_key")) & (day(F.col("fix_ms")) == F.col("x_day")) & (F.col("fix_ms") >= F.col("start_ms")) & (F.col("fix_ms") < F.col("end_ms"))
    return df.where(F.col(key).isNotNull()).join(p, held, "left_semi").unionByName(df.where(F.col(key).isNull()))


def visible_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """(user_id, event) for events without geofence_id, or with one that the user is linked to; links: user_id, geofence_id.

    events has user_id, the user that asks. The null case is part of the join, so each event is read once.
    """
    seen = links.select("user_id", "geofence_id").distinct().withColumn("x_seen", F.lit(True))
    return events.join(seen, ["user_id", "geofence_id"], "left").where(F.col("x_seen") | F.col("geofence_id").isNull()).select(events.columns)


def named_drivers(df: DataFrame, drivers: DataFrame) -> DataFrame:
    """driver_name by driver_unique_id, null where there is no such driver."""
    return df.join(drivers.select("driver_unique_id", "driver_name").dropDuplicates(["driver_unique_id"]), "driver_unique_id", "left")


def linked_drivers(df: DataFrame, links: DataFrame) -> DataFrame:
    """driver_unique_id as it is, else the one that is linked to the device (device_id, linked_driver)."""
    met = df.join(links.dropDuplicates(["device_id"]), "device_id", "left")
    return met.withColumn("driver_unique_id", F.coalesce("driver_unique_id", "linked_driver")).drop("linked_driver")


def latest_on_arrival(df: DataFrame) -> DataFrame:
    """is_latest: in order of arrival, no row of the device before this one has a later fix."""
    before = Window.partitionBy("device_id").orderBy("server_ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("is_latest", F.coalesce(F.col("fix_ms") >= F.max("fix_ms").over(before), F.lit(True)))


def trailing(df: DataFrame, span_ms: int) -> DataFrame:
    """held: how many positions the history of the last span_ms has, with this one and one older if there is one."""
    recent = F.count("*").over(Window.partitionBy("device_id").orderBy("fix_ms").rangeBetween(-span_ms, 0))
    before = F.count("*").over(Window.partitionBy("device_id").orderBy("fix_ms").rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn("held", F.least(recent + 1, before))


def messages_per_day(df: DataFrame) -> DataFrame:
    """Messages of each device and UTC day of arrival."""
    return df.groupBy("device_id", F.floor(F.col("server_ms") / DAY).cast("long").alias("day")).agg(F.count("*").alias("messages"))


def attribute_keys(df: DataFrame, names: list[str]) -> DataFrame:
    """(key, rows): the attributes that any row has, which are the columns of an export with the union of keys."""
    counts = df.agg(*[F.count(n).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("rows")) for n in names])).alias("x")
    return counts.select(pairs).select("x.key", "x.rows").where("rows > 0")


def devices_by_group(devices: DataFrame) -> DataFrame:
    """How many devices each group has directly, and their smallest and largest id; devices without a group are one group."""
    return devices.groupBy("group_id").agg(F.count("*").alias("devices"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def step_on(df: DataFrame) -> DataFrame:
    """Alarms that the position before did not have: a set difference per row."""
    split = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.split(c, ","))
    return df.withColumn("new_alarms", F.array_join(F.array_except(split(F.col("alarm")), split(F.lag("alarm").over(by_time()))), ","))
