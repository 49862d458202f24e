"""Joins that bring a position, event or device what other tables know: devices, cells, limits, objects, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..sources.adapter import by_time
from . import hierarchy, request


def identified(frames: DataFrame, devices: DataFrame) -> DataFrame:
    """frames with device_id by unique_id; null where there is no such device. Of devices that share one the smallest id counts."""
    known = devices.groupBy("unique_id").agg(F.min("id").alias("device_id"))
    return frames.join(known, "unique_id", "left")


def located(df: DataFrame, cells: DataFrame) -> DataFrame:
    """Outdated positions take the place of their network's cell (network, cell_latitude, cell_longitude), as approximate and standing still."""
    met = df.join(cells.dropDuplicates(["network"]), "network", "left")
    hit = F.col("outdated") & F.col("cell_latitude").isNotNull()
    new = {"latitude": F.when(hit, F.col("cell_latitude")).otherwise(F.col("latitude")), "longitude": F.when(hit, F.col("cell_longitude")).otherwise(F.col("longitude")), "speed": F.when(hit, 0.0).otherwise(F.col("speed"))}
    return met.withColumns(new | {"approximate": F.coalesce(hit, F.lit(False))}).drop("cell_latitude", "cell_longitude")


def road_limits(df: DataFrame, roads: DataFrame, cell: float = 0.01) -> DataFrame:
    """speed_limit in knots from a table of grid cells (cy, cx, limit); null beyond the table."""
    index = lambda c: F.floor(F.col(c) / cell).cast("long")
    return df.withColumns({"cy": index("latitude"), "cx": index("longitude")}).join(roads.withColumnRenamed("limit", "speed_limit"), ["cy", "cx"], "left").drop("cy", "cx")


def address_source(df: DataFrame, reuse_m: float) -> DataFrame:
    """address_of: the id of the position whose address this one has: its own, or that of the one before where that is within reuse_m."""
    w = by_time()
    near = haversine(F.lag("latitude").over(w), F.lag("longitude").over(w), "latitude", "longitude") <= reuse_m
    own = F.when(~F.coalesce(near, F.lit(False)), F.col("id"))
    return df.withColumn("address_of", F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fence_limits(tags: DataFrame, limits: DataFrame, lowest: bool = False) -> DataFrame:
    """(id, fence_limit): of the geofences of each position the highest limit, or the lowest; with lowest, a limit of 0 after a positive one switches it off."""
    met = tags.join(limits, "geofence_id")
    if not lowest:
        return met.groupBy("id").agg(F.max("limit").alias("fence_limit"))
    ordered = F.array_sort(F.collect_list(F.struct("geofence_id", "limit")))  # a position is in few geofences
    pick = F.aggregate(ordered, F.lit(0.0), lambda a, x: F.when(((x["limit"] > 0) & (a == 0)) | (x["limit"] < a), x["limit"]).otherwise(a))
    return met.groupBy("id").agg(pick.alias("fence_limit"))


def limit_of(fence: Column, position: Column, device: Column) -> Column:
    """The limit that counts: the geofences', else the position's, else the device's; 0 counts as none."""
    some = lambda c: F.when(c > 0, c)
    return F.coalesce(some(fence), some(position), some(device), F.lit(0.0))


def device_objects(direct: DataFrame, by_group: DataFrame, groups: DataFrame, devices: DataFrame, key: str) -> DataFrame:
    """(device_id, key): objects linked to a device, or to its group or a group above that."""
    above = hierarchy.ancestors(groups).join(by_group.withColumnRenamed("group_id", "ancestor_id"), "ancestor_id").select("group_id", key)
    through = devices.select(F.col("id").alias("device_id"), "group_id").join(above, "group_id").select("device_id", key)
    return direct.select("device_id", key).union(through).distinct()


def device_notifications(linked: DataFrame, always: DataFrame, user_notifications: DataFrame, access: hierarchy.Access) -> DataFrame:
    """(device_id, notification_id): linked ones, and those that are always on for a user of the device."""
    on = user_notifications.join(always.select("notification_id"), "notification_id", "left_semi").select("user_id", "notification_id")
    return linked.select("device_id", "notification_id").union(access.objects(on, "notification_id")).distinct()


def routed(events: DataFrame, rules: DataFrame, links: DataFrame, users: hierarchy.Access, now_ms: int, oldest_s: int, blocked: list[int] = ()) -> DataFrame:
    """(user_id, notification_id, position_id, notificator) for events (device_id, position_id, event_ms, type, alarm_type, geofence_id).

    rules: notification_id, type, alarms, geofence_ids, low_ms, high_ms (of its calendar; null for none), notificators.
    links: device_id, notification_id. Alarms must be listed; a list of geofences binds where there is
    one; older events than oldest_s and blocked users are left out.
    """
    listed = lambda c, v: F.array_contains(F.split(F.col(c), ","), v.cast("string"))
    r = rules.withColumnRenamed("type", "r_type")
    met = events.where(F.lit(now_ms) - F.col("event_ms") <= oldest_s * 1000).join(links, "device_id").join(r, "notification_id")
    met = met.where(
        (F.col("type") == F.col("r_type")) & ((F.col("type") != "alarm") | F.coalesce(listed("alarms", F.col("alarm_type")), F.lit(False)))
        & (F.col("geofence_ids").isNull() | F.coalesce(listed("geofence_ids", F.col("geofence_id")), F.lit(False))) & (F.col("low_ms").isNull() | F.col("event_ms").between(F.col("low_ms"), F.col("high_ms") - 1))
    )
    told = met.select("device_id", "notification_id", "position_id", F.explode(F.split("notificators", ",")).alias("notificator"))
    return users.without(list(blocked)).users(told).select("user_id", "notification_id", "position_id", "notificator")


def permissions(links: DataFrame, owner: str, owner_id: int, prop: str, prop_id: int) -> DataFrame:
    """Link rows of an owner and a property; id 0 stands for any."""
    for name, value in ((owner, owner_id), (prop, prop_id)):
        links = links.where(F.col(name) == value) if value else links
    return links


def listing(df: DataFrame, links: DataFrame, user_id: int, keyword: str | None, names: list[str], order: request.Order) -> DataFrame:
    """What a list request gives: the user's objects that hold the keyword, in order, one page."""
    seen = hierarchy.permitted(df, links, user_id, "id")
    return request.query(seen, condition=request.contains(names, keyword) if keyword else None, order=order)


def updated(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """df with new values of the named columns where the condition holds; other rows and columns stay."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in values.items()})


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    """df without the rows for which the condition holds."""
    return df.where(~F.coalesce(condition, F.lit(False)))
