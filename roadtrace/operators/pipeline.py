"""The position pipeline: enrichment and filters, in the order in which positions go through them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.units import KNOTS
from ..sources.adapter import LINE_M, by_time

GPS_EPOCH_MS, GPS_CYCLE_MS, NINETY_DAYS_MS = 315_964_800_000, 1024 * 7 * 86_400_000, 90 * 86_400_000


def rollover(ms: Column, now_ms: int) -> Column:
    """Times of receivers that lost 1024-week cycles: cycles are added until the time is within a cycle less 90 days."""
    late = F.lit(now_ms) - ms - (GPS_CYCLE_MS - NINETY_DAYS_MS)
    return ms + F.when(late > 0, F.ceil(late / GPS_CYCLE_MS) * GPS_CYCLE_MS).otherwise(0)


def time_override(df: DataFrame, source: str) -> DataFrame:
    """fix_ms from the server's time, or from the device's."""
    return df.withColumn("fix_ms", F.col({"serverTime": "server_ms", "deviceTime": "device_ms"}[source]))


def hemisphere(df: DataFrame, latitude: str | None = None, longitude: str | None = None) -> DataFrame:
    if latitude:
        df = df.withColumn("latitude", F.abs("latitude") * (1 if latitude == "N" else -1))
    return df.withColumn("longitude", F.abs("longitude") * (1 if longitude == "E" else -1)) if longitude else df


def filled(df: DataFrame, names: list[str], where: Column) -> DataFrame:
    """Where the condition holds, columns take the last row's values for which it didn't."""
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.when(where, F.last(F.when(~where, F.col(n)), ignorenulls=True).over(w)).otherwise(F.col(n)) for n in names})


def copied(df: DataFrame, names: list[str]) -> DataFrame:
    """Forward fill of missing attributes."""
    w = by_time().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names})


def motion_flag(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Moving by speed, or by implied speed from the position before (over 0.5 knots; any distance where time stands still)."""
    dt = F.col("fix_ms") - F.lag("fix_ms").over(by_time())
    implied = F.round(F.col("distance_mm") / dt * KNOTS["mps"], 6)
    return df.withColumn("moving", (F.col("speed") > threshold) | F.when(dt > 0, implied > 0.5).otherwise(F.col("distance_mm") > 0))


def engine_hours(df: DataFrame) -> DataFrame:
    w = by_time()
    on = F.col("ignition") & F.lag("ignition").over(w)
    df = df.withColumn("x_on", F.when(on, F.col("fix_ms") - F.lag("fix_ms").over(w)).otherwise(0))
    return df.withColumn("hours_ms", F.sum("x_on").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("x_on")


@dataclass
class Computed:
    """An attribute that a Spark SQL expression gives. kind: number, boolean or string, or as it comes. Higher priorities come first."""

    name: str
    expression: str
    kind: str | None = None
    priority: int = 0


def computed(df: DataFrame, expressions: list[Computed | tuple[str, str]]) -> DataFrame:
    """Computed attributes by priority, then in order; `last_<column>` is the value before, and earlier ones can be used.

    What fails for a row, as a division by zero or a text that is no number, is null there: expressions are built without ANSI
    errors, which doesn't touch the session's other queries. A name that df has is overwritten.
    """
    w, spark = by_time(), df.sparkSession
    before = {f"last_{c}": F.lag(c).over(w) for c in ("speed", "fuel", "altitude", "ignition")}
    df = df.withColumns(before)
    own = [x if isinstance(x, Computed) else Computed(*x) for x in expressions]
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        for x in sorted(own, key=lambda x: -x.priority):
            made = F.expr(x.expression)
            df = df.withColumn(x.name, made if x.kind is None else made.cast({"number": "double"}.get(x.kind, x.kind)))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    return df.drop(*before)


def filters(now_ms: int, accuracy: float = 100, future_s: int = 86_400, past_s: int | None = None) -> dict[str, Column]:
    """Conditions under which a position is dropped, that need no other row."""
    out = {
        "invalid": (F.abs("latitude") > 90) | (F.abs("longitude") > 180), "zero": (F.col("latitude") == 0) & (F.col("longitude") == 0),
        "accuracy": F.col("accuracy") > accuracy, "static": F.col("speed") == 0, "future": F.col("fix_ms") > now_ms + future_s * 1000,
    }
    return out | ({"past": F.col("fix_ms") < now_ms - past_s * 1000} if past_s is not None else {})


def flagged(df: DataFrame) -> dict[str, Column]:
    """Such conditions by the flags valid, outdated and approximate, as far as df has them; a missing flag means nothing."""
    sign = {"valid": ("invalid_flag", False), "outdated": ("outdated", True), "approximate": ("approximate", True)}
    return {name: F.coalesce(F.col(c) == value, F.lit(False)) for c, (name, value) in sign.items() if c in df.columns}


def kept(df: DataFrame, *conditions: Column, skip: Column | None = None) -> DataFrame:
    """Rows for which no condition holds, or for which skip does."""
    drop = reduce(Column.__or__, conditions)
    return df.where(~F.coalesce(drop, F.lit(False)) | (F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False)))


def at_altitude(df: DataFrame, floor: float = 0, ceiling: float = 0) -> DataFrame:
    """Positions between a geofence's floor and ceiling; 0 means that there is none."""
    df = df.where(F.col("altitude") >= floor) if floor else df
    return df.where(F.col("altitude") <= ceiling) if ceiling else df


def covering(geofences: DataFrame, finest: int = 13) -> DataFrame:
    """geofences (geofence_id, area) with kind, n, edges (of polygons), segments (of lines) and reach, in one row for each cell that may hold a part: level, cy and cx.

    A cell of level k is 360 / 2^k degrees wide and high, and columns go round the globe. An area's level is that at which it is
    two to four cells wide, so that it has 36 cells at most, whatever its size.
    """
    n, ring = geo.numbers(F.col("area")), geo.points(F.col("area"))
    kind = F.regexp_extract("area", "^[A-Z]+", 0)
    reach = F.when(kind == "CIRCLE", n[2]).when(kind == "LINESTRING", F.lit(LINE_M)).otherwise(0.0)
    lat = F.when(kind == "CIRCLE", F.array(n[0])).otherwise(F.transform(ring, lambda p: p["lat"]))
    lon = F.when(kind == "CIRCLE", F.array(n[1])).otherwise(F.transform(ring, lambda p: p["lon"]))
    g = geofences.withColumns({"kind": kind, "n": n, "ring": ring, "reach": reach, "lats": lat, "lons": lon})
    # Over the 180th meridian longitudes go from 0 to 360, as in the exact test. A line that passes it and comes from afar may be anywhere.
    far = F.exists("lons", lambda x: x > 90) & F.exists("lons", lambda x: x < -90)
    near = (F.col("kind") != "LINESTRING") | F.forall("lons", lambda x: F.abs(x) > 90)
    g = g.withColumn("lons", F.when(far & near, F.transform("lons", lambda x: F.when(x < -90, x + 360).otherwise(x))).otherwise(F.col("lons")))
    dy = geo.latitude_delta(F.col("reach")) * 1.01
    g = g.withColumns({"south": F.array_min("lats") - dy, "north": F.array_max("lats") + dy})
    pole = F.least(F.lit(89.0), F.greatest(F.abs("south"), F.abs("north")))
    dx = F.when(F.col("reach") > 0, F.when((F.col("north") > 89) | (F.col("south") < -89) | (far & ~near), 360.0).otherwise(geo.longitude_delta(F.col("reach"), pole) * 1.01)).otherwise(0.0)
    g = g.withColumns({"west": F.array_min("lons") - dx, "east": F.array_max("lons") + dx})
    extent = F.greatest(F.col("north") - F.col("south"), F.least(F.lit(360.0), F.col("east") - F.col("west")), F.lit(1e-9))
    g = g.withColumn("level", F.least(F.lit(finest), F.greatest(F.lit(0), F.floor(F.log2(360 / extent)) + 2)).cast("int"))
    g = g.withColumn("cy", F.explode(F.sequence(_cell("south", 90), _cell("north", 90))))
    round_ = F.expr("shiftleft(1L, level)")
    last = F.least(_cell("east", 180), _cell("west", 180) + round_ - 1)
    cx = F.array_distinct(F.transform(F.sequence(_cell("west", 180), last), lambda x: F.pmod(x, round_)))
    shape = {"edges": F.when(F.col("kind") == "POLYGON", geo.edges(F.col("ring"))), "segments": F.when(F.col("kind") == "LINESTRING", geo.segments(F.col("ring")))}
    return g.withColumns(shape | {"cx": F.explode(cx)}).select("geofence_id", "kind", "n", "edges", "segments", "reach", "level", "cy", "cx")


def _cell(degrees: str, shift: int) -> Column:
    """The number of the cell of a level that a coordinate is in."""
    return F.floor((F.col(degrees) + shift) * F.expr("shiftleft(1L, level)") / 360).cast("long")


def tagged(positions: DataFrame, geofences: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(id, device_id, fix_ms, geofence_id) for positions inside geofences (geofence_id, area), with more columns of positions.

    Both sides are dealt to the cells of covering(), positions once for each level that geofences have, of 14 at most, so that
    the exact test runs for pairs in the same cell only.
    """
    g = covering(geofences)
    levels = [r.level for r in g.select("level").distinct().collect()]
    keep = ["id", "device_id", "fix_ms", *(more or [])]
    p = positions.select(*keep, "latitude", "longitude", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    p = p.withColumns({"cy": _cell("latitude", 90), "cx": F.pmod(_cell("longitude", 180), F.expr("shiftleft(1L, level)"))})
    at = (F.col("latitude"), F.col("longitude"))
    inside = F.when(F.col("kind") == "CIRCLE", geo.in_circle(*at, F.col("n"))).when(F.col("kind") == "POLYGON", geo.within(*at, F.col("edges"))).otherwise(geo.along(*at, F.col("segments"), F.col("reach")))
    return p.join(g, ["level", "cy", "cx"]).where(inside).select(*keep, "geofence_id")


def quality(df: DataFrame, accuracy_m: float = 80, speed_kn: float = 140, same_s: int = 120) -> DataFrame:
    """verdict: DUPLICATE of the row before, HIDE where inaccurate or implausibly fast, else ACCEPT."""
    w = by_time()
    dt = F.col("fix_ms") - F.lag("fix_ms").over(w)
    same = (F.lag("latitude").over(w) == F.col("latitude")) & (F.lag("longitude").over(w) == F.col("longitude")) & (F.col("speed") == 0) & (F.lag("speed").over(w) == 0) & dt.between(0, same_s * 1000)
    implied = F.round(F.col("distance_mm") / dt * KNOTS["mps"], 6)
    return df.withColumn("verdict", F.when(same, "DUPLICATE").when((F.col("accuracy") > accuracy_m) | ((dt > 0) & (implied > speed_kn)), "HIDE").otherwise("ACCEPT"))
