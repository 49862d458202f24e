"""One query per operator over the adapter's tables, with the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text, units
from ..operators import events as ev
from ..operators import folds, hierarchy, mobile, pipeline, relations, reports, request
from ..sources import adapter, egress
from ..sources.adapter import DAY, GEOFENCES, HOUR, LINE_M, SQL_DISTANCE, START_MS, sql_haversine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOW, HIGH, NOW = START_MS + HOUR, START_MS + 5 * HOUR, START_MS + 6 * HOUR
W = "(PARTITION BY device_id ORDER BY fix_ms, id)"
HOURS_SQL = f"""h AS (SELECT *, CAST(sum(CASE WHEN ignition AND pi THEN fix_ms - pf ELSE 0 END) OVER (PARTITION BY device_id ORDER BY fix_ms, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hours_ms
  FROM (SELECT *, lag(ignition) OVER {W} AS pi, lag(fix_ms) OVER {W} AS pf FROM d))"""


def query(name: str, body: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = f
        if body:
            SQL[name] = "WITH RECURSIVE " + ",\n".join([adapter.SQL, *ctes]) + "\n" + body
        return f

    return add


pos = adapter.positions
far = lambda s, d: adapter.with_distance(adapter.positions(s, d))
full = lambda s, d: pipeline.engine_hours(far(s, d))


def by(name: str, body: str | None, f, *ctes: str) -> None:
    query(name, body, *ctes)(f)


# Request algebra
by("columns_include", "SELECT id, device_id, speed FROM p", lambda s, d: request.query(pos(s, d), request.include("id", "device_id", "speed")))
by("columns_exclude", "SELECT * EXCLUDE (latitude, longitude) FROM p", lambda s, d: request.query(pos(s, d), request.exclude("latitude", "longitude")))
by("cond_equals", "SELECT id, alarm FROM p WHERE device_id = 7", lambda s, d: request.query(pos(s, d), request.include("id", "alarm"), request.equals("device_id", 7)))
by("cond_compare_ops", "SELECT id, speed FROM p WHERE speed > 50 AND course <> 13 AND fuel <= 80", lambda s, d: request.query(pos(s, d), request.include("id", "speed"), request.merge([request.compare("speed", ">", 50), request.compare("course", "<>", 13), request.compare("fuel", "<=", 80)])))
by("cond_between", f"SELECT id, fix_ms FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH}", lambda s, d: request.query(pos(s, d), request.include("id", "fix_ms"), request.between("fix_ms", LOW, HIGH)))
by("cond_and_or", "SELECT id FROM p WHERE (speed = 0 OR speed > 100) AND ignition", lambda s, d: request.query(pos(s, d), request.include("id"), (request.equals("speed", 0) | request.compare("speed", ">", 100)) & F.col("ignition")))
by("cond_contains", "SELECT id, name FROM dev WHERE lower(name) LIKE '%000_1%' OR lower(category) LIKE '%000_1%'", lambda s, d: request.query(adapter.devices(s, d), request.include("id", "name"), request.contains(["name", "category"], "000_1")))
by("order_limit_offset", "SELECT id, balance FROM dev ORDER BY balance DESC, id LIMIT 20 OFFSET 10", lambda s, d: request.query(adapter.devices(s, d), request.include("id", "balance"), order=request.Order("balance", True, 20, 10, tie="id")))
by("order_fix_time_tiebreak", "SELECT id, fix_ms, speed FROM p ORDER BY fix_ms DESC, id LIMIT 25", lambda s, d: request.query(pos(s, d), request.include("id", "fix_ms", "speed"), order=request.Order("fix_ms", True, 25)))
by("latest_positions", f"SELECT device_id, id, fix_ms, speed FROM p QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY fix_ms DESC, id) = 1", lambda s, d: request.latest(pos(s, d)).select("device_id", "id", "fix_ms", "speed"))
by("latest_positions_device", "SELECT id, fix_ms FROM p WHERE device_id = 3 ORDER BY fix_ms DESC, id LIMIT 1", lambda s, d: request.latest(pos(s, d).where("device_id = 3")).select("id", "fix_ms"))
by("positions_range", f"SELECT id, device_id, fix_ms FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH} AND device_id IN (1, 2, 3)", lambda s, d: request.in_range(pos(s, d).where("device_id IN (1, 2, 3)"), LOW, HIGH).select("id", "device_id", "fix_ms"))
by("positions_range_with_extra", f"SELECT id, device_id, fix_ms FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH} UNION ALL SELECT * FROM (SELECT id, device_id, fix_ms FROM p WHERE fix_ms < {LOW} QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY fix_ms DESC, id) = 1)", lambda s, d: request.in_range(pos(s, d), LOW, HIGH, True).select("id", "device_id", "fix_ms"))
by("edge_position_first", f"SELECT device_id, id FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH} QUALIFY row_number() OVER {W} = 1", lambda s, d: request.edge(request.in_range(pos(s, d), LOW, HIGH), False).select("device_id", "id"))
by("edge_position_last", f"SELECT device_id, id FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH} QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY fix_ms DESC, id) = 1", lambda s, d: request.edge(request.in_range(pos(s, d), LOW, HIGH), True).select("device_id", "id"))

# Hierarchy
ANCESTORS = """anc AS (SELECT id AS group_id, id AS ancestor_id FROM grp UNION SELECT id, group_id FROM grp WHERE group_id IS NOT NULL
  UNION SELECT a.id, b.group_id FROM grp a JOIN grp b ON a.group_id = b.id WHERE b.group_id IS NOT NULL),
perm AS (SELECT user_id, device_id FROM ud UNION SELECT ug.user_id, dev.id FROM ug JOIN anc ON ug.group_id = anc.ancestor_id JOIN dev ON dev.group_id = anc.group_id)"""
access = lambda s, d: hierarchy.access(adapter.user_device(s, d), adapter.user_group(s, d), adapter.groups(s, d), adapter.devices(s, d))
perms = lambda s, d, g=True: hierarchy.permitted_devices(adapter.user_device(s, d), adapter.user_group(s, d), adapter.groups(s, d), adapter.devices(s, d), g)
by("permission_direct", "SELECT user_id, device_id FROM ud", lambda s, d: perms(s, d, False))
by("permission_group_expanded", "SELECT user_id, device_id FROM perm", lambda s, d: perms(s, d), ANCESTORS)
by("permission_exclude_groups", "SELECT id, fix_ms FROM p WHERE device_id IN (SELECT device_id FROM ud WHERE user_id = 5)", lambda s, d: hierarchy.permitted(pos(s, d), perms(s, d, False), 5).select("id", "fix_ms"))
by("permission_reverse", "SELECT device_id, count(*) AS users FROM perm GROUP BY 1", lambda s, d: access(s, d).counts(), ANCESTORS)
by("accessible_devices_by_group", "SELECT dev.id FROM dev WHERE group_id IN (SELECT id FROM grp WHERE id = 1001 OR group_id = 1001)", lambda s, d: adapter.devices(s, d).join(hierarchy.descendants(adapter.groups(s, d), [1001]).withColumnRenamed("id", "group_id"), "group_id", "left_semi").select("id"))


@query("attribute_lookup", """SELECT dev.id, CAST(coalesce(CASE WHEN dev.id % 10 = 0 THEN dev.id * 1.0 END, CASE WHEN dev.group_id % 5 = 0 THEN dev.group_id + 100.0 END, CASE WHEN g.group_id % 2 = 0 THEN g.group_id + 0.5 END, 7.0) AS DOUBLE) AS value
FROM dev JOIN grp g ON g.id = dev.group_id""")  # fmt: skip
def _(s, d):
    dev, grp = adapter.devices(s, d), adapter.groups(s, d)
    own = dev.where("id % 10 = 0").select("id", F.col("id").cast("double").alias("value"))
    of = grp.where("(id < 1000 and id % 5 = 0) or (id >= 1000 and id % 2 = 0)").select(F.col("id").alias("group_id"), F.when(F.col("id") < 1000, F.col("id") + 100.0).otherwise(F.col("id") + 0.5).alias("value"))
    return hierarchy.looked_up(dev, grp, own, of, 7.0)


# Scalar functions
by("haversine", f"SELECT id, round({sql_haversine('latitude', 'longitude', '40', '-3.7')}, 3) AS metres FROM p", lambda s, d: pos(s, d).select("id", F.round(geo.haversine("latitude", "longitude", F.lit(40.0), F.lit(-3.7)), 3).alias("metres")))


def _sql_line(lat1, lon1, lat2, lon2):
    d0, d1, d2 = sql_haversine("latitude", "longitude", lat1, lon1), sql_haversine(lat1, lon1, lat2, lon2), sql_haversine(lat2, lon2, "latitude", "longitude")
    return f"(SELECT CASE WHEN a*a > b*b + c*c THEN c WHEN c*c > b*b + a*a THEN a ELSE 2 * sqrt(greatest((a+b+c)/2 * ((a+b+c)/2-a) * ((a+b+c)/2-b) * ((a+b+c)/2-c), 0)) / b END FROM (SELECT {d0} AS a, {d1} AS b, {d2} AS c))"


by("distance_to_line", f"SELECT id, round({_sql_line('39.98', '-3.72', '40.02', '-3.68')}, 2) AS metres FROM p", lambda s, d: pos(s, d).select("id", F.round(geo.distance_to_line("latitude", "longitude", *map(F.lit, (39.98, -3.72, 40.02, -3.68))), 2).alias("metres")))
by("units_convert", "SELECT id, round(speed / 0.539957, 6) AS kph, round(speed / 0.868976, 6) AS mph, round(speed / 1.94384, 6) AS mps, round(altitude / 0.3048, 6) AS ft FROM p", lambda s, d: pos(s, d).select("id", *[F.round(units.from_knots(F.col("speed"), u), 6).alias(u) for u in ("kph", "mph", "mps")], F.round(units.from_metres(F.col("altitude"), "ft"), 6).alias("ft")))


@query("text_functions", "SELECT id, CAST((id >> 3) & 31 AS BIGINT) AS middle, (id >> 2) & 1 = 1 AS third, sha256(id || '|' || device_id || '|') AS hash, CAST('0x' || substr(sha256(CAST(device_id AS VARCHAR)), 1, 4) AS INT) % 100 AS bucket FROM p")
def _(s, d):
    return pos(s, d).select("id", text.bits(F.col("id"), 3, 8).alias("middle"), text.bit(F.col("id"), 2).alias("third"), text.canonical_hash(F.col("id"), F.col("device_id"), F.lit(None)).alias("hash"), text.rollout_bucket(F.col("device_id").cast("string")).alias("bucket"))


def _ring(wkt):
    n = [x.split() for x in wkt[wkt.rindex("(") + 1 : wkt.index(")")].split(",")]
    return [(p[0], p[1]) for p in n]


def _contains(i: int, area: str) -> str:
    if area.startswith("CIRCLE"):
        lat, lon, r = area[8:-1].replace(",", "").split()
        return f"{sql_haversine(lat, lon, 'latitude', 'longitude')} <= {r}"
    ring = _ring(area)
    if area.startswith("POLYGON"):
        edges = zip(ring, ring[-1:] + ring[:-1], strict=True)
        return "(" + " + ".join(f"CASE WHEN (({a[1]} < longitude AND {b[1]} >= longitude) OR ({b[1]} < longitude AND {a[1]} >= longitude)) AND {a[0]} + (longitude - {a[1]}) * ({b[0]} - {a[0]}) / nullif({b[1]} - {a[1]}, 0) < latitude THEN 1 ELSE 0 END" for a, b in edges) + ") % 2 = 1"
    return "(" + " OR ".join(f"{_sql_line(*a, *b)} <= {LINE_M}" for a, b in zip(ring, ring[1:], strict=False)) + ")"


TAGS = "t AS (" + " UNION ALL ".join(f"SELECT id, device_id, fix_ms, {i} AS geofence_id FROM p WHERE {_contains(i, a)}" for i, _, a in GEOFENCES) + ")"
for _kind, _ids in (("circle", (1, 2, 3)), ("polygon", (4, 5)), ("polyline", (6,))):
    by(f"geofence_{_kind}", f"SELECT id, geofence_id FROM t WHERE geofence_id IN ({', '.join(map(str, _ids))})", lambda s, d, ids=_ids: pipeline.tagged(pos(s, d), adapter.geofences(s).where(F.col("geofence_id").isin(*ids))).select("id", "geofence_id"), TAGS)
by("geofence_tagging", "SELECT id, device_id, count(*) AS n, min(geofence_id) AS first_id FROM t GROUP BY ALL", lambda s, d: pipeline.tagged(pos(s, d), adapter.geofences(s)).groupBy("id", "device_id").agg(F.count("*").alias("n"), F.min("geofence_id").alias("first_id")), TAGS)
by("geofence_altitude", "SELECT id FROM t JOIN p USING (id) WHERE geofence_id = 2 AND altitude BETWEEN 20 AND 60", lambda s, d: pipeline.tagged(pipeline.at_altitude(pos(s, d), 20, 60), adapter.geofences(s).where("geofence_id = 2")).select("id"), TAGS)

# Pipeline
by("time_rollover", f"SELECT id, CAST(o + CASE WHEN {NOW} - o - {pipeline.GPS_CYCLE_MS - pipeline.NINETY_DAYS_MS} > 0 THEN ceil(({NOW} - o - {pipeline.GPS_CYCLE_MS - pipeline.NINETY_DAYS_MS}) / {pipeline.GPS_CYCLE_MS}) * {pipeline.GPS_CYCLE_MS} ELSE 0 END AS BIGINT) AS ms FROM (SELECT id, fix_ms - (id % 3) * {pipeline.GPS_CYCLE_MS} AS o FROM p)", lambda s, d: pos(s, d).select("id", pipeline.rollover(F.col("fix_ms") - F.col("id") % 3 * pipeline.GPS_CYCLE_MS, NOW).cast("long").alias("ms")))
by("time_override", "SELECT id, server_ms AS fix_ms FROM p", lambda s, d: pipeline.time_override(pos(s, d), "serverTime").select("id", "fix_ms"))
by("hemisphere", "SELECT id, -abs(latitude) AS latitude, abs(longitude) AS longitude FROM p", lambda s, d: pipeline.hemisphere(pos(s, d), "S", "E").select("id", "latitude", "longitude"))
by("outdated_fill", f"SELECT id, CASE WHEN id % 4 = 0 THEN last_value(CASE WHEN id % 4 <> 0 THEN latitude END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY fix_ms, id ROWS UNBOUNDED PRECEDING) ELSE latitude END AS latitude FROM p", lambda s, d: pipeline.filled(pos(s, d), ["latitude"], F.col("id") % 4 == 0).select("id", "latitude"))
by("distance_total", "SELECT id, distance_mm, total_mm FROM d", lambda s, d: far(s, d).select("id", "distance_mm", "total_mm"), SQL_DISTANCE)
by("motion_flag", f"SELECT id, speed > 0.01 OR CASE WHEN fix_ms - lag(fix_ms) OVER {W} > 0 THEN round(distance_mm / (fix_ms - lag(fix_ms) OVER {W}) * 1.94384, 6) > 0.5 ELSE distance_mm > 0 END AS moving FROM d", lambda s, d: pipeline.motion_flag(far(s, d)).select("id", "moving"), SQL_DISTANCE)
by("engine_hours", "SELECT id, hours_ms FROM h", lambda s, d: full(s, d).select("id", "hours_ms"), SQL_DISTANCE, HOURS_SQL)
by("copy_attributes", "SELECT id, last_value(alarm IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY fix_ms, id ROWS UNBOUNDED PRECEDING) AS alarm FROM p", lambda s, d: pipeline.copied(pos(s, d), ["alarm"]).select("id", "alarm"))
by("driver_link", "SELECT p.id, coalesce(CASE WHEN p.id % 2 = 0 THEN driver_unique_id END, 'C' || dev.group_id) AS driver FROM p LEFT JOIN dev ON dev.id = p.device_id",
   lambda s, d: relations.linked_drivers(pos(s, d).withColumn("driver_unique_id", F.when(F.col("id") % 2 == 0, F.col("driver_unique_id"))), adapter.devices(s, d).select(F.col("id").alias("device_id"), F.concat(F.lit("C"), F.col("group_id").cast("string")).alias("linked_driver"))).select("id", F.col("driver_unique_id").alias("driver")))
by("filter_flags", "SELECT id FROM p WHERE NOT (id % 17 = 0 OR id % 13 = 0 OR id % 11 = 0)", lambda s, d: (lambda df: pipeline.kept(df, *pipeline.flagged(df).values()).select("id"))(pos(s, d).withColumns({"valid": F.col("id") % 17 != 0, "outdated": F.col("id") % 13 == 0, "approximate": F.when(F.col("id") % 11 == 0, True)})))
by("computed_attribute", f"SELECT id, speed - lag(speed) OVER {W} AS delta, CASE WHEN fuel <> 0 THEN speed / fuel END AS ratio, CAST(NULL AS DOUBLE) AS first, speed AS second FROM p", lambda s, d: pipeline.computed(pos(s, d), [("delta", "speed - last_speed"), pipeline.Computed("ratio", "speed / fuel"), pipeline.Computed("first", "CAST(driver_unique_id AS INT)", "number", 9), pipeline.Computed("second", "coalesce(first, 0) + speed")]).select("id", "delta", "ratio", "first", "second"))
_f = lambda s, d, *names: pipeline.kept(pos(s, d), *[pipeline.filters(NOW, past_s=5 * 3600, future_s=0)[n] for n in names]).select("id")


by("filter_invalid_zero", "SELECT id FROM p WHERE NOT (abs(latitude) > 90 OR abs(longitude) > 180 OR (latitude = 0 AND longitude = 0))", lambda s, d: _f(s, d, "invalid", "zero"))
by("filter_accuracy_static", "SELECT id FROM p WHERE NOT (accuracy > 100 OR speed = 0)", lambda s, d: _f(s, d, "accuracy", "static"))
by("filter_future_past", f"SELECT id FROM p WHERE NOT (fix_ms > {NOW} OR fix_ms < {NOW - 5 * HOUR})", lambda s, d: _f(s, d, "future", "past"))


by("mobile_quality_verdict", f"""SELECT id, CASE WHEN lag(latitude) OVER {W} = latitude AND lag(longitude) OVER {W} = longitude AND speed = 0 AND lag(speed) OVER {W} = 0 AND fix_ms - lag(fix_ms) OVER {W} BETWEEN 0 AND 120000 THEN 'DUPLICATE'
  WHEN accuracy > 80 OR (fix_ms - lag(fix_ms) OVER {W} > 0 AND round(distance_mm / (fix_ms - lag(fix_ms) OVER {W}) * 1.94384, 6) > 140) THEN 'HIDE' ELSE 'ACCEPT' END AS verdict FROM d""", lambda s, d: pipeline.quality(far(s, d)).select("id", "verdict"), SQL_DISTANCE)  # fmt: skip

# Events
_e = "device_id, id AS position_id, fix_ms AS event_ms"
by("ev_media", f"SELECT {_e}, 'alarm' AS media, alarm AS file FROM p WHERE alarm IS NOT NULL", lambda s, d: ev.media(pos(s, d), ["alarm"]))
by("ev_command_result", f"SELECT {_e}, 'done' AS result FROM p WHERE alarm = 'sos'", lambda s, d: ev.command_result(pos(s, d).withColumn("result", F.when(F.col("alarm") == "sos", "done")), "result"))
by("ev_overspeed", f"""SELECT {_e}, speed, CAST(60.0 AS DOUBLE) AS speed_limit FROM (SELECT *, fix_ms - min(fix_ms) OVER (PARTITION BY device_id, run) AS since FROM
  (SELECT *, sum(CASE WHEN speed > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY fix_ms, id) AS run FROM p) WHERE speed > 60) WHERE since >= 300000 QUALIFY row_number() OVER (PARTITION BY device_id, run ORDER BY fix_ms, id) = 1""", lambda s, d: ev.overspeed(pos(s, d), F.lit(60.0), 300))  # fmt: skip
by("ev_behavior", f"SELECT {_e}, CASE WHEN r >= 0.1 THEN 'hardAcceleration' ELSE 'hardBraking' END AS type FROM (SELECT *, round((speed - lag(speed) OVER {W}) / 1.94384 * 1000 / (fix_ms - lag(fix_ms) OVER {W}), 9) AS r FROM p) WHERE abs(r) >= 0.1", lambda s, d: ev.behavior(pos(s, d), 0.1, 0.1))
by("ev_fuel", f"SELECT {_e}, CASE WHEN c >= 50 THEN 'deviceFuelIncrease' ELSE 'deviceFuelDrop' END AS type, c AS change FROM (SELECT *, fuel - lag(fuel) OVER {W} AS c FROM p) WHERE c >= 50 OR -c >= 60", lambda s, d: ev.fuel(pos(s, d), 50, 60))
by("ev_alarm", f"SELECT {_e}, unnest(list_distinct(string_split(alarm, ','))) AS alarm_type FROM p WHERE alarm IS NOT NULL", lambda s, d: ev.alarms(pos(s, d)))
by("ev_alarm_dedup", f"SELECT {_e}, unnest(list_filter(list_distinct(string_split(alarm, ',')), lambda x: NOT list_contains(coalesce(string_split(b, ','), []), x))) AS alarm_type FROM (SELECT *, lag(alarm) OVER {W} AS b FROM p) WHERE alarm IS NOT NULL", lambda s, d: ev.alarms(pos(s, d), True))
by("ev_ignition", f"SELECT {_e}, CASE WHEN ignition THEN 'ignitionOn' ELSE 'ignitionOff' END AS type FROM (SELECT *, lag(ignition) OVER {W} AS b FROM p) WHERE ignition <> b", lambda s, d: ev.ignition(pos(s, d)))
by("ev_maintenance", f"SELECT {_e}, total_mm AS value FROM (SELECT *, lag(total_mm) OVER {W} AS b FROM d) WHERE b <> 0 AND total_mm <> 0 AND total_mm >= 1000000 AND (b < 1000000 OR trunc((b - 1000000) / 5e5) < trunc((total_mm - 1000000) / 5e5))", lambda s, d: ev.maintenance(far(s, d), "total_mm", 1e6, 5e5), SQL_DISTANCE)
by("ev_driver", f"SELECT {_e}, driver_unique_id FROM (SELECT *, lag(driver_unique_id) OVER {W} AS b FROM p) WHERE driver_unique_id <> coalesce(b, '')", lambda s, d: ev.driver(pos(s, d)))
SETS = f"s AS (SELECT p.device_id, p.id, p.fix_ms, list(geofence_id) FILTER (geofence_id IS NOT NULL) AS now FROM p LEFT JOIN t ON t.id = p.id GROUP BY ALL), c AS (SELECT device_id, id, fix_ms, coalesce(now, []) AS now, coalesce(lag(now) OVER {W}, []) AS old FROM s)"
GEO_EVENTS = f"""ge AS (SELECT {_e}, 'geofenceExit' AS type, unnest(list_filter(old, lambda x: NOT list_contains(now, x))) AS geofence_id FROM c UNION ALL
  SELECT {_e}, 'geofenceEnter', unnest(list_filter(now, lambda x: NOT list_contains(old, x))) FROM c)"""
geo_events = lambda s, d: ev.geofence(pipeline.tagged(pos(s, d), adapter.geofences(s)), pos(s, d))
by("ev_geofence", "SELECT device_id, position_id, event_ms, type, geofence_id FROM ge", geo_events, TAGS, SETS, GEO_EVENTS)


@query("ev_proximity", f"""SELECT device_id, id AS position_id, fix_ms AS event_ms, CASE WHEN near THEN 'proximityEnter' ELSE 'proximityExit' END AS type, linked_id FROM
  (SELECT *, lag(near) OVER (PARTITION BY device_id, linked_id ORDER BY fix_ms, id) AS old FROM (SELECT a.device_id, a.id, a.fix_ms, a.device_id + 1 AS linked_id,
   round({sql_haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")} * 1000) <= 2500000 AS near FROM p a ASOF JOIN p b ON b.device_id = a.device_id + 1 AND a.fix_ms >= b.fix_ms)) WHERE (near AND NOT coalesce(old, false)) OR (NOT near AND old)""")  # fmt: skip
def _(s, d):
    p = pos(s, d)
    return ev.proximity(p, p.select("device_id", (F.col("device_id") + 1).alias("linked_id")).distinct(), 2500)


STALE = "l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY fix_ms DESC, id) = 1)"
by("ev_inactive", f"SELECT device_id, {NOW} - fix_ms AS silent_ms FROM l WHERE {NOW} - fix_ms - 600000 >= 0 AND ({NOW} - fix_ms - 600000 < 900000 OR ({NOW} - fix_ms - 600000) % 3600000 < 900000)", lambda s, d: ev.inactive(request.latest(pos(s, d)), NOW, 600, 3600), STALE)
by("ev_presence", f"SELECT device_id, CASE WHEN {NOW} - fix_ms > 600000 THEN 'OFFLINE' WHEN {NOW} - fix_ms > 300000 THEN 'SUSPECT' ELSE 'ONLINE' END AS state FROM l", lambda s, d: ev.presence(request.latest(pos(s, d)), NOW), STALE)
by("ev_telemetry", f"SELECT {_e}, fuel FROM (SELECT *, lag(fuel) OVER {W} AS b FROM p) WHERE b > 10 AND fuel <= 10", lambda s, d: ev.battery_low(pos(s, d)))

# Reports
by("rep_route", f"SELECT id, device_id, fix_ms, latitude, longitude, speed FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH} AND device_id IN (SELECT device_id FROM perm WHERE user_id = 2)", lambda s, d: hierarchy.permitted(request.in_range(pos(s, d), LOW, HIGH), perms(s, d), 2).select("id", "device_id", "fix_ms", "latitude", "longitude", "speed"), ANCESTORS)
by("rep_events", f"SELECT {_e}, unnest(string_split(alarm, ',')) AS alarm_type FROM p WHERE alarm IS NOT NULL AND fix_ms BETWEEN {LOW} AND {HIGH}", lambda s, d: ev.alarms(request.in_range(pos(s, d), LOW, HIGH)))
_summary = lambda by_, src: f"""SELECT {by_}, start_ms, end_ms, distance, max_speed, spent_fuel, start_hours, end_hours, round(CASE WHEN end_hours > start_hours THEN distance * 1000 / (end_hours - start_hours) * 1.94384 ELSE 0 END, 6) AS average_speed FROM (
  SELECT {by_}, min(fix_ms) AS start_ms, max(fix_ms) AS end_ms, (arg_max(total_mm, fix_ms) - arg_min(total_mm, fix_ms)) / 1000 AS distance, max(speed) AS max_speed, arg_min(fuel, fix_ms) - arg_max(fuel, fix_ms) AS spent_fuel, arg_min(hours_ms, fix_ms) AS start_hours, arg_max(hours_ms, fix_ms) AS end_hours FROM {src} GROUP BY {by_})"""  # noqa: E731
by("rep_summary", _summary("device_id", "h"), lambda s, d: reports.summary(full(s, d), ["device_id"]), SQL_DISTANCE, HOURS_SQL)
by("rep_summary_daily", _summary("device_id, day", f"(SELECT *, unnest(CASE WHEN fix_ms % {DAY} = 0 THEN [fix_ms // {DAY}, fix_ms // {DAY} - 1] ELSE [fix_ms // {DAY}] END) AS day FROM h)"), lambda s, d: reports.daily_summary(full(s, d)), SQL_DISTANCE, HOURS_SQL)
by("rep_geofences", "SELECT device_id, geofence_id, event_ms AS start_ms, e AS end_ms FROM (SELECT *, lead(type) OVER w AS n, lead(event_ms) OVER w AS e FROM ge WINDOW w AS (PARTITION BY device_id, geofence_id ORDER BY event_ms, position_id, type)) WHERE type = 'geofenceEnter' AND n = 'geofenceExit'", lambda s, d: reports.geofence_visits(geo_events(s, d)), TAGS, SETS, GEO_EVENTS)
by("rep_combined", f"SELECT p.device_id, count(*) AS points, count(ge.position_id) AS events FROM p LEFT JOIN (SELECT DISTINCT position_id FROM ge) ge ON ge.position_id = p.id WHERE fix_ms BETWEEN {LOW} AND {HIGH} GROUP BY 1", lambda s, d: request.in_range(pos(s, d), LOW, HIGH).join(geo_events(s, d).select(F.col("position_id").alias("id"), F.lit(1).alias("hit")).distinct(), "id", "left").groupBy("device_id").agg(F.count("*").alias("points"), F.count("hit").alias("events")), TAGS, SETS, GEO_EVENTS)
by("rep_devices", "SELECT dev.id, dev.name, l.id AS position_id, l.fix_ms FROM dev LEFT JOIN l ON l.device_id = dev.id", lambda s, d: adapter.devices(s, d).select("id", "name").join(request.latest(pos(s, d)).select(F.col("device_id").alias("id"), F.col("id").alias("position_id"), "fix_ms"), "id", "left"), STALE)


@query("rep_journeys", f"""SELECT mk.device_id, mk.journey_id, mk.start_ms, mk.end_ms, coalesce(points, 0) AS points, coalesce(distance_m, 0) AS distance_m, coalesce(max_gap_s, 0) AS max_gap_s, coalesce(gaps_over_60, 0) AS gaps_over_60 FROM mk LEFT JOIN
  (SELECT journey_id, count(*) AS points, coalesce(sum(step), 0) / 1000 AS distance_m, max(gap) AS max_gap_s, count(*) FILTER (gap > 60) AS gaps_over_60 FROM (SELECT journey_id, CASE WHEN lag(id) OVER w IS NOT NULL THEN distance_mm END AS step,
     CASE WHEN speed > 3 OR lag(speed) OVER w > 3 THEN (fix_ms - lag(fix_ms) OVER w) // 1000 END AS gap FROM mk JOIN d ON d.device_id = mk.device_id AND d.fix_ms >= mk.start_ms AND (mk.end_ms IS NULL OR d.fix_ms < mk.end_ms OR (d.fix_ms = mk.end_ms AND d.alarm = 'fault,lowBattery')) AND d.fix_ms BETWEEN {LOW} AND {HIGH}
     WINDOW w AS (PARTITION BY journey_id ORDER BY fix_ms, id)) GROUP BY 1) st ON st.journey_id = mk.journey_id""", SQL_DISTANCE, f"mk AS (SELECT device_id, id AS journey_id, fix_ms AS start_ms, e AS end_ms FROM (SELECT *, lead(fix_ms) OVER {W} AS e FROM d WHERE alarm IS NOT NULL) WHERE alarm = 'sos')")  # fmt: skip
def _(s, d):
    return reports.journeys(far(s, d), F.coalesce(F.col("alarm") == "sos", F.lit(False)), F.coalesce(F.col("alarm") == "fault,lowBattery", F.lit(False)), LOW, HIGH)


by("rep_journeys_totals", "SELECT count(*) AS journeys, count(*) FILTER (e IS NULL) AS active FROM (SELECT *, lead(fix_ms) OVER (PARTITION BY device_id ORDER BY fix_ms, id) AS e FROM p WHERE alarm IS NOT NULL) WHERE alarm = 'sos'", lambda s, d: QUERIES["rep_journeys"](s, d).agg(F.count("*").alias("journeys"), F.count_if(F.col("end_ms").isNull()).alias("active")))
by("rep_continuity", "SELECT *, round(CASE WHEN last_ms > first_ms THEN tracking_ms * 100.0 / (last_ms - first_ms) ELSE 100 END, 2) AS continuity_pct FROM (SELECT device_id, count(*) AS fixes, min(fix_ms) AS first_ms, max(fix_ms) AS last_ms, CAST(coalesce(sum(least(dt, 300000)), 0) AS BIGINT) AS tracking_ms, count(*) FILTER (dt > 300000) AS gaps, coalesce(max(dt), 0) AS longest_gap_ms FROM (SELECT device_id, fix_ms, fix_ms - lag(fix_ms) OVER (PARTITION BY device_id ORDER BY fix_ms) AS dt FROM (SELECT DISTINCT device_id, fix_ms FROM p)) GROUP BY 1)", lambda s, d: reports.continuity(pos(s, d)))
by("rep_timeline_gaps", f"SELECT device_id, start_ms, end_ms, clipped FROM (SELECT device_id, fix_ms AS end_ms, coalesce(lag(fix_ms) OVER w, {LOW}) AS start_ms, lag(fix_ms) OVER w IS NULL OR z AS clipped FROM (SELECT device_id, fix_ms, false AS z FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH} UNION ALL SELECT DISTINCT device_id, {HIGH}, true FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH}) WINDOW w AS (PARTITION BY device_id ORDER BY fix_ms, z)) WHERE end_ms - start_ms > 300000", lambda s, d: reports.capture_gaps(pos(s, d), LOW, HIGH))
_runs = lambda cond, value: f"SELECT device_id, min(fix_ms) AS start_ms, max(fix_ms) AS end_ms, count(*) AS n, max({value}) AS largest FROM (SELECT *, sum(CASE WHEN {cond} THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY fix_ms, id) AS run FROM p) WHERE {cond} GROUP BY device_id, run"
by("rep_timeline_delays", f"SELECT *, CASE WHEN largest >= 3600000 THEN 'critical' ELSE 'warning' END AS severity FROM ({_runs('server_ms - fix_ms >= 300000', 'server_ms - fix_ms')})", lambda s, d: reports.delivery_delays(pos(s, d)))
by("rep_timeline_backlog", _runs("fuel > 50", "fuel"), lambda s, d: reports.runs(pos(s, d), F.col("fuel") > 50, F.col("fuel")))


@query("rep_timeline_recovery", "SELECT *, CASE WHEN list_contains(string_split(stages, ','), 'purchase') THEN 'success' WHEN n >= 3 THEN 'timeout' ELSE 'open' END AS outcome FROM (SELECT user_id AS device_id, event_id // 500 AS attempt, min(event_id) AS start_ms, max(event_id) AS end_ms, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS stages FROM events GROUP BY 1, 2)")
def _(s, d):
    e = adapter.read(s, d, "events").select(F.col("user_id").alias("device_id"), F.floor(F.col("event_id") / 500).cast("long").alias("attempt"), F.col("event_type").alias("stage"), F.col("event_id").alias("ts"))
    return reports.recovery(e, "purchase", 3)


by("rep_admin_alerts", f"""SELECT device_id, fix_ms AS ts, 'silence' AS kind, CASE WHEN {NOW} - fix_ms >= 1800000 THEN 'critical' ELSE 'warning' END AS severity FROM l WHERE {NOW} - fix_ms >= 600000 UNION ALL
  SELECT device_id, fix_ms, 'battery', CASE WHEN fuel <= 5 THEN 'critical' ELSE 'info' END FROM l WHERE fuel <= 15""", lambda s, d: reports.admin_alerts(request.latest(pos(s, d)), NOW).orderBy(text.severity_rank(F.col("severity")).desc(), F.desc("ts")), STALE)  # fmt: skip
by("rep_statistics_daily", "SELECT day, CAST(sum(n) AS BIGINT) AS messages, count(*) AS devices, " + ", ".join(f"count(*) FILTER (protocol = '{x}') AS devices_{x}" for x in ("osmand", "h02", "mobile")) + f" FROM (SELECT fix_ms // {DAY} AS day, device_id, count(*) AS n, arg_max(protocol, (server_ms - {START_MS}) * 10000000 + id) AS protocol FROM p GROUP BY 1, 2) GROUP BY 1", lambda s, d: reports.daily_statistics(pos(s, d), ["osmand", "h02", "mobile"]))


@query("rep_notification_routing", "SELECT perm.user_id, n.nid AS notification_id, a.position_id, unnest(string_split(n.via, ',')) AS notificator FROM (SELECT device_id, id AS position_id, unnest(string_split(alarm, ',')) AS alarm_type FROM p WHERE alarm IS NOT NULL) a JOIN (VALUES (1, 'sos', 'web,mail'), (2, 'fault,tow', 'sms')) n(nid, al, via) ON list_contains(string_split(n.al, ','), a.alarm_type) JOIN perm ON perm.device_id = a.device_id", ANCESTORS)
def _(s, d):
    return _routed(s, d, pos(s, d))




def _routed(s, d, positions):
    e = ev.alarms(positions).withColumn("type", F.lit("alarm"))
    rules = s.createDataFrame([(1, "alarm", "sos", "web,mail"), (2, "alarm", "fault,tow", "sms")], "notification_id int, type string, alarms string, notificators string")
    return reports.notifications(e, rules, access(s, d))


# Mobile channel
@query("envelope_validate", f"SELECT id, CASE WHEN NOT regexp_full_match(mid, '[A-Za-z0-9_-]{{8,64}}') THEN 'message_id' WHEN id % 7 - 1 < 0 THEN 'sequence' WHEN fix_ms < {NOW + 6 * DAY + 20 * HOUR} - {7 * DAY} THEN 'expired' WHEN accuracy - 3 < 0 THEN 'accuracy' END AS reason FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 'bad id' ELSE 'msg-' || CAST(10000 + id AS VARCHAR) END AS mid FROM p)")
def _(s, d):
    m = pos(s, d).select("id", F.when(F.col("id") % 11 == 0, "bad id").otherwise(F.concat(F.lit("msg-"), (F.col("id") + 10000).cast("string"))).alias("message_id"), (F.col("id") % 7 - 1).alias("sequence"), F.col("fix_ms").alias("observed_ms"), "latitude", "longitude", (F.col("accuracy") - 3).alias("accuracy"))
    return m.select("id", mobile.rejection(NOW + 6 * DAY + 20 * HOUR).alias("reason"))


@query("ledger_classify", "SELECT id, CASE WHEN rn = 1 THEN 'accepted' WHEN h = first_value(h) OVER w THEN 'duplicate' ELSE 'rejected' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY ms, id) AS rn FROM (SELECT id, server_ms AS ms, id // 3 AS m, sha256(id // 3 % 5 || '|' || id // 3 || '|' || CASE WHEN id % 3 = 2 AND id % 2 = 0 THEN 'x' ELSE 'y' END) AS h FROM p)) WINDOW w AS (PARTITION BY m ORDER BY ms, id)")
def _(s, d):
    third = F.floor(F.col("id") / 3).cast("long")
    m = pos(s, d).select("id", F.col("server_ms").alias("received_ms"), third.alias("message_id"), (third % 5).alias("device_id"), third.alias("sequence"), F.when((F.col("id") % 3 == 2) & (F.col("id") % 2 == 0), "x").otherwise("y").alias("payload"))
    return mobile.classified(m).select("id", "outcome")


by("rollout_bucket", "SELECT id, CAST('0x' || substr(sha256(name), 1, 4) AS INT) % 100 AS bucket FROM dev", lambda s, d: adapter.devices(s, d).select("id", text.rollout_bucket(F.col("name")).alias("bucket")))
by("telemetry_ring", "SELECT device_id, array_to_string(list(CAST(fuel AS DECIMAL(4, 1)) ORDER BY fix_ms, id), ',') AS ring FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY fix_ms DESC, id DESC) <= 24) GROUP BY 1", lambda s, d: mobile.telemetry_ring(pos(s, d), "fuel"))
by("health_snapshot", f"SELECT event_id AS id, CASE WHEN event_type NOT IN ('click', 'view') THEN 'event_type' WHEN NOT event_id * 2000 + {START_MS} BETWEEN {NOW - 7 * DAY} AND {NOW + 300_000} THEN 'ts' END AS reason, greatest(event_id % 9 - 4, 0) AS outbox FROM events", lambda s, d: mobile.health(adapter.read(s, d, "events").select(F.col("event_id").alias("id"), "event_type", (F.col("event_id") * 2000 + START_MS).alias("ts"), (F.col("event_id") % 9 - 4).alias("outbox")), NOW, ["click", "view"]).select("id", "reason", "outbox"))

# Egress
by("csv_export", """SELECT id, id || ',' || device_id || ',' || protocol || ',' || CASE WHEN contains(alarm, ',') THEN chr(34) || alarm || chr(34) ELSE coalesce(alarm, '') END || ',' || (id - 100) || ','
  || CASE WHEN id % 3 = 0 THEN '' ELSE 'n' || id END AS line FROM p""",
   lambda s, d: egress.csv_lines(pos(s, d).withColumns({"x": F.col("id") - 100, "note": F.concat(F.when(F.col("id") % 3 == 0, " =").otherwise(" n"), "id")}), ["id", "device_id", "protocol", "alarm", "x", "note"]))
by("gpx_export", "SELECT device_id, id, '<trkpt lat=\"' || printf('%.5f', latitude) || '\" lon=\"' || printf('%.5f', longitude) || '\"><time>' || strftime(epoch_ms(fix_ms), '%Y-%m-%dT%H:%M:%SZ') || '</time></trkpt>' AS trkpt FROM p", lambda s, d: egress.gpx_points(pos(s, d)))
by("kml_coordinates", "SELECT device_id, id, printf('%.5f,%.5f,%.1f', longitude, latitude, altitude) AS coord FROM p", lambda s, d: egress.kml_coordinates(pos(s, d)))
by("kafka_payload", "SELECT CAST(device_id AS VARCHAR) AS key, '{\"id\":' || id || ',\"protocol\":\"' || protocol || '\"}' AS value FROM p", lambda s, d: egress.payload(pos(s, d), "device_id", ["id", "protocol"]))
by("url_forward", "SELECT id, 'http://x/?id=' || device_id || '&a=' || coalesce(replace(alarm, ',', '%2C'), '') || '&s=' || CASE WHEN alarm IS NOT NULL THEN '0xF841' WHEN speed < 1 THEN '0xF020' ELSE '0xF11C' END AS url FROM p", lambda s, d: egress.templated(pos(s, d), "http://x/?id={device_id}&a={alarm}&s={statusCode}", ["device_id", "alarm"]))

# Joins, guards and counts beside the pipeline
def _open_hours(s):
    """Calendar 0 is open in the second and third hour, calendar 1 in the fourth; other devices have none."""
    return s.createDataFrame([(0, START_MS + HOUR, START_MS + 3 * HOUR), (1, START_MS + 3 * HOUR, START_MS + 4 * HOUR)], "calendar_id long, start_ms long, end_ms long")


_calendar = lambda: F.when(F.col("device_id") % 3 < 2, F.col("device_id") % 3)
_links = lambda s: s.createDataFrame([(u, g) for u in range(3) for g in range(1, 7) if (u + g) % 2], "user_id long, geofence_id long")
_drivers = lambda s: s.createDataFrame([(f"D{i}", f"Driver {i}") for i in range(5)], "driver_unique_id string, driver_name string")
_keys = ["alarm", "fuel", "ignition", "driver_unique_id", "motion"]

by("filter_calendar", f"SELECT id FROM p WHERE device_id % 3 = 2 OR (device_id % 3 = 0 AND fix_ms >= {START_MS + HOUR} AND fix_ms < {START_MS + 3 * HOUR}) OR (device_id % 3 = 1 AND fix_ms >= {START_MS + 3 * HOUR} AND fix_ms < {START_MS + 4 * HOUR})",
   lambda s, d: relations.in_calendar(pos(s, d).withColumn("calendar_id", _calendar()), _open_hours(s)).select("id"))
by("filter_skip_attributes", "SELECT id FROM p WHERE NOT (speed = 0 AND alarm IS NULL)", lambda s, d: pipeline.kept(pos(s, d), pipeline.filters(NOW)["static"], skip=F.col("alarm").isNotNull()).select("id"))
by("event_visibility", "SELECT device_id % 3 AS user_id, device_id, position_id, event_ms, type, geofence_id FROM ge WHERE (device_id % 3 + geofence_id) % 2 = 1", lambda s, d: relations.visible_events(geo_events(s, d).withColumn("user_id", F.col("device_id") % 3), _links(s)).select("user_id", "device_id", "position_id", "event_ms", "type", "geofence_id"), TAGS, SETS, GEO_EVENTS)
by("event_with_position", "SELECT ge.position_id, ge.type, ge.geofence_id, p.latitude, p.longitude FROM ge LEFT JOIN p ON p.id = ge.position_id", lambda s, d: geo_events(s, d).join(pos(s, d).select(F.col("id").alias("position_id"), "latitude", "longitude"), "position_id", "left").select("position_id", "type", "geofence_id", "latitude", "longitude"), TAGS, SETS, GEO_EVENTS)
by("driver_name", "SELECT id, CASE WHEN CAST(substr(driver_unique_id, 2) AS INT) < 5 THEN 'Driver ' || substr(driver_unique_id, 2) END AS driver_name FROM p", lambda s, d: relations.named_drivers(pos(s, d), _drivers(s)).select("id", "driver_name"))
by("latest_on_arrival", "SELECT id, coalesce(fix_ms >= max(fix_ms) OVER (PARTITION BY device_id ORDER BY server_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_latest FROM p", lambda s, d: relations.latest_on_arrival(pos(s, d)).select("id", "is_latest"))
by("trailing_history", "SELECT id, least(1 + count(*) OVER (PARTITION BY device_id ORDER BY fix_ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW), count(*) OVER (PARTITION BY device_id ORDER BY fix_ms RANGE UNBOUNDED PRECEDING)) AS held FROM p", lambda s, d: relations.trailing(pos(s, d), 600_000).select("id", "held"))
by("messages_per_day", "SELECT device_id, server_ms // 86400000 AS day, count(*) AS messages FROM p GROUP BY ALL", lambda s, d: relations.messages_per_day(pos(s, d)))
by("attribute_keys", " UNION ALL ".join(f"SELECT '{k}' AS key, count({k}) AS rows FROM p HAVING count({k}) > 0" for k in _keys), lambda s, d: relations.attribute_keys(pos(s, d), _keys))
by("devices_by_group", "SELECT group_id, count(*) AS devices, min(id) AS first_id, max(id) AS last_id FROM dev GROUP BY 1", lambda s, d: relations.devices_by_group(adapter.devices(s, d)))
by("alarm_difference", f"SELECT id, array_to_string(list_filter(coalesce(string_split(alarm, ','), []), lambda x: NOT list_contains(coalesce(string_split(b, ','), []), x)), ',') AS new_alarms FROM (SELECT *, lag(alarm) OVER {W} AS b FROM p)", lambda s, d: relations.step_on(pos(s, d)).select("id", "new_alarms"))
