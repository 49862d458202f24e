"""Queries of lookups, the mobile channel and the field codecs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec
from ..functions.geo import points
from ..operators import channel, hierarchy, lookups, pipeline, reports, request
from ..operators import events as ev
from ..sources import adapter
from ..sources.adapter import GEOFENCES, HOUR, SQL_DISTANCE, START_MS, sql_haversine
from .catalog import ANCESTORS, HIGH, HOURS_SQL, LOW, NOW, STALE, TAGS, W, access, by, far, full, perms, pos, query
from .motion import kept

# Lookups
by("device_lookup", "SELECT p.id, dev.id AS device FROM p LEFT JOIN dev ON dev.name = 'Customer#' || lpad(CAST(p.device_id AS VARCHAR), 9, '0')",
   lambda s, d: lookups.identified(pos(s, d).select("id", F.concat(F.lit("Customer#"), F.lpad(F.col("device_id").cast("string"), 9, "0")).alias("unique_id")), adapter.devices(s, d).withColumnRenamed("name", "unique_id")).select("id", F.col("device_id").alias("device")))
by("permission_wildcard", "SELECT user_id, device_id FROM ud WHERE user_id = 5", lambda s, d: lookups.permissions(adapter.user_device(s, d), "user_id", 5, "device_id", 0))
by("generic_list", "SELECT id, name, balance FROM dev JOIN (SELECT DISTINCT device_id FROM perm WHERE user_id = 1) x ON x.device_id = dev.id WHERE lower(name) LIKE '%1%' OR lower(category) LIKE '%1%' ORDER BY balance, id LIMIT 15 OFFSET 5",
   lambda s, d: lookups.listing(adapter.devices(s, d), perms(s, d), 1, "1", ["name", "category"], request.Order("balance", False, 15, 5, tie="id")).select("id", "name", "balance"), ANCESTORS)
by("update_by_condition", "SELECT id, CASE WHEN speed = 0 THEN 1.5 ELSE course END AS course, CASE WHEN speed = 0 THEN true ELSE ignition END AS ignition FROM p",
   lambda s, d: lookups.updated(pos(s, d), F.col("speed") == 0, {"course": F.lit(1.5), "ignition": F.lit(True)}).select("id", "course", "ignition"))
by("delete_by_condition", "SELECT id FROM p WHERE NOT coalesce(alarm = 'sos', false)", lambda s, d: lookups.deleted(pos(s, d), F.col("alarm") == "sos").select("id"))
by("top_recent", "SELECT id, server_ms FROM p ORDER BY server_ms DESC, id LIMIT 40", lambda s, d: request.query(pos(s, d), request.include("id", "server_ms"), order=request.Order("server_ms", True, 40, tie="id")))
by("statistics_listing", f"SELECT id, server_ms FROM p WHERE server_ms BETWEEN {LOW} AND {HIGH} ORDER BY server_ms, id", lambda s, d: request.query(pos(s, d), request.include("id", "server_ms"), request.between("server_ms", LOW, HIGH), request.Order("server_ms", tie="id")))


@query("geolocation", "SELECT id, CASE WHEN hit THEN 40 + n * 0.01 ELSE latitude END AS latitude, CASE WHEN hit THEN -3 - n * 0.01 ELSE longitude END AS longitude, CASE WHEN hit THEN 0 ELSE speed END AS speed, hit AS approximate FROM (SELECT *, id % 20 AS n, id % 3 = 0 AND id % 20 < 15 AS hit FROM p)")
def _(s, d):
    cells = s.range(15).select(F.col("id").alias("network"), (40 + F.col("id") * F.lit(0.01)).alias("cell_latitude"), (-3 - F.col("id") * F.lit(0.01)).alias("cell_longitude"))
    rows = pos(s, d).withColumns({"network": F.col("id") % 20, "outdated": F.col("id") % 3 == 0})
    return lookups.located(rows, cells).select("id", "latitude", "longitude", "speed", "approximate")


@query("speed_limit_lookup", "SELECT id, CASE WHEN (cy + cx) % 3 <> 0 THEN CAST(30 + (cy - cx) % 5 * 10 AS DOUBLE) END AS speed_limit FROM (SELECT id, CAST(floor(latitude / 0.01) AS BIGINT) AS cy, CAST(floor(longitude / 0.01) AS BIGINT) AS cx FROM p)")
def _(s, d):
    rows = pos(s, d)
    cells = rows.select(F.floor(F.col("latitude") / 0.01).cast("long").alias("cy"), F.floor(F.col("longitude") / 0.01).cast("long").alias("cx")).distinct()
    roads = cells.where("(cy + cx) % 3 <> 0").select("cy", "cx", (30 + (F.col("cy") - F.col("cx")) % 5 * 10).cast("double").alias("limit"))
    return lookups.road_limits(rows, roads).select("id", "speed_limit")


_near = sql_haversine("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")
by("address_reuse", f"SELECT id, last_value(own IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY fix_ms, id ROWS UNBOUNDED PRECEDING) AS address_of FROM (SELECT *, CASE WHEN NOT coalesce({_near} <= 300, false) THEN id END AS own FROM p WINDOW w AS (PARTITION BY device_id ORDER BY fix_ms, id))", lambda s, d: lookups.address_source(pos(s, d), 300).select("id", "address_of"))


def _limited(s, d, lowest):
    limits = s.createDataFrame([(g, float(20 + 15 * g) if g != 4 else 0.0) for g, _, _ in GEOFENCES], "geofence_id long, limit double")
    fences = lookups.fence_limits(pipeline.tagged(pos(s, d), adapter.geofences(s)).select("id", "geofence_id"), limits, lowest)
    device = F.when(F.col("device_id") % 2 == 0, 50.0).otherwise(0.0)
    return pos(s, d).join(fences, "id", "left").withColumn("limit", lookups.limit_of(F.col("fence_limit"), F.when(F.col("id") % 5 == 0, 35.0), device))


_fence = "fl AS (SELECT id, max(CASE geofence_id WHEN 4 THEN 0 ELSE 20 + 15 * geofence_id END) AS f FROM t GROUP BY 1), lim AS (SELECT p.*, CAST(CASE WHEN f > 0 THEN f WHEN p.id % 5 = 0 THEN 35 WHEN device_id % 2 = 0 THEN 50 ELSE 0 END AS DOUBLE) AS lim FROM p LEFT JOIN fl USING (id))"
by("overspeed_limits", "SELECT id, lim AS speed_limit FROM lim", lambda s, d: _limited(s, d, False).select("id", F.col("limit").alias("speed_limit")), TAGS, _fence)
by("ev_overspeed_limits", """SELECT device_id, id AS position_id, fix_ms AS event_ms, speed, lim AS speed_limit FROM (SELECT *, fix_ms - min(fix_ms) OVER (PARTITION BY device_id, run) AS since FROM
  (SELECT *, sum(CASE WHEN lim > 0 AND speed > lim THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY fix_ms, id) AS run FROM lim) WHERE lim > 0 AND speed > lim) WHERE since >= 60000 QUALIFY row_number() OVER (PARTITION BY device_id, run ORDER BY fix_ms, id) = 1""",
   lambda s, d: ev.overspeed(_limited(s, d, False), F.col("limit"), 60), TAGS, _fence)
by("overspeed_limits_lowest", "SELECT id, CAST(list_reduce(list_prepend(0e0, list(CASE geofence_id WHEN 4 THEN 0e0 ELSE 20e0 + 15 * geofence_id END ORDER BY geofence_id)), lambda a, x: CASE WHEN (x > 0 AND a = 0) OR x < a THEN x ELSE a END) AS DOUBLE) AS fence_limit FROM t GROUP BY 1",
   lambda s, d: _limited(s, d, True).where("fence_limit is not null").select("id", "fence_limit"), TAGS)


@query("device_objects_geofence", "SELECT id AS device_id, id % 6 + 1 AS geofence_id FROM dev WHERE id % 10 = 0 UNION SELECT dev.id, anc.ancestor_id % 6 + 1 FROM dev JOIN anc ON anc.group_id = dev.group_id WHERE anc.ancestor_id % 4 = 0", ANCESTORS)
def _(s, d):
    dev, grp = adapter.devices(s, d), adapter.groups(s, d)
    direct = dev.where("id % 10 = 0").select(F.col("id").alias("device_id"), (F.col("id") % 6 + 1).alias("geofence_id"))
    return lookups.device_objects(direct, grp.where("id % 4 = 0").select(F.col("id").alias("group_id"), (F.col("id") % 6 + 1).alias("geofence_id")), grp, dev, "geofence_id")


_notes = lambda s: (s.createDataFrame([(1,), (3,)], "notification_id int"), s.createDataFrame([(u, n) for u in range(8) for n in range(1, 5) if (u + n) % 2], "user_id long, notification_id int"))
_linked = lambda s, d: adapter.devices(s, d).select(F.col("id").alias("device_id"), (F.col("id") % 4 + 1).cast("int").alias("notification_id"))
_un = "un AS (SELECT u.range AS user_id, n.range AS notification_id FROM range(8) u, range(1, 5) n WHERE (u.range + n.range) % 2 = 1), dn AS (SELECT id AS device_id, id % 4 + 1 AS notification_id FROM dev UNION SELECT perm.device_id, un.notification_id FROM perm JOIN un USING (user_id) WHERE un.notification_id IN (1, 3))"
_dn = lambda s, d, a: lookups.device_notifications(_linked(s, d), *_notes(s), a)
by("device_notifications", "SELECT device_id, notification_id FROM dn", lambda s, d: _dn(s, d, access(s, d)), ANCESTORS, _un)


@query("notification_routing_rules", f"""SELECT perm.user_id, n.nid AS notification_id, e.position_id, unnest(string_split(n.via, ',')) AS notificator
FROM (SELECT device_id, id AS position_id, fix_ms, alarm AS alarm_type, id % 4 AS geofence_id FROM p WHERE alarm IS NOT NULL AND {NOW} - fix_ms <= 21000000) e JOIN dn ON dn.device_id = e.device_id
JOIN (VALUES (1, 'sos,tow', NULL, 'web,mail'), (2, 'sos', '1,3', 'sms'), (3, NULL, NULL, 'web')) n(nid, al, fences, via) ON n.nid = dn.notification_id AND list_contains(string_split(n.al, ','), e.alarm_type)
  AND (n.fences IS NULL OR list_contains(string_split(n.fences, ','), CAST(e.geofence_id AS VARCHAR))) AND (n.nid <> 1 OR (e.fix_ms >= {LOW - HOUR} AND e.fix_ms < {HIGH - 4 * HOUR})) JOIN perm ON perm.device_id = e.device_id WHERE perm.user_id <> 2""", ANCESTORS, _un)  # fmt: skip
def _(s, d):
    rules = s.createDataFrame([(1, "alarm", "sos,tow", None, LOW - HOUR, HIGH - 4 * HOUR, "web,mail"), (2, "alarm", "sos", "1,3", None, None, "sms"), (3, "alarm", None, None, None, None, "web")],
                              "notification_id int, type string, alarms string, geofence_ids string, low_ms long, high_ms long, notificators string")
    e = pos(s, d).where("alarm is not null").select("device_id", F.col("id").alias("position_id"), F.col("fix_ms").alias("event_ms"), F.lit("alarm").alias("type"), F.col("alarm").alias("alarm_type"), (F.col("id") % 4).alias("geofence_id"))
    users = access(s, d)
    return lookups.routed(e, rules, _dn(s, d, users), users, NOW, 21_000, [2])


_deep = lambda s, d: adapter.devices(s, d).select("id", F.when(F.col("id") >= 3, F.expr("id div 3")).alias("group_id"))
DEEP = """gr AS (SELECT id, CASE WHEN id >= 3 THEN id // 3 END AS up FROM dev)""", "cl AS (SELECT id AS group_id, id AS ancestor_id, 0 AS distance FROM gr UNION ALL SELECT cl.group_id, gr.up, cl.distance + 1 FROM cl JOIN gr ON gr.id = cl.ancestor_id WHERE gr.up IS NOT NULL)"
by("group_closure", "SELECT * FROM cl", lambda s, d: hierarchy.closure(_deep(s, d)), *DEEP)
by(
    "inherited_attribute",
    "SELECT gr.id, coalesce(CASE WHEN gr.id % 17 = 0 THEN gr.id * 1.0 END, n.v, 4.5) AS value FROM gr LEFT JOIN (SELECT group_id, min_by(ancestor_id * 2.0, distance) AS v FROM cl WHERE ancestor_id % 5 = 1 GROUP BY 1) n ON n.group_id = gr.up",
    lambda s, d: hierarchy.looked_up(_deep(s, d), _deep(s, d), _deep(s, d).where("id % 17 = 0").select("id", F.col("id").cast("double").alias("value")), _deep(s, d).where("id % 5 = 1").select(F.col("id").alias("group_id"), (F.col("id") * 2.0).alias("value")), 7.0, server=4.5),
    *DEEP,
)


# Mobile channel
@query(
    "presence_dimensions",
    f"""SELECT device_id, CASE WHEN NOT ignition THEN 'NO_FIX' WHEN {NOW} - fix_ms > 600000 THEN 'STALE' ELSE 'OK' END AS gps,
  CASE id % 4 WHEN 3 THEN 'none' ELSE CASE WHEN id % 5 = 0 THEN 'unvalidated' WHEN id % 4 = 0 THEN 'wifi' ELSE 'mobile' END END AS net, s.mqtt,
  CASE WHEN id % 7 - 1 <= 0 THEN 'EMPTY' WHEN id % 7 - 1 < id % 5 THEN 'DRAINING' ELSE 'PENDING' END AS outbox
FROM l JOIN (SELECT device_id, CASE WHEN st = 'CONNECTED' AND {NOW} - seen > 180000 THEN 'DISCONNECTED' ELSE st END AS mqtt FROM mq QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY rn DESC) = 1) s USING (device_id)""",
    STALE,
    "ar AS (SELECT device_id, server_ms, id % 3 <> 0 AS mqtt, row_number() OVER (PARTITION BY device_id ORDER BY server_ms, id) AS rn FROM p)",
    """mq AS (SELECT DISTINCT device_id, 0::BIGINT AS rn, 0::BIGINT AS seen, 'UNKNOWN' AS st FROM p UNION ALL
  SELECT device_id, rn, server_ms, CASE WHEN NOT mqtt THEN st WHEN st = 'DISCONNECTED' THEN 'CONNECTING' ELSE 'CONNECTED' END FROM (
    SELECT ar.device_id, ar.rn, ar.server_ms, ar.mqtt, CASE WHEN mq.st = 'CONNECTED' AND ar.server_ms - mq.seen > 180000 THEN 'DISCONNECTED' ELSE mq.st END AS st
    FROM mq JOIN ar ON ar.device_id = mq.device_id AND ar.rn = mq.rn + 1))""",
)
def _(s, d):
    known = {"gps_ok": F.col("ignition"), "validated": F.col("id") % 5 != 0, "pending": F.col("id") % 7 - 1, "pending_before": F.col("id") % 5}
    rows = request.latest(pos(s, d)).withColumns(known | {"network": F.when(F.col("id") % 4 == 0, "wifi").when(F.col("id") % 4 < 3, "mobile")})
    return channel.dimensions(rows, channel.mqtt_states(pos(s, d).withColumn("mqtt", F.col("id") % 3 != 0), NOW), NOW)


by("presence_stats", f"SELECT state, count(*) AS devices, count(*) FILTER (age > 900000) AS overdue FROM (SELECT {NOW} - fix_ms AS age, CASE WHEN {NOW} - fix_ms > 600000 THEN 'OFFLINE' WHEN {NOW} - fix_ms > 300000 THEN 'SUSPECT' ELSE 'ONLINE' END AS state FROM l) GROUP BY 1",
   lambda s, d: channel.presence_stats(ev.presence(request.latest(pos(s, d)), NOW).join(request.latest(pos(s, d)).select("device_id", "fix_ms"), "device_id"), F.lit(NOW) - F.col("fix_ms") > 900_000), STALE)
by("outcome_counters", "SELECT coalesce(alarm, 'none') AS outcome, count(*) AS n FROM p GROUP BY 1", lambda s, d: channel.counted(pos(s, d), "alarm"))
by("ev_device_status", f"""SELECT device_id, 'deviceOnline' AS type, server_ms AS event_ms FROM x WHERE b IS NULL OR server_ms - b > 600000 UNION ALL SELECT device_id, 'deviceUnknown', server_ms + 600000 FROM x WHERE coalesce(n, {NOW}) - server_ms > 600000""",
   lambda s, d: channel.status_changes(pos(s, d), NOW), "x AS (SELECT *, lag(server_ms) OVER w AS b, lead(server_ms) OVER w AS n FROM (SELECT DISTINCT device_id, server_ms FROM p) WINDOW w AS (PARTITION BY device_id ORDER BY server_ms))")
by("status_update", f"SELECT device_id, id AS position_id, s AS status FROM (SELECT *, lag(s) OVER {W} AS b FROM (SELECT *, CASE WHEN ignition THEN 'online' ELSE 'offline' END AS s FROM p)) WHERE b IS NULL OR s <> b", lambda s, d: channel.status_updates(pos(s, d), F.when(F.col("ignition"), "online").otherwise("offline")))
by(
    "ev_mobile_stalled",
    "SELECT device_id, id AS position_id, ms AS event_ms FROM sw WHERE ok",
    lambda s, d: channel.stalled(pos(s, d), 30, 60),
    f"""st AS (SELECT *, fix_ms - last_value(own IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY fix_ms, id ROWS UNBOUNDED PRECEDING) >= CASE WHEN motion THEN 30000 ELSE 60000 END AS due
  FROM (SELECT *, CASE WHEN lag(latitude) OVER {W} = latitude AND lag(longitude) OVER {W} = longitude THEN NULL ELSE fix_ms END AS own FROM p))""",
    f"so AS (SELECT *, row_number() OVER {W} AS rn FROM st)",
    """sw AS (SELECT DISTINCT device_id, 0::BIGINT AS rn, 0::BIGINT AS id, NULL::BIGINT AS ms, false AS ok FROM p UNION ALL
  SELECT so.device_id, so.rn, so.id, CASE WHEN NOT due THEN NULL WHEN sw.ms IS NULL OR so.fix_ms - sw.ms >= 360000 THEN so.fix_ms ELSE sw.ms END, due AND (sw.ms IS NULL OR so.fix_ms - sw.ms >= 360000)
  FROM sw JOIN so ON so.device_id = sw.device_id AND so.rn = sw.rn + 1)""",
)


@query(
    "ev_mobile_telemetry",
    """SELECT device_id, id AS position_id, k.type AS type, CASE WHEN k.net THEN CASE WHEN id % 6 = 1 THEN 'airplane' ELSE 'inferred' END END AS cause,
  CASE WHEN k.net THEN CASE WHEN id % 8 = 1 THEN 'confirmed' ELSE 'inferred' END END AS confidence FROM (SELECT device_id, id, unnest(list_filter([
  CASE WHEN bg AND NOT g THEN {type: 'gpsOff', net: false} WHEN NOT bg AND g THEN {type: 'gpsOn', net: false} END,
  CASE WHEN bn = n OR bn IS NULL THEN NULL WHEN n = 'none' THEN {type: 'networkLost', net: true} WHEN bn = 'wifi' THEN {type: 'wifiLost', net: true} WHEN bn = 'none' THEN {type: 'networkRestored', net: true} END,
  CASE WHEN bb > 10 AND b <= 10 AND b >= 0 THEN {type: 'batteryLow', net: false} END,
  CASE WHEN id % 150 = 0 THEN {type: 'journeyStart', net: false} END, CASE WHEN id % 150 = 75 THEN {type: 'journeyEnd', net: false} END], lambda x: x IS NOT NULL)) AS k
  FROM (SELECT *, lag(g) OVER w AS bg, lag(n) OVER w AS bn, lag(b) OVER w AS bb FROM (SELECT device_id, id, fix_ms, last_value(gps IGNORE NULLS) OVER u AS g, last_value(net IGNORE NULLS) OVER u AS n, last_value(bat IGNORE NULLS) OVER u AS b
    FROM (SELECT *, CASE WHEN id % 10 > 0 THEN ignition END AS gps, CASE WHEN id % 9 > 2 THEN CASE id % 4 WHEN 0 THEN 'wifi' WHEN 3 THEN 'none' ELSE 'mobile' END END AS net, CASE WHEN id % 7 > 0 THEN fuel - 5 END AS bat FROM p)
    WINDOW u AS (PARTITION BY device_id ORDER BY fix_ms, id ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY device_id ORDER BY fix_ms, id)))""",
)
def _(s, d):
    i, net = F.col("id"), F.when(F.col("id") % 4 == 0, "wifi").when(F.col("id") % 4 == 3, "none").otherwise("mobile")
    told = {"gps_on": F.when(i % 10 > 0, F.col("ignition")), "network": F.when(i % 9 > 2, net), "battery": F.when(i % 7 > 0, F.col("fuel") - 5)}
    more = {"journey_started": i % 150 == 0, "journey_ended": i % 150 == 75, "net_cause": F.when(i % 6 == 1, "airplane").when(i % 6 == 2, " "), "net_conf": F.when(i % 8 == 1, "confirmed").otherwise("sure")}
    return channel.telemetry_changes(pos(s, d).withColumns(told | more))


by("ev_mobile_diagnostics", "SELECT device_id, id, array_to_string(list_filter([CASE WHEN id % 9 = 0 THEN 'crashes' END, CASE WHEN id % 5 = 0 THEN 'stuckStops' END, CASE WHEN id % 7 = 0 THEN 'mqttDown' END], lambda x: x IS NOT NULL), ',') AS problems FROM p WHERE (id % 9 = 0 OR id % 5 = 0 OR id % 7 = 0) AND id % 11 <> 0",
   lambda s, d: channel.diagnostics(pos(s, d).withColumn("body", F.when(F.col("id") % 11 == 0, "no json").otherwise(F.format_string('{"crashes": %d, "stuckStops": %d, "clockSteps": 0, "mqtt": %s}', (F.col("id") % 9 == 0).cast("int"), (F.col("id") % 5 == 0).cast("int"), F.when(F.col("id") % 7 == 0, "false").otherwise("true"))))))
by(
    "recovery_eligibility",
    "SELECT id, decision FROM el WHERE rn > 0",
    lambda s, d: channel.eligibility(pos(s, d).select("id", "device_id", F.col("fix_ms").alias("ts"), (F.col("id") % 13 != 0).alias("enabled"), F.when(F.col("id") % 11 != 0, "t").alias("token"), (F.col("id") % 7 == 0).alias("active")), 200, 5).select("id", "decision"),
    f"eo AS (SELECT *, row_number() OVER {W} AS rn FROM p)",
    """el AS (SELECT DISTINCT device_id, 0::BIGINT AS rn, 0::BIGINT AS id, CAST([] AS BIGINT[]) AS sent, '' AS decision FROM p UNION ALL
  SELECT device_id, rn, id, CASE WHEN decision = 'allow' THEN list_append(sent, fix_ms) ELSE sent END, decision FROM (
    SELECT eo.device_id, eo.rn, eo.id, eo.fix_ms, el.sent, CASE WHEN eo.id % 13 = 0 THEN 'disabled' WHEN eo.id % 11 = 0 THEN 'no_token' WHEN eo.id % 7 = 0 THEN 'active'
      WHEN eo.fix_ms - el.sent[-1] < 200000 THEN 'cooldown' WHEN len(list_filter(el.sent, lambda x: x >= eo.fix_ms - 3600000)) >= 5 THEN 'hourly_limit' ELSE 'allow' END AS decision
    FROM el JOIN eo ON eo.device_id = el.device_id AND eo.rn = el.rn + 1))""",
)
_stages = "['RECEIVED', 'STARTED', 'FGS_ACTIVE', 'TRACKING_ACTIVE', 'GPS_CONFIRMED']"
by("recovery_stages", "SELECT id // 12 AS attempt, CAST(list_reduce(list_prepend(0, list(id * 7 % 5 ORDER BY fix_ms, id)), lambda a, x: CASE WHEN x = a THEN a + 1 ELSE a END) AS INT) AS stages FROM p GROUP BY 1",
   lambda s, d: channel.stage_reached(pos(s, d).select(F.floor(F.col("id") / 12).cast("long").alias("attempt"), F.col("fix_ms").alias("ts"), F.element_at(F.expr("array" + _stages.replace("[", "(").replace("]", ")")), (F.col("id") * 7 % 5 + 1).cast("int")).alias("stage"))))
by("recovery_soft_success", "SELECT a.id, n.fix_ms - a.ts AS latency_ms, coalesce(n.fix_ms - a.ts <= 300000, false) AS soft_success FROM (SELECT id, device_id, server_ms AS ts FROM p WHERE id % 3 = 0) a ASOF LEFT JOIN p n ON n.device_id = a.device_id AND n.fix_ms >= a.ts",
   lambda s, d: channel.soft_success(pos(s, d).where("id % 3 = 0").select("id", "device_id", F.col("server_ms").alias("ts")), pos(s, d)).select("id", "latency_ms", "soft_success"))
_journey = lambda s, d: pos(s, d).where("alarm is not null").select("device_id", F.col("fix_ms").alias("ts"), F.floor(F.col("id") / 40).cast("long").alias("journey_id"), (F.col("alarm") == "sos").alias("opens"))
_je = "je AS (SELECT device_id, fix_ms AS ts, id // 40 AS journey_id, alarm = 'sos' AS opens FROM p WHERE alarm IS NOT NULL), ja AS (SELECT device_id, journey_id FROM (SELECT * FROM je QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY ts DESC, journey_id DESC) = 1) WHERE opens)"
by("active_journeys", "SELECT device_id, journey_id FROM ja", lambda s, d: channel.active_journeys(_journey(s, d)), _je)
by("last_will", "SELECT dev.id AS device_id, CASE WHEN ja.device_id IS NULL THEN 'OFFLINE' ELSE 'SUSPECT' END AS state FROM dev LEFT JOIN ja ON ja.device_id = dev.id", lambda s, d: channel.last_will(adapter.devices(s, d).select(F.col("id").alias("device_id")), channel.active_journeys(_journey(s, d))), _je)
by("anti_resurrection", "SELECT device_id, ts, journey_id, opens FROM (SELECT *, max(CASE WHEN NOT opens THEN journey_id END) OVER (PARTITION BY device_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM je) WHERE NOT opens OR e IS NULL OR journey_id > e", lambda s, d: channel.not_reopened(_journey(s, d)), _je)
by("health_funnel", "SELECT category, count(*) AS devices, count(x) AS with_health, count(*) FILTER (x) AS with_alarm, count(*) FILTER (y) AS with_fuel FROM dev LEFT JOIN (SELECT device_id, bool_or(alarm IS NOT NULL) AS x, bool_or(fuel IS NOT NULL) AS y FROM p GROUP BY 1) h ON h.device_id = dev.id GROUP BY 1",
   lambda s, d: channel.health_funnel(adapter.devices(s, d), pos(s, d), ["alarm", "fuel"]))
by("rep_timeline_pairs", """SELECT a.device_id, a.ts, b.ts AS end_ts FROM (SELECT device_id, ts, i + max(e + 1 - i) OVER (PARTITION BY device_id ORDER BY i) AS k FROM n WHERE loss = 1) a LEFT JOIN n b ON b.device_id = a.device_id AND b.loss = 0 AND b.e = a.k""",
   lambda s, d: channel.paired_once(pos(s, d).where("alarm = 'fault,lowBattery'").select("device_id", F.col("fix_ms").alias("ts")), pos(s, d).where("alarm = 'sos'").select("device_id", F.col("fix_ms").alias("ts"))),
   "n AS (SELECT device_id, ts, loss, sum(loss) OVER w AS i, sum(1 - loss) OVER w AS e FROM (SELECT device_id, fix_ms AS ts, CASE WHEN alarm = 'sos' THEN 0 ELSE 1 END AS loss FROM p WHERE alarm IS NOT NULL) WINDOW w AS (PARTITION BY device_id ORDER BY ts, loss DESC ROWS UNBOUNDED PRECEDING))")
by("rep_continuity_journeys", "SELECT device_id, j AS journey_id, count(*) AS fixes, min(fix_ms) AS first_ms, max(fix_ms) AS last_ms, CAST(coalesce(sum(least(dt, 300000)), 0) AS BIGINT) AS tracking_ms, coalesce(max(dt), 0) AS longest_gap_ms FROM (SELECT *, fix_ms - lag(fix_ms) OVER (PARTITION BY device_id, j ORDER BY fix_ms) AS dt FROM (SELECT DISTINCT device_id, id // 200 AS j, fix_ms FROM p WHERE id % 400 < 300)) GROUP BY 1, 2",
   lambda s, d: channel.continuity_by(pos(s, d).withColumn("journey_id", F.when(F.col("id") % 400 < 300, F.floor(F.col("id") / 200).cast("long"))), "journey_id"))


@query("rep_timeline", f"""SELECT * FROM (SELECT device_id, 'alarm' AS type, fix_ms AS ts, CAST(NULL AS BIGINT) AS end_ms, 'warning' AS severity, 'CONFIRMED' AS confidence FROM p WHERE alarm IS NOT NULL AND fix_ms BETWEEN {LOW} AND {HIGH} UNION ALL
  SELECT device_id, 'captureGap', start_ms, end_ms, 'warning', CASE WHEN clipped THEN 'PARTIAL' ELSE 'CONFIRMED' END FROM (SELECT device_id, fix_ms AS end_ms, coalesce(lag(fix_ms) OVER w, {LOW}) AS start_ms, lag(fix_ms) OVER w IS NULL OR z AS clipped
    FROM (SELECT device_id, fix_ms, false AS z FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH} UNION ALL SELECT DISTINCT device_id, {HIGH}, true FROM p WHERE fix_ms BETWEEN {LOW} AND {HIGH}) WINDOW w AS (PARTITION BY device_id ORDER BY fix_ms, z)) WHERE end_ms - start_ms > 300000) ORDER BY ts, type""")  # fmt: skip
def _(s, d):
    rows = request.in_range(pos(s, d), LOW, HIGH)
    gaps = reports.capture_gaps(pos(s, d), LOW, HIGH).select("device_id", F.col("start_ms").alias("ts"), "end_ms", F.lit("warning").alias("severity"), F.when(F.col("clipped"), "PARTIAL").otherwise("CONFIRMED").alias("confidence"))
    alarms = rows.where("alarm is not null").select("device_id", F.col("fix_ms").alias("ts"), F.lit(None).alias("end_ms"), F.lit("warning").alias("severity"), F.lit("CONFIRMED").alias("confidence"))
    return channel.timeline({"alarm": alarms, "captureGap": gaps})


# Field codecs
_hx = "printf('%04x%02x', id % 65536, device_id % 256)"
_hex = lambda: F.lower(F.concat(F.lpad(F.hex(F.col("id") % 65536), 4, "0"), F.lpad(F.hex(F.col("device_id") % 256), 2, "0")))
by("codec_text", "SELECT id, lower(hex(driver_unique_id || 'é')) AS hexed, driver_unique_id || 'é' AS back, base64(encode(driver_unique_id)) AS b64, CASE WHEN id % 2 = 0 THEN CAST(id AS BIGINT) END AS digits, CASE WHEN (id & 128) <> 0 THEN -(id & 127) ELSE id & 127 END AS signed FROM p",
   lambda s, d: pos(s, d).withColumn("h", codec.hex_text(F.concat("driver_unique_id", F.lit("é")))).select("id", F.col("h").alias("hexed"), codec.text_hex(F.col("h")).alias("back"), F.base64(F.encode("driver_unique_id", "UTF-8")).alias("b64"), codec.bcd(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("1a")).alias("digits"), codec.signed_magnitude(F.col("id"), 8).alias("signed")))
_bytes = f"list_transform([1, 3, 5], lambda i: CAST('0x' || substr({_hx}, i, 2) AS INT))"
by("codec_checksums", f"""SELECT id, list_reduce(list_prepend(65535, b), lambda a, x: list_reduce(list_prepend(xor(a, x << 8), range(8)), lambda v, k: ((CASE WHEN v & 32768 <> 0 THEN xor(v << 1, 4129) ELSE v << 1 END) & 65535))) AS crc, list_reduce(list_prepend(0, b), lambda a, x: xor(a, x)) AS xored FROM (SELECT id, {_bytes} AS b FROM p)""",
   lambda s, d: pos(s, d).select("id", codec.crc16(_hex()).alias("crc"), codec.xor_sum(_hex()).alias("xored")))
by(
    "codec_obd",
    """SELECT id, CASE id % 50 WHEN 4 THEN 'engineLoad' WHEN 5 THEN 'coolantTemp' WHEN 11 THEN 'mapIntake' WHEN 12 THEN 'rpm' WHEN 13 THEN 'obdSpeed' WHEN 15 THEN 'intakeTemp' WHEN 17 THEN 'throttle' WHEN 33 THEN 'milDistance'
  WHEN 47 THEN 'fuel' WHEN 49 THEN 'clearedDistance' END AS name, CASE WHEN id % 50 IN (4, 17, 47) THEN v * 100 // 255 WHEN id % 50 IN (5, 15) THEN v - 40 WHEN id % 50 = 12 THEN v // 4 WHEN id % 50 IN (11, 13, 33, 49) THEN v END AS value,
  ['P', 'C', 'B', 'U'][CAST((id >> 14) & 3 AS INT) + 1] || ((id >> 12) & 3) || printf('%03X', id & 4095) AS dtc FROM (SELECT id, CAST(id * 7 % 1021 AS BIGINT) AS v FROM p)""",
    lambda s, d: pos(s, d).select("id", *[c.alias(n) for c, n in zip(codec.obd(F.col("id") % 50, F.col("id") * 7 % 1021), ("name", "value"))], codec.trouble_code(F.col("id")).alias("dtc")),
)
by("codec_dates", f"SELECT id, CAST(epoch_ms(make_timestamp(2024, CAST(id % 12 + 1 AS INT), CAST(id % 28 + 1 AS INT), CAST(id % 24 AS INT), CAST(id % 60 AS INT), 7)) AS BIGINT) AS built, (SELECT min_by(x, abs(x - {NOW})) FROM (SELECT unnest([t - 86400000, t, t + 86400000]) AS x)) AS near FROM (SELECT id, {NOW} - {NOW} % 86400000 + (fix_ms * 7) % 86400000 AS t FROM p)",
   lambda s, d: pos(s, d).select("id", codec.built_date(F.lit(24), *[(F.col("id") % n + k).cast("int") for n, k in ((12, 1), (28, 1), (24, 0), (60, 0))], F.lit(7)).alias("built"), codec.nearest_day(F.col("fix_ms") * 7, F.lit(NOW)).alias("near")))
_rad = lambda i, n: "+".join(f"radians({n[(k + 1) % len(n)][1]} - {n[k][1]}) * (2 + sin(radians({n[k][0]})) + sin(radians({n[(k + 1) % len(n)][0]})))" for k in range(len(n)))
_polygons = [(i, [tuple(map(float, x.split())) for x in a[a.rindex("(") + 1 : a.index(")")].split(",")]) for i, _, a in GEOFENCES if a.startswith("POLYGON")]
by("geofence_area", " UNION ALL ".join(f"SELECT {i} AS geofence_id, round(abs({_rad(i, n)}) * 6378137e0 * 6378137e0 / 2, 2) AS area FROM range(1)" for i, n in _polygons) + " UNION ALL SELECT g, round(pi() * r * r, 2) FROM (VALUES (1, 600e0), (2, 1500e0), (3, 900e0)) v(g, r)",
   lambda s, d: adapter.geofences(s).where("area not like 'LINE%'").select("geofence_id", F.round(F.when(F.col("area").startswith("POLYGON"), codec.ring_area(points(F.col("area")))).otherwise(codec.circle_area(F.regexp_extract("area", ", ([0-9.]+)", 1).cast("double"))), 2).alias("area")))
by("attribute_getters", "SELECT id, CASE id % 4 WHEN 0 THEN id * 1.5 WHEN 1 THEN 1 ELSE 0 END AS number, id % 4 = 1 AS flag FROM p",
   lambda s, d: pos(s, d).withColumn("a", F.when(F.col("id") % 4 == 0, (F.col("id") * 1.5).cast("string")).when(F.col("id") % 4 == 1, "True").when(F.col("id") % 4 == 2, "none")).select("id", codec.as_number(F.col("a")).alias("number"), codec.as_flag(F.col("a")).alias("flag")))
by("address_format", "SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE CAST(id % 90 AS VARCHAR) || ' ' END || 'Main St' || CASE WHEN id % 2 = 0 THEN '' ELSE ', Town' END || ', ES' AS address FROM p",
   lambda s, d: pos(s, d).select("id", codec.address({"h": F.when(F.col("id") % 3 != 0, (F.col("id") % 90).cast("string")), "r": F.lit("Main St"), "t": F.when(F.col("id") % 2 != 0, "Town"), "s": F.lit(None).cast("string"), "c": F.lit("ES")}).alias("address")))
by("json_clamp", "SELECT id, '{' || CASE WHEN id % 3 <> 0 THEN '\"outbox\":' || least(50, greatest(0, id % 90 - 20)) || ',' ELSE '' END || '\"battery\":' || least(100, id % 150) || '}' AS body FROM p",
   lambda s, d: pos(s, d).select("id", codec.clamped(F.concat(F.lit('{"x": 1, "battery": '), (F.col("id") % 150).cast("string"), F.when(F.col("id") % 3 != 0, F.concat(F.lit(', "outbox": '), (F.col("id") % 90 - 20).cast("string"))).otherwise(""), F.lit("}")), {"outbox": (0, 50), "battery": (0, 100)}).alias("body")))


@query("decode_frames", "SELECT id, CASE WHEN id % 10 <> 0 THEN 'D' || device_id END AS unique_id, CASE WHEN id % 10 <> 0 THEN fix_ms // 1000 * 1000 END AS fix_ms, CASE WHEN id % 10 <> 0 THEN round(40 + (id % 60) / 60, 6) END AS latitude, CASE WHEN id % 10 <> 0 THEN round(-3 - (id % 50) / 60, 6) END AS longitude, CASE WHEN id % 10 <> 0 THEN course END AS course FROM p")
def _(s, d):
    t = F.timestamp_millis("fix_ms")
    frame = F.concat(F.lit("$$D"), F.col("device_id").cast("string"), F.lit(","), F.date_format(t, "HHmmss"), F.lit(",A,40"), F.format_string("%07.4f", (F.col("id") % 60).cast("double")), F.lit(",N,003"), F.format_string("%07.4f", (F.col("id") % 50).cast("double")), F.lit(",W,1.5,"), F.col("course").cast("string"), F.lit(","), F.date_format(t, "ddMMyy"))
    rows = pos(s, d).select("id", F.when(F.col("id") % 10 == 0, F.concat(F.lit("bad"), frame)).otherwise(frame).alias("frame"))
    return codec.decoded(rows).select("id", "unique_id", "fix_ms", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "course")


@query("mobile_http_batch", "SELECT device_id, 'msg-' || id AS message_id, id AS sequence, fix_ms, latitude, longitude, round(speed * 0.539957, 9) AS speed FROM p")
def _(s, d):
    e = F.struct(F.concat(F.lit("msg-"), F.col("id").cast("string")).alias("messageId"), F.col("id").alias("sequence"), F.col("fix_ms").alias("observedAt"), "latitude", "longitude", F.col("speed").alias("speedKmh"))
    return codec.batch_rows(pos(s, d).groupBy("device_id", F.floor(F.col("id") / 100).alias("k")).agg(F.to_json(F.collect_list(e)).alias("body")).drop("k"))


by("event_forward", "SELECT CAST(device_id AS VARCHAR) AS key, '{\"type\":\"alarm\",\"alarm\":\"' || alarm || '\",\"positionId\":' || id || '}' AS value FROM p WHERE alarm IS NOT NULL",
   lambda s, d: pos(s, d).where("alarm is not null").select(F.col("device_id").cast("string").alias("key"), F.to_json(F.struct(F.lit("alarm").alias("type"), "alarm", F.col("id").alias("positionId"))).alias("value")))


@query("ev_proximity_hysteresis", f"""SELECT device_id, id AS position_id, fix_ms AS event_ms, CASE WHEN near THEN 'proximityEnter' ELSE 'proximityExit' END AS type, linked_id FROM
  (SELECT *, lag(near) OVER w AS old FROM (SELECT *, coalesce(last_value(side IGNORE NULLS) OVER (PARTITION BY device_id, linked_id ORDER BY fix_ms, id ROWS UNBOUNDED PRECEDING), false) AS near FROM (SELECT *, CASE WHEN far <= 1500000 THEN true WHEN far > 4000000 THEN false END AS side FROM
    (SELECT a.device_id, a.id, a.fix_ms, a.device_id + 1 AS linked_id, round({sql_haversine("a.latitude", "a.longitude", "b.latitude", "b.longitude")} * 1000) AS far FROM p a ASOF JOIN p b ON b.device_id = a.device_id + 1 AND a.fix_ms >= b.fix_ms))) WINDOW w AS (PARTITION BY device_id, linked_id ORDER BY fix_ms, id)) WHERE (near AND NOT coalesce(old, false)) OR (NOT near AND old)""")  # fmt: skip
def _(s, d):
    p = pos(s, d)
    return ev.proximity(p, p.select("device_id", (F.col("device_id") + 1).alias("linked_id")).distinct(), 1500, 4000)


@query("ev_unaccompanied_motion", f"""SELECT device_id, id AS position_id, fix_ms AS event_ms, 'unaccompaniedMotion' AS type FROM (
  SELECT s.device_id, s.id, s.fix_ms, coalesce(round({sql_haversine("s.latitude", "s.longitude", "o.latitude", "o.longitude")} * 1000) <= 1500000, false) AS near FROM (
    SELECT b.*, b.device_id + k.n AS linked_id FROM (SELECT * FROM p QUALIFY motion AND NOT lag(motion) OVER {W}) b, (VALUES (1), (2)) k(n)) s
  ASOF LEFT JOIN p o ON o.device_id = s.linked_id AND s.fix_ms >= o.fix_ms) GROUP BY 1, 2, 3 HAVING NOT bool_or(near)""")  # fmt: skip
def _(s, d):
    p = pos(s, d)
    linked = F.explode(F.array(F.col("device_id") + 1, F.col("device_id") + 2)).alias("linked_id")
    return ev.unaccompanied(p, p.select("device_id", linked).distinct(), 1500)


@query("rep_summary_odometer", """SELECT device_id, metres AS distance, CASE WHEN a.used IS NOT NULL AND z.used IS NOT NULL THEN z.used - a.used ELSE a.fuel - z.fuel END AS spent_fuel,
  round(CASE WHEN z.hours_ms > a.hours_ms THEN metres * 1000 / (z.hours_ms - a.hours_ms) * 1.94384 ELSE 0 END, 6) AS average_speed FROM (
  SELECT device_id, a, z, CASE WHEN coalesce(a.odo, 0) <> 0 AND coalesce(z.odo, 0) <> 0 THEN z.odo - a.odo ELSE (z.total_mm - a.total_mm) / 1000 END AS metres FROM (
    SELECT device_id, arg_min(r, fix_ms) AS a, arg_max(r, fix_ms) AS z FROM (
      SELECT device_id, fix_ms, {'odo': CASE device_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN id * 10.0 END, 'used': CASE WHEN device_id % 2 = 0 THEN id / 4 END, 'fuel': fuel, 'hours_ms': hours_ms, 'total_mm': total_mm} AS r FROM h) GROUP BY 1))""",
  SQL_DISTANCE, HOURS_SQL)
def _(s, d):
    odometer = F.when(F.col("device_id") % 3 == 0, 0.0).when(F.col("device_id") % 3 == 1, F.col("id") * 10.0)
    rows = full(s, d).withColumns({"odometer": odometer, "fuel_used": F.when(F.col("device_id") % 2 == 0, F.col("id") / 4)})
    return reports.summary(rows, ["device_id"]).select("device_id", "distance", "spent_fuel", "average_speed")
