"""Queries of motion, trips and stops, and of the filters that look at the last accepted position, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import folds, mobile, pipeline, reports
from ..sources import egress
from ..sources.adapter import DAY, HOUR, SQL_DISTANCE, START_MS, sql_haversine
from .catalog import HOURS_SQL, NOW, W, by, far, full, pos

# Old motion


def old_motion(moving: str) -> tuple[str, str, str]:
    """CTEs r (numbered positions), m (the fold's states) and me (its events). moving: what a device does before its first row."""
    drop = "g OR due OR (state <> motion AND streak = motion)"
    mark = lambda new, old: f"CASE WHEN {drop} THEN NULL WHEN state <> motion THEN {new} ELSE {old} END"
    first = lambda c: f"CASE WHEN motion AND NOT {moving} THEN {c} WHEN NOT motion AND {moving} THEN {c} END"
    gap = "m.streak AND r.fix_ms - r.pms >= 900000"
    return (
        f"r AS (SELECT *, row_number() OVER {W} AS rn, lag(id) OVER {W} AS pid, lag(fix_ms) OVER {W} AS pms FROM d)",
        f"""m AS (SELECT device_id, rn, {moving} AS streak, motion AS state, {first("id")} AS mid, {first("fix_ms")} AS mms, {first("total_mm")} AS mt,
    CAST(NULL AS VARCHAR) AS type, CAST(NULL AS BIGINT) AS position_id, CAST(NULL AS BIGINT) AS event_ms FROM r WHERE rn = 1 UNION ALL
  SELECT device_id, rn, CASE WHEN g THEN false WHEN due THEN motion ELSE streak END, CASE WHEN g THEN false ELSE motion END,
    {mark("id", "mid")}, {mark("fix_ms", "mms")}, {mark("total_mm", "mt")},
    CASE WHEN g THEN 'deviceStopped' WHEN due AND motion THEN 'deviceMoving' WHEN due THEN 'deviceStopped' END,
    CASE WHEN g THEN pid WHEN due THEN mid END, CASE WHEN g THEN pms WHEN due THEN mms END
  FROM (SELECT r.device_id, r.rn, r.id, r.fix_ms, r.total_mm, r.motion, r.pid, r.pms, m.streak, m.state, m.mid, m.mms, m.mt, {gap} AS g,
      m.state = r.motion AND m.mid IS NOT NULL AND NOT ({gap})
        AND (r.fix_ms - m.mms >= 300000 OR (r.motion AND r.total_mm - m.mt >= 500000)) AS due
    FROM m JOIN r ON r.device_id = m.device_id AND r.rn = m.rn + 1))""",
        "me AS (SELECT device_id, rn, type, position_id, event_ms FROM m WHERE type IS NOT NULL)",
    )


by("ev_motion_old", "SELECT device_id, type, position_id, event_ms FROM me", lambda s, d: folds.motion_events(far(s, d)), SQL_DISTANCE, *old_motion("false"))

# New motion: n has what doesn't depend on the state. The trailing positions of a row are those from head to the row before it.
_leg = sql_haversine("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")
NEW_MOTION = (
    f"""n0 AS (SELECT *, row_number() OVER w AS rn, fix_ms - lag(fix_ms) OVER w AS dt, lag(id) OVER w AS pid, lag(fix_ms) OVER w AS pms, {_leg} AS leg,
    count(*) OVER (PARTITION BY device_id ORDER BY fix_ms RANGE UNBOUNDED PRECEDING) AS upto,
    greatest(1, count(*) OVER (PARTITION BY device_id ORDER BY fix_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 180000 PRECEDING)) AS next_head
  FROM d WINDOW w AS (PARTITION BY device_id ORDER BY fix_ms, id))""",
    """n1 AS (SELECT *, lag(next_head) OVER w AS head, coalesce(dt > 0 AND leg / dt > 200 / 180000, false) AS fast,
    coalesce(dt > 3600000 AND distance_mm / 1000 >= 200 AND distance_mm / 1000 / dt > 200 / 180000, false) AS leap FROM n0 WINDOW w AS (PARTITION BY device_id ORDER BY rn))""",
    f"""n AS (SELECT n1.*, max(CASE WHEN NOT fast THEN rn END) OVER (PARTITION BY device_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slow,
    x.oldest, coalesce(x.wide, false) AS wide FROM n1 LEFT JOIN (SELECT r.device_id AS dev, r.rn AS spot, min(q.fix_ms) AS oldest,
      bool_or({sql_haversine("q.latitude", "q.longitude", "r.latitude", "r.longitude")} >= 200) AS wide
      FROM n1 r JOIN n1 q ON q.device_id = r.device_id AND q.rn BETWEEN r.head AND r.rn - 1 GROUP BY 1, 2) x ON x.dev = n1.device_id AND x.spot = n1.rn)""",
    f"""nm AS (SELECT device_id, rn, false AS streak, latitude AS la, longitude AS lo, upto, '' AS kind, rn AS spot FROM n WHERE rn = 1 UNION ALL
  SELECT z.device_id, z.rn, CASE kind WHEN 'M' THEN true WHEN '' THEN streak ELSE false END,
    CASE WHEN kind = '' THEN la ELSE s.latitude END, CASE WHEN kind = '' THEN lo ELSE s.longitude END, CASE WHEN kind = '' THEN z.upto ELSE s.upto END, kind, z.spot
  FROM (SELECT *, CASE WHEN kind = 'M' AND greatest(head, slow, upto + 1) < rn THEN greatest(head, slow, upto + 1) ELSE rn END AS spot FROM (
    SELECT n.device_id, n.rn, n.head, n.slow, nm.streak, nm.la, nm.lo, nm.upto, CASE WHEN leap AND nm.streak THEN 'SL' WHEN leap THEN 'L'
      WHEN nm.streak THEN CASE WHEN NOT wide AND NOT fast AND fix_ms - oldest >= 180000 THEN 'S' ELSE '' END
      WHEN {sql_haversine("nm.la", "nm.lo", "n.latitude", "n.longitude")} >= 200 THEN 'M' ELSE '' END AS kind
    FROM nm JOIN n ON n.device_id = nm.device_id AND n.rn = nm.rn + 1)) z JOIN n s ON s.device_id = z.device_id AND s.rn = z.spot)""",
)
by("ev_motion_new", """SELECT n.device_id, x.type, x.id AS position_id, x.ms AS event_ms FROM (
  SELECT device_id, rn, unnest(CASE kind WHEN 'SL' THEN [1, 2, 3] WHEN 'L' THEN [2, 3] WHEN 'M' THEN [4] WHEN 'S' THEN [5] ELSE [] END) AS e, spot FROM nm) v
  JOIN n ON n.device_id = v.device_id AND n.rn = CASE WHEN e = 4 THEN spot ELSE v.rn END,
  LATERAL (SELECT CASE WHEN e IN (2, 4) THEN 'deviceMoving' ELSE 'deviceStopped' END AS type, CASE WHEN e IN (1, 2) THEN n.pid ELSE n.id END AS id, CASE WHEN e IN (1, 2) THEN n.pms ELSE n.fix_ms END AS ms) x""",
   lambda s, d: folds.motion_events(far(s, d), "new"), SQL_DISTANCE, *NEW_MOTION)

# Motion of four states
_step = sql_haversine("v.la", "v.lo", "r.latitude", "r.longitude", 6_371_000.0)
V2 = (
    f"r AS (SELECT *, id % 23 <> 0 AS valid, row_number() OVER {W} AS rn FROM p)",
    f"""v AS (SELECT device_id, CAST(0 AS BIGINT) AS rn, 'UNKNOWN' AS state, CAST(0 AS BIGINT) AS pause, CAST(0 AS BIGINT) AS ms, CAST(NULL AS DOUBLE) AS la, CAST(NULL AS DOUBLE) AS lo, false AS told,
    CAST(NULL AS BIGINT) AS id FROM r WHERE rn = 1 UNION ALL
  SELECT device_id, rn, state, CASE WHEN state = 'PAUSED' AND was IN ('UNKNOWN', 'MOVING') THEN fix_ms ELSE pause END, CASE WHEN valid AND late THEN ms ELSE fix_ms END,
    CASE WHEN valid AND NOT late THEN latitude ELSE la END, CASE WHEN valid AND NOT late THEN longitude ELSE lo END, state <> was, id
  FROM (SELECT *, CASE WHEN NOT valid OR late OR gap OR accuracy > 80 THEN 'UNKNOWN'
      WHEN was IN ('PAUSED', 'STOPPED') THEN CASE WHEN step > 50 THEN 'MOVING' WHEN was = 'STOPPED' OR (fix_ms - pause) // 1000 >= 45 THEN 'STOPPED' ELSE 'PAUSED' END
      WHEN speed / 1.94384 < 0.5 AND coalesce(step / ((fix_ms - ms) / 1000) < 0.5, true) THEN 'PAUSED' ELSE 'MOVING' END AS state
    FROM (SELECT r.*, v.state AS was, v.pause, v.ms, v.la, v.lo, v.ms > 0 AND r.fix_ms <= v.ms AS late, v.ms > 0 AND r.fix_ms - v.ms > 300000 AS gap, CASE WHEN v.ms > 0 THEN {_step} END AS step
      FROM v JOIN r ON r.device_id = v.device_id AND r.rn = v.rn + 1)))""",
)
by("ev_motion_v2", "SELECT v.device_id, state AS type, id AS position_id, ms AS event_ms FROM v WHERE told",
   lambda s, d: folds.motion_events(pos(s, d).withColumns({"valid": F.col("id") % 23 != 0, "quality": F.when(F.col("accuracy") > 80, "POOR").otherwise("GOOD")}), "v2"), *V2)

# Trips and stops


def spans(moves: str, source: str, top: str = "top") -> tuple[str, ...]:
    """CTEs: seq has what opens (`opens`) and closes spans in order, sp the spans. source: the events me, and what the first row opens."""
    return (
        "g AS (SELECT r.*, coalesce(sum(CASE WHEN e.rn IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r.device_id ORDER BY r.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part"
        " FROM r LEFT JOIN (SELECT DISTINCT device_id, rn FROM me) e ON e.device_id = r.device_id AND e.rn = r.rn)",
        "tops AS (SELECT device_id, max(rn) AS rn, max(speed) AS top FROM g GROUP BY device_id, part)",
        "ends AS (SELECT device_id, max(rn) AS rn FROM r GROUP BY 1)",
        f"""seq AS (SELECT device_id, 0 AS place, 0 AS key, id, true AS opens, 0.0 AS top FROM r WHERE rn = 1 AND {source} UNION ALL
  SELECT me.device_id, {"me.rn, 0" if top == "top" else "event_ms, position_id"}, position_id, (type = 'deviceMoving') = {moves}, {"tops.top" if top == "top" else "0"} FROM me JOIN tops USING (device_id, rn) UNION ALL
  SELECT r.device_id, 9e15, 0, r.id, false, CASE WHEN EXISTS (SELECT 1 FROM me WHERE me.device_id = r.device_id AND me.rn = r.rn) THEN 0 ELSE {"tops.top" if top == "top" else "0"} END
    FROM r JOIN ends USING (device_id, rn) JOIN tops USING (device_id, rn))""",
        """sp AS (SELECT x.device_id, a.id AS start_id, a.fix_ms AS start_ms, b.id AS end_id, b.fix_ms AS end_ms, CAST(x.until AS DOUBLE) AS max_speed, (b.total_mm - a.total_mm) / 1000 AS metres, a.fuel - b.fuel AS spent_fuel,
    b.hours_ms - a.hours_ms AS hours, coalesce(a.driver_unique_id, b.driver_unique_id) AS driver
  FROM (SELECT *, lead(id) OVER w AS end_id, lead(opens) OVER w AS again, lead(top) OVER w AS until FROM seq WINDOW w AS (PARTITION BY device_id ORDER BY place, key)) x
    JOIN h a ON a.id = x.id JOIN h b ON b.id = x.end_id WHERE x.opens AND NOT x.again)""",
    )


TRIPS_SQL = """SELECT device_id, start_id, start_ms, end_id, end_ms, end_ms - start_ms AS duration, metres AS distance,
  round(CASE WHEN end_ms > start_ms THEN metres * 1000 / (end_ms - start_ms) * 1.94384 ELSE 0 END, 6) AS average_speed, max_speed, spent_fuel, driver FROM sp"""
STOPS_SQL = "SELECT device_id, start_id, start_ms, end_id, end_ms, end_ms - start_ms AS duration, hours AS engine_hours, spent_fuel FROM sp"
_stored = lambda s, d: folds.motion_events(far(s, d))
for _name, _sql, _is, _report in (("rep_trips", TRIPS_SQL, True, reports.trips), ("rep_stops", STOPS_SQL, False, reports.stops)):
    _moves = str(_is).lower()
    by(f"{_name}_slow", _sql, lambda s, d, f=_report, t=_is: f(reports.slow_spans(full(s, d), t)), SQL_DISTANCE, HOURS_SQL, *old_motion("motion"), *spans(_moves, f"motion = {_moves}"))
    by(f"{_name}_fast", _sql, lambda s, d, f=_report, t=_is: f(reports.fast_spans(full(s, d), _stored(s, d), t)), SQL_DISTANCE, HOURS_SQL, *old_motion("false"), *spans(_moves, "motion", "0"))
# Of a day and less the positions decide, of more the stored events: here a range of three hours.
_until = START_MS + 3 * HOUR
by("rep_trips", TRIPS_SQL, lambda s, d: reports.trips(reports.spans(full(s, d), _stored(s, d), START_MS, _until, True, limit_s=7 * 86_400)), SQL_DISTANCE, HOURS_SQL,
   old_motion("motion")[0].replace("FROM d)", f"FROM d WHERE fix_ms <= {_until})"), *old_motion("motion")[1:], *spans("true", "motion"))

# Filters


def kept(ok: str, src: str = "p") -> tuple[str, str]:
    """CTEs: a walks through each device's rows beside the last row kept. DIST and DT are metres and milliseconds from that one, N the rows kept that day."""
    ok = ok.replace("DIST", sql_haversine("a.la", "a.lo", "r.latitude", "r.longitude")).replace("DT", "(r.fix_ms - a.ms)").replace("COUNT", f"CASE WHEN r.fix_ms // {DAY} = a.day THEN a.n ELSE 0 END")
    day = f"r.fix_ms // {DAY}"
    return (
        f"r AS (SELECT *, row_number() OVER {W} AS rn FROM {src})",
        f"""a AS (SELECT device_id, rn, id, true AS ok, fix_ms AS ms, latitude AS la, longitude AS lo, server_ms AS sms, alarm, fix_ms // {DAY} AS day, 1 AS n FROM r WHERE rn = 1 UNION ALL
  SELECT device_id, rn, id, ok, CASE WHEN ok THEN fix_ms ELSE ms END, CASE WHEN ok THEN latitude ELSE la END, CASE WHEN ok THEN longitude ELSE lo END, CASE WHEN ok THEN server_ms ELSE sms END,
    CASE WHEN ok THEN new_alarm ELSE alarm END, today, CASE WHEN today = day THEN n ELSE 0 END + CASE WHEN ok THEN 1 ELSE 0 END
  FROM (SELECT r.device_id, r.rn, r.id, r.fix_ms, r.latitude, r.longitude, r.server_ms, r.alarm AS new_alarm, a.ms, a.la, a.lo, a.sms, a.alarm, a.day, a.n, {day} AS today, {ok} AS ok
    FROM a JOIN r ON r.device_id = a.device_id AND r.rn = a.rn + 1))""",
    )


#: Positions whose fix times are cut to ten minutes, so that many are equal.
TENS = f"(SELECT * REPLACE (fix_ms // 600000 * 600000 AS fix_ms) FROM p)"
tens = lambda s, d: pos(s, d).withColumn("fix_ms", F.expr("fix_ms div 600000 * 600000"))
for _name, _ok, _opts, _tens in (
    ("filter_max_speed", "NOT (DT > 0 AND DIST / (DT / 1000.0) * 1.94384 > 3)", {"max_speed_kn": 3}, False), ("filter_min_period", "NOT (DT > 0 AND DT < 400000)", {"min_period_s": 400}, False),
    ("filter_distance", "NOT (DIST < 150)", {"min_distance_m": 150}, False), ("filter_duplicate", "NOT (DT = 0 AND (r.alarm IS NULL OR a.alarm IS NOT NULL))", {"duplicates": True}, True),
    ("filter_daily_limit", "NOT (COUNT >= 20)", {"daily_limit": 20}, False), ("filter_daily_limit_interval", "NOT (COUNT >= 5 AND DT < 500000)", {"daily_limit": 5, "daily_interval_s": 500}, False),
):
    by(_name, "SELECT device_id, id FROM a WHERE ok", lambda s, d, o=_opts, f=tens if _tens else pos: folds.accepted(f(s, d), **o).select("device_id", "id"), *kept(_ok, TENS if _tens else "p"))

_skip = "(r.server_ms - a.sms > 900000 OR r.alarm LIKE '%fault%')"
_plain = f"r.accuracy > 140 OR r.fix_ms > {NOW} OR (DT > 0 AND DIST / (DT / 1000.0) * 1.94384 > 20) OR COUNT >= 60"
_soft = "(DT = 0 AND (r.alarm IS NULL OR a.alarm IS NOT NULL)) OR r.speed = 0 OR DIST < 60"


def _chain(s, d):
    rows = tens(s, d).withColumn("fault", F.when(F.col("alarm").contains("fault"), True))
    own = {"Accuracy": F.col("accuracy") > 140, "Future": F.col("fix_ms") > NOW, "Static": F.col("speed") == 0}
    return folds.judged(
        rows, own, F.col("protocol") == "mobile", [*folds.KEYS, "fault"], max_speed_kn=20, duplicates=True, min_distance_m=60, daily_limit=60, skip_limit_s=900, skip_keys=["fault"]
    ).where("filters = ''").select("device_id", "id")


# Of a device's first row only the filters without look-back count; such a row may be no last accepted one, so the first kept is found by itself.
by("filter_chain", "SELECT device_id, id FROM a WHERE ok", _chain,
   f"""q AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY fix_ms, id) AS k FROM {TENS} x)""",
   f"""q1 AS (SELECT q.* FROM q JOIN (SELECT device_id, min(k) AS k FROM q WHERE protocol = 'mobile' OR NOT (accuracy > 140 OR fix_ms > {NOW} OR (speed = 0 AND coalesce(alarm, '') NOT LIKE '%fault%')) GROUP BY 1) f ON f.device_id = q.device_id AND q.k >= f.k)""",
   *kept(f"r.protocol = 'mobile' OR NOT ({_plain} OR (({_soft}) AND NOT coalesce({_skip}, false)))", "q1"))

by("decimation", "SELECT device_id, id FROM a WHERE ok OR rn = (SELECT max(x.rn) FROM r x WHERE x.device_id = a.device_id)", lambda s, d: folds.decimated(pos(s, d)).select("device_id", "id"), *kept("DIST >= 12 OR DT >= 120000"))
by("throttle", "SELECT device_id, id FROM a WHERE ok", lambda s, d: mobile.throttled(pos(s, d), 600).select("device_id", "id"), *kept("DT >= 600000"))

# Scalars
_waves = lambda *terms: "((" + " + ".join(f"sin({arg} * 3.14159265358979324e0) * {amp}e0" for amp, arg in terms) + ") * 2 / 3)"
by("wgs84_to_gcj02", f"""SELECT id, round(la + dy * 180 / ((6378245e0 * (1 - 0.00669342162296594323e0)) / (magic * sqrt(magic)) * 3.14159265358979324e0), 6) AS lat,
  round(lon + dx * 180 / (6378245e0 / sqrt(magic) * cos(radians(la)) * 3.14159265358979324e0), 6) AS lon FROM (SELECT *, 1 - 0.00669342162296594323e0 * sin(radians(la)) * sin(radians(la)) AS magic,
    -100 + 2 * x + 3 * y + 0.2e0 * y * y + 0.1e0 * x * y + 0.2e0 * sqrt(abs(x)) + {_waves((20, "6 * x"), (20, "2 * x"))} + {_waves((20, "y"), (40, "y / 3"))} + {_waves((160, "y / 12"), (320, "y / 30"))} AS dy,
    300 + x + 2 * y + 0.1e0 * x * x + 0.1e0 * x * y + 0.1e0 * sqrt(abs(x)) + {_waves((20, "6 * x"), (20, "2 * x"))} + {_waves((20, "x"), (40, "x / 3"))} + {_waves((150, "x / 12"), (300, "x / 30"))} AS dx
  FROM (SELECT id, latitude AS la, longitude + 120 AS lon, longitude + 120 - 105 AS x, latitude - 35 AS y FROM p))""",
   lambda s, d: pos(s, d).select("id", geo.gcj02(F.col("latitude"), F.col("longitude") + 120).alias("g")).select("id", F.round("g.lat", 6).alias("lat"), F.round("g.lon", 6).alias("lon")))
_dm = lambda c, w: f"lpad(CAST(CAST(floor(abs({c})) AS INT) AS VARCHAR), {w}, '0') || lpad(printf('%.4f', (abs({c}) - floor(abs({c}))) * 60), 7, '0')"
by("gprmc", f"""SELECT id, '$' || body || '*' || printf('%02X', list_reduce(list_prepend(0, list_transform(range(1, length(body) + 1), lambda i: ascii(body[i]))), lambda a, c: xor(a, c))) AS sentence FROM (
  SELECT id, 'GPRMC,' || strftime(epoch_ms(fix_ms), '%H%M%S') || ',A,' || {_dm("latitude", 2)} || ',' || CASE WHEN latitude < 0 THEN 'S' ELSE 'N' END || ',' || {_dm("longitude", 3)} || ','
    || CASE WHEN longitude < 0 THEN 'W' ELSE 'E' END || ',' || printf('%.2f', speed) || ',' || printf('%.2f', course) || ',' || strftime(epoch_ms(fix_ms), '%d%m%y') || ',' AS body FROM p)""", lambda s, d: egress.gprmc(pos(s, d)))  # fmt: skip
by("recovery_timeout_reason", """SELECT id, CASE id % 6 WHEN 0 THEN 'TIMEOUT_NO_DELIVERY' WHEN 1 THEN 'TIMEOUT_NO_FGS' WHEN 2 THEN 'TIMEOUT_NO_FGS' WHEN 3 THEN 'TIMEOUT_NO_TRACKING' WHEN 4 THEN 'TIMEOUT_NO_GPS' ELSE 'TIMEOUT_NO_SERVER_ACK' END AS reason FROM p""",
   lambda s, d: pos(s, d).select("id", mobile.timeout_reason(F.slice(F.array(*map(F.lit, mobile.STAGES)), 1, (F.col("id") % 6).cast("int"))).alias("reason")))
