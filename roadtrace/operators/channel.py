"""The mobile channel's states: presence, recovery, journeys, telemetry changes; and what joins losses to restorations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.adapter import by_time
from .folds import ordered_fold
from .mobile import STAGES


def dimensions(df: DataFrame, mqtt: DataFrame, now_ms: int, stale_s: int = 600) -> DataFrame:
    """gps, net, mqtt and outbox state per row of latest telemetry (device_id, fix_ms, gps_ok, network, validated, pending, pending_before); mqtt: mqtt_states()."""
    age = F.lit(now_ms) - F.col("fix_ms")
    return df.join(mqtt, "device_id", "left").select(
        "device_id", F.when(~F.col("gps_ok"), "NO_FIX").when(age > stale_s * 1000, "STALE").otherwise("OK").alias("gps"),
        F.when(F.col("network").isNull(), "none").when(~F.col("validated"), "unvalidated").otherwise(F.col("network")).alias("net"),
        F.coalesce("mqtt", F.lit("UNKNOWN")).alias("mqtt"),
        F.when(F.coalesce("pending", F.lit(0)) <= 0, "EMPTY").when(F.col("pending") < F.col("pending_before"), "DRAINING").otherwise("PENDING").alias("outbox"),
    )


def mqtt_states(arrivals: DataFrame, now_ms: int, grace_s: int = 180) -> DataFrame:
    """(device_id, mqtt) at now_ms by a device's arrivals (device_id, id, server_ms, mqtt: whether it came that way).

    A first arrival by MQTT connects. A connected device that nothing comes from for grace_s is disconnected; its next arrival by
    MQTT makes it connecting, and the one after that connected.
    """

    class State:
        mqtt, seen, device = "UNKNOWN", 0, None

        def tick(self, at):
            if self.mqtt == "CONNECTED" and at - self.seen > grace_s * 1000:
                self.mqtt = "DISCONNECTED"

        def step(self, r):
            self.tick(r.server_ms)
            if r.mqtt:
                self.mqtt = "CONNECTING" if self.mqtt == "DISCONNECTED" else "CONNECTED"
            self.seen, self.device = r.server_ms, r.device_id
            return []

        def finish(self):
            self.tick(now_ms)
            return [(self.device, self.mqtt)]

    return ordered_fold(arrivals.select("device_id", "id", "server_ms", "mqtt"), "device_id", ["server_ms", "id"], State, "device_id long, mqtt string")


def presence_stats(states: DataFrame, overdue: Column) -> DataFrame:
    """Devices by state, and how many of them are overdue."""
    return states.groupBy("state").agg(F.count("*").alias("devices"), F.count_if(overdue).alias("overdue"))


def counted(df: DataFrame, name: str) -> DataFrame:
    """How often each outcome came."""
    return df.groupBy(F.coalesce(name, F.lit("none")).alias("outcome")).agg(F.count("*").alias("n"))


def status_changes(messages: DataFrame, now_ms: int, timeout_s: int = 600) -> DataFrame:
    """(device_id, type, event_ms): deviceOnline at a message after a silence of timeout_s or none, deviceUnknown timeout_s after the
    message before a silence. messages: device_id, server_ms."""
    m, limit = messages.select("device_id", "server_ms").distinct(), timeout_s * 1000
    w = Window.partitionBy("device_id").orderBy("server_ms")
    before, after = F.lag("server_ms").over(w), F.coalesce(F.lead("server_ms").over(w), F.lit(now_ms))
    on = F.when(before.isNull() | (F.col("server_ms") - before > limit), F.struct(F.lit("deviceOnline").alias("type"), F.col("server_ms").alias("event_ms")))
    off = F.when(after - F.col("server_ms") > limit, F.struct(F.lit("deviceUnknown").alias("type"), (F.col("server_ms") + limit).alias("event_ms")))
    made = m.withColumn("e", F.array(on, off)).select("device_id", F.explode("e").alias("e")).where("e is not null")
    return made.select("device_id", "e.type", "e.event_ms")


def status_updates(df: DataFrame, status: Column) -> DataFrame:
    """Rows at which a device's status differs from that of the row before."""
    w = by_time()
    d = df.withColumn("status", status)
    return d.withColumn("was", F.lag("status").over(w)).where("was is null or status <> was").select("device_id", F.col("id").alias("position_id"), "status")


def stalled(df: DataFrame, moving_s: int = 240, still_s: int = 360, cooldown_s: int = 360) -> DataFrame:
    """Positions at which a device has kept its coordinates for moving_s, or still_s where it says that it stands; cooldown_s lie between two of them while it stands; movement ends the wait."""
    w = by_time()
    same = (F.lag("latitude").over(w) == F.col("latitude")) & (F.lag("longitude").over(w) == F.col("longitude"))
    d = df.withColumn("x_since", F.when(~F.coalesce(same, F.lit(False)), F.col("fix_ms")))
    d = d.withColumn("x_since", F.last("x_since", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    due = F.col("fix_ms") - F.col("x_since") >= F.when(F.col("motion"), moving_s * 1000).otherwise(still_s * 1000)

    class Cool:
        last = None

        def step(self, r):
            if not r.due:
                self.last = None
                return []
            if self.last is not None and r.fix_ms - self.last < cooldown_s * 1000:
                return []
            self.last = r.fix_ms
            return [(r.device_id, r.id, r.fix_ms)]

        def finish(self):
            return []

    return ordered_fold(d.select("device_id", "id", "fix_ms", due.alias("due")), "device_id", ["fix_ms", "id"], Cool, "device_id long, position_id long, event_ms long")


def telemetry_changes(df: DataFrame, low: int = 10) -> DataFrame:
    """(device_id, position_id, type, cause, confidence) of telemetry rows (gps_on, network, battery, journey_started, journey_ended, net_cause, net_conf).

    What a row doesn't tell stays as it was; a first value is no change. Network changes have a cause and a confidence, which
    are `inferred` where the row gives no cause, or a confidence other than confirmed or suspected.
    """
    w = by_time()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    state = {c: F.last(c, ignorenulls=True).over(upto) for c in ("gps_on", "network", "battery")}
    d = df.withColumns({f"x_{c}": v for c, v in state.items()})
    d = d.withColumns({f"x_was_{c}": F.lag(f"x_{c}").over(w) for c in state})
    net, old = F.col("x_network"), F.col("x_was_network")
    told = lambda name, kind: F.when(F.col(name), F.struct(F.lit(kind).alias("type"), F.lit(False).alias("net")))
    made = lambda kind, net=False: F.struct(F.lit(kind).alias("type"), F.lit(net).alias("net"))
    kinds = F.array(
        F.when(F.col("x_was_gps_on") & ~F.col("x_gps_on"), made("gpsOff")).when(~F.col("x_was_gps_on") & F.col("x_gps_on"), made("gpsOn")),
        F.when(old == net, None).when(old.isNotNull() & (net == "none"), made("networkLost", True)).when((old == "wifi") & net.isNotNull(), made("wifiLost", True)).when((old == "none") & net.isNotNull(), made("networkRestored", True)),
        F.when((F.col("x_was_battery") > low) & F.col("x_battery").between(0, low), made("batteryLow")),
        told("journey_started", "journeyStart"), told("journey_ended", "journeyEnd"),
    )
    d = d.withColumn("x_kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    cause = F.when(F.col("x_kind.net"), F.when(F.trim("net_cause") != "", F.col("net_cause")).otherwise("inferred"))
    sure = F.when(F.col("x_kind.net"), F.when(F.col("net_conf").isin("confirmed", "suspected"), F.col("net_conf")).otherwise("inferred"))
    return d.select("device_id", F.col("id").alias("position_id"), F.col("x_kind.type").alias("type"), cause.alias("cause"), sure.alias("confidence"))


def diagnostics(df: DataFrame, body: str = "body") -> DataFrame:
    """device_id, id and problems of JSON reports that tell of crashes, stuck stops, clock steps or a lost connection. What is no JSON tells nothing."""
    j = F.from_json(F.col(body), "crashes long, stuckStops long, clockSteps long, mqtt boolean")
    d = df.withColumn("j", j)
    found = F.array(*[F.when(F.col(f"j.{n}") > 0, n) for n in ("crashes", "stuckStops", "clockSteps")], F.when(~F.col("j.mqtt"), "mqttDown"))
    return d.select("device_id", "id", F.array_join(found, ",").alias("problems")).where("problems <> ''")


def eligibility(df: DataFrame, cooldown_s: int = 900, hourly: int = 3) -> DataFrame:
    """(device_id, id, ts, decision) per request (device_id, id, ts, enabled, token, active): the first reason in order that refuses it, or allow.

    Only requests that were allowed count for the cooldown and the limit of an hour.
    """

    class Requests:
        def __init__(self):
            self.sent: list[int] = []

        def step(self, r):
            self.sent = [x for x in self.sent if x >= r.ts - max(3_600_000, cooldown_s * 1000)]
            decision = "allow"
            if not r.enabled:
                decision = "disabled"
            elif r.token is None:
                decision = "no_token"
            elif r.active:
                decision = "active"
            elif self.sent and r.ts - self.sent[-1] < cooldown_s * 1000:
                decision = "cooldown"
            elif sum(x >= r.ts - 3_600_000 for x in self.sent) >= hourly:
                decision = "hourly_limit"
            else:
                self.sent.append(r.ts)
            return [(r.device_id, r.id, r.ts, decision)]

        def finish(self):
            return []

    return ordered_fold(df.select("device_id", "id", "ts", "enabled", "token", "active"), "device_id", ["ts", "id"], Requests, "device_id long, id long, ts long, decision string")


def stage_reached(reports: DataFrame) -> DataFrame:
    """(attempt, stages): how many of STAGES an attempt's reports (attempt, ts, stage) reached, each one only after the one before and once.

    An attempt has few reports, so they are gathered and walked in the JVM.
    """
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int") - 1
    walk = F.aggregate(F.array_sort(F.collect_list(F.struct("ts", place.alias("p")))), F.lit(0), lambda a, x: F.when(x["p"] == a, a + 1).otherwise(a))
    return reports.groupBy("attempt").agg(walk.alias("stages"))


def soft_success(attempts: DataFrame, positions: DataFrame, within_s: int = 300) -> DataFrame:
    """attempts (device_id, ts) with latency_ms to the device's next position at or after, and whether it came within_s.

    Both tables are merged in time order and carried backwards, so no attempt meets a range of positions.
    """
    a = attempts.withColumns({"fix_ms": F.lit(None).cast("long"), "x_at": F.col("ts"), "x_own": F.lit(True)})
    p = positions.select("device_id", "fix_ms").withColumns({"x_at": F.col("fix_ms"), "x_own": F.lit(False)})
    w = Window.partitionBy("device_id").orderBy(F.desc("x_at"), "x_own").rowsBetween(Window.unboundedPreceding, 0)
    m = a.unionByName(p, allowMissingColumns=True).withColumn("latency_ms", F.last("fix_ms", ignorenulls=True).over(w) - F.col("ts")).where("x_own")
    return m.withColumn("soft_success", F.coalesce(F.col("latency_ms") <= within_s * 1000, F.lit(False))).drop("x_own", "x_at", "fix_ms")


def active_journeys(events: DataFrame) -> DataFrame:
    """(device_id, journey_id) of devices whose last journey event (device_id, ts, journey_id, opens) opens one."""
    last = events.groupBy("device_id").agg(F.max_by(F.struct("journey_id", "opens"), F.struct("ts", "journey_id")).alias("e"))
    return last.where("e.opens").select("device_id", "e.journey_id")


def last_will(lost: DataFrame, active: DataFrame) -> DataFrame:
    """State of devices whose session was lost: SUSPECT while they are on a journey, else OFFLINE."""
    on = active.select("device_id", F.lit(True).alias("x_on")).distinct()
    return lost.join(on, "device_id", "left").select("device_id", F.when(F.col("x_on"), "SUSPECT").otherwise("OFFLINE").alias("state"))


def not_reopened(events: DataFrame) -> DataFrame:
    """Journey events without those that would open a journey up to the last one that the device had ended before."""
    w = Window.partitionBy("device_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.when(~F.col("opens"), F.col("journey_id"))).over(w)
    return events.withColumn("x_ended", ended).where(~F.col("opens") | F.col("x_ended").isNull() | (F.col("journey_id") > F.col("x_ended"))).drop("x_ended")


def health_funnel(devices: DataFrame, health: DataFrame, keys: list[str]) -> DataFrame:
    """Per category of devices: how many there are, how many have a health row (device_id, keys), and how many have each key in any."""
    seen = health.groupBy("device_id").agg(*[F.max(F.col(k).isNotNull()).alias(f"x_{k}") for k in keys])
    met = devices.join(seen.withColumnRenamed("device_id", "id"), "id", "left")
    return met.groupBy("category").agg(F.count("*").alias("devices"), F.count(f"x_{keys[0]}").alias("with_health"), *[F.count_if(F.col(f"x_{k}")).alias(f"with_{k}") for k in keys])


def paired_once(losses: DataFrame, ends: DataFrame) -> DataFrame:
    """losses (device_id, ts) with end_ts: in order, each takes the first end (device_id, ts) after it that none before has taken; null where none is left.

    The end's number among the device's ends is the running maximum of where each loss could begin, less its own number, so that two
    windows and a join on the number do it.
    """
    both = losses.select("device_id", "ts", F.lit(1).alias("loss")).union(ends.select("device_id", "ts", F.lit(0)))
    w = Window.partitionBy("device_id").orderBy("ts", F.desc("loss"), F.lit(0)).rowsBetween(Window.unboundedPreceding, 0)
    n = both.withColumns({"i": F.sum("loss").over(w), "e": F.sum(1 - F.col("loss")).over(w)})
    run = Window.partitionBy("device_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # At equal times a loss comes first, so an end at its time may end it.
    taken = n.where("loss = 1").withColumn("k", F.col("i") + F.max(F.col("e") + 1 - F.col("i")).over(run)).select("device_id", "ts", "k")
    numbered = n.where("loss = 0").select("device_id", F.col("e").alias("k"), F.col("ts").alias("end_ts"))
    return taken.join(numbered, ["device_id", "k"], "left").select("device_id", "ts", "end_ts")


def continuity_by(df: DataFrame, key: str, most_ms: int = 300_000) -> DataFrame:
    """Per device and journey or session: distinct fixes, first and last, time tracked and the longest gap."""
    w = Window.partitionBy("device_id", key).orderBy("fix_ms")
    t = df.where(F.col(key).isNotNull()).select("device_id", key, "fix_ms").distinct().withColumn("dt", F.col("fix_ms") - F.lag("fix_ms").over(w))
    return t.groupBy("device_id", key).agg(
        F.count("*").alias("fixes"), F.min("fix_ms").alias("first_ms"), F.max("fix_ms").alias("last_ms"), F.coalesce(F.sum(F.least("dt", F.lit(most_ms))), F.lit(0)).alias("tracking_ms"), F.coalesce(F.max("dt"), F.lit(0)).alias("longest_gap_ms")
    )


def timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of all parts (device_id, ts, end_ms, severity, confidence), with their type, by time and type."""
    rows = None
    for kind, df in parts.items():
        one = df.select("device_id", F.lit(kind).alias("type"), "ts", F.col("end_ms").cast("long").alias("end_ms"), "severity", "confidence")
        rows = one if rows is None else rows.union(one)
    return rows.orderBy("ts", "type")
