"""Live processing with Structured Streaming: a deduplicating ledger, keyed motion and overspeed state, inactivity timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import canonical_hash

POSITION = "id long, device_id long, fix_ms long, server_ms long, speed double, motion boolean, total_mm long, ignition boolean"
EVENT = "device_id long, type string, position_id long, event_ms long"


def with_time(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Adds fix_time with a watermark."""
    return stream.withColumn("fix_time", F.timestamp_millis("fix_ms")).withWatermark("fix_time", delay)


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each message once within the watermark, so that state is dropped in time."""
    return with_time(stream).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame) -> DataFrame:
    """Messages and protocols' devices per day, late data within the watermark included."""
    return with_time(stream).groupBy(F.window("fix_time", "1 day")).agg(F.count("*").alias("messages"), F.approx_count_distinct("device_id").alias("devices"))


def old_motion(stream: DataFrame, distance_m: int = 500, trip_s: int = 300, parking_s: int = 300, no_data_s: int = 900) -> DataFrame:
    """deviceMoving and deviceStopped per device; late positions leave the state alone. The state is a few numbers a device."""
    state_schema = "streak boolean, state boolean, mark_id long, mark_ms long, mark_mm long, last_id long, last_ms long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, now, mi, mt, mm, li, lt = state.get if state.exists else (False, False, -1, -1, -1, -1, -1)
        rows = pd.concat(list(frames)).sort_values(["fix_ms", "id"])
        out = []
        for r in rows.itertuples(index=False):
            if r.fix_ms < lt:
                continue
            pi, pt, li, lt = li, lt, int(r.id), int(r.fix_ms)
            if pt >= 0 and streak and r.fix_ms - pt >= no_data_s * 1000:
                streak = now = False
                mi = -1
                out.append((key[0], "deviceStopped", pi, pt))
            elif now == bool(r.motion):
                if mi >= 0 and (r.fix_ms - mt >= (trip_s if now else parking_s) * 1000 or (now and r.total_mm - mm >= distance_m * 1000)):
                    out.append((key[0], "deviceMoving" if now else "deviceStopped", mi, mt))
                    streak, mi = now, -1
            else:
                now = bool(r.motion)
                mi, mt, mm = (-1, -1, -1) if streak == now else (li, lt, int(r.total_mm))
        state.update((streak, now, mi, mt, mm, li, lt))
        yield pd.DataFrame(out, columns=["device_id", "type", "position_id", "event_ms"])

    return stream.groupBy("device_id").applyInPandasWithState(step, EVENT, state_schema, "append", GroupStateTimeout.NoTimeout)


def overspeed(stream: DataFrame, limit: float, minimal_s: int) -> DataFrame:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over, since, last = state.get if state.exists else (False, -1, -1)
        out = []
        for r in pd.concat(list(frames)).sort_values(["fix_ms", "id"]).itertuples(index=False):
            if r.fix_ms < last:
                continue
            last = int(r.fix_ms)
            if r.speed <= limit:
                over, since = False, -1
                continue
            if not over:
                over, since = True, last
            if since >= 0 and last - since >= minimal_s * 1000:
                out.append((key[0], "deviceOverspeed", int(r.id), last))
                since = -1
        state.update((over, since, last))
        yield pd.DataFrame(out, columns=["device_id", "type", "position_id", "event_ms"])

    return stream.groupBy("device_id").applyInPandasWithState(step, EVENT, "over boolean, since long, last long", "append", GroupStateTimeout.NoTimeout)


def inactivity(stream: DataFrame, silent: str = "30 minutes") -> DataFrame:
    """A row per device and silent stretch: sessions of positions closed by the watermark."""
    return with_time(stream).groupBy("device_id", F.session_window("fix_time", silent)).agg(F.max("fix_ms").alias("last_ms")).select("device_id", "last_ms")


def sliding_counts(stream: DataFrame, length: str = "10 minutes", step: str = "5 minutes") -> DataFrame:
    """Messages per device and sliding window."""
    return with_time(stream).groupBy("device_id", F.window("fix_time", length, step)).agg(F.count("*").alias("messages"))


def reordered(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Positions of each device in order of fix and server time, held until the watermark has passed them; later ones are left out.

    What a device has waiting is its positions within the delay; a timer by event time lets it go when nothing new comes.
    """
    names = [c.split()[0] for c in POSITION.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in json.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            for f in frames:
                rows += [tuple(None if pd.isna(x) else x for x in r) for r in f[names].astype(object).itertuples(index=False)]
        mark, at = state.getCurrentWatermarkMs(), names.index("fix_ms")
        rows.sort(key=lambda r: (r[at], r[names.index("server_ms")], r[0]))
        ready, waiting = [r for r in rows if r[at] < mark], [r for r in rows if r[at] >= mark]
        if waiting:
            state.update((json.dumps(waiting),))
            state.setTimeoutTimestamp(max(mark, waiting[0][at]) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(ready, columns=names)

    return with_time(stream, delay).groupBy("device_id").applyInPandasWithState(step, POSITION, "waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def ledger(stream: DataFrame, keep: str = "7 days") -> DataFrame:
    """(message_id, id, outcome) for messages (message_id, id, device_id, sequence, payload): accepted for the first of an id, duplicate for
    ones like it, rejected for others. An id is forgotten keep after it came last."""
    hashed = stream.withColumn("hash", canonical_hash(F.col("device_id"), F.col("sequence"), F.col("payload"))).select("message_id", "id", "hash")
    wait = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, out = state.get[0] if state.exists else None, []
        for r in pd.concat(list(frames)).sort_values("id").itertuples(index=False):
            out.append((key[0], int(r.id), "accepted" if first is None else "duplicate" if r.hash == first else "rejected"))
            first = r.hash if first is None else first
        state.update((first,))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["message_id", "id", "outcome"])

    return hashed.groupBy("message_id").applyInPandasWithState(step, "message_id string, id long, outcome string", "hash string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_sink(path: str):
    """foreachBatch writer: each micro-batch's latest position per device, in a folder of its own that a retry overwrites."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from ..operators.request import latest

        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
