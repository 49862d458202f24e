"""The path of a live position as one keyed operator: filter, distance, motion, overspeed, geofences, inactivity.

Each part has typed state variables of its own, and the state machines are those of the batch folds, so that a stream gives what
the batch gives. Sessions need spark.sql.streaming.stateStore.providerClass set to PROVIDER.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import folds, pipeline
from .live import with_time

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a position has; those of `tagged` rows repeat it with a geofence it is in.
POSITION = "device_id long, id long, fix_ms long, server_ms long, latitude double, longitude double, speed double, motion boolean, ignition boolean"
#: type: accepted (value: the total distance in mm), dropped (detail: the filters), late, or an event; value is the geofence of geofence events.
OUTPUT = "device_id long, type string, position_id long, event_ms long, value long, detail string"
#: A device as it was stored: its last accepted position, the distance so far, and whether it is on a trip.
STORED = "device_id long, id long, fix_ms long, server_ms long, latitude double, longitude double, total_mm long, moving boolean, geofences array<long>"

_LAST = "id long, fix_ms long, server_ms long, latitude double, longitude double, total_mm long, seen_ms long, quiet boolean, day long, count long"
_MOTION = "streak boolean, state boolean, mark_id long, mark_ms long, mark_mm long"
_SPEED = "since long, told boolean"


class Path(StatefulProcessor):
    """One device's path. Rows of a batch go in order of fix time and id; a row older than one that was handled before is told as late and left out."""

    def __init__(self, filters: dict, motion: dict, limit_kn: float, minimal_s: int, silent_s: int, forget_s: int):
        self.filters, self.motion, self.limit, self.minimal, self.silent, self.forget = filters, motion, limit_kn, minimal_s * 1000, silent_s * 1000, forget_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _LAST)
        self.moves = handle.getValueState("motion", _MOTION)
        self.speeding = handle.getValueState("speeding", _SPEED)
        self.inside = handle.getMapState("inside", "geofence long", "since_ms long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.last.update((int(r.id), int(r.fix_ms), int(r.server_ms), float(r.latitude), float(r.longitude), int(r.total_mm), int(r.fix_ms), False, int(r.fix_ms) // 86_400_000, 1))
        self.moves.update((bool(r.moving), bool(r.moving), None, None, None))
        for g in r.geofences if r.geofences is not None else ():
            self.inside.updateValue((int(g),), (int(r.fix_ms),))
        self._wait(int(r.fix_ms) + self.silent)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        tags = df[df["geofence_id"].notna()].groupby("id")["geofence_id"].agg(lambda x: {int(g) for g in x}).to_dict()
        accept, motion, total, seen, quiet = self._restored()
        since, told = self.speeding.get() if self.speeding.exists() else (None, False)
        now, out = {k[0] for k in self.inside.keys()}, []
        began = set(now)
        say = lambda kind, r, value=None, detail=None: out.append((key[0], kind, int(r.id), int(r.fix_ms), value, detail))
        entered: dict[int, int] = {}
        for r in df[df["geofence_id"].isna()].sort_values(["fix_ms", "id"]).itertuples(index=False):
            if seen is not None and r.fix_ms < seen:
                say("late", r)
                continue
            if seen is not None and not quiet and r.fix_ms - seen >= self.silent:
                say("deviceInactive", accept.last)
            seen, quiet, before = int(r.fix_ms), False, accept.last
            dropped = accept.step(SimpleNamespace(**r._asdict(), own="", keys=(), exempt=False))[0][3]
            if dropped:
                say("dropped", r, None, dropped)
                continue
            total += floor(folds._metres(before, r) * 1000 + 0.5) if before is not None else 0
            accept.last.total_mm = total
            say("accepted", r, total)
            for kind, at in motion.decide(accept.last):
                say(kind, at)
            if not r.speed > self.limit:
                since, told = None, False
            else:
                since = seen if since is None else since
                if not told and seen - since >= self.minimal:
                    told = True
                    say("deviceOverspeed", r)
            at = tags.get(r.id, set())
            for g in sorted(now - at):
                say("geofenceExit", r, g)
            for g in sorted(at - now):
                say("geofenceEnter", r, g)
                entered[g] = seen
            now = at
        self._save(accept, motion, total, seen, quiet)
        self.speeding.update((since, told))
        for g in began - now:
            self.inside.removeKey((g,))
        for g in now:
            if g in entered:
                self.inside.updateValue((g,), (entered[g],))
        self._wait(seen + (self.forget if quiet else self.silent))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Tells that a device is silent, and forgets it once it has been so for long."""
        last = self.last.get()
        i, ms, seen = last[0], last[1], last[6]
        if expiredTimerInfo.getExpiryTimeInMs() >= seen + self.forget:
            for state in (self.last, self.moves, self.speeding, self.inside):
                state.clear()
            return
        self.last.update((*last[:7], True, *last[8:]))
        self.handle.registerTimer(seen + self.forget)
        yield pd.DataFrame([(key[0], "deviceInactive", i, ms, None, None)], columns=[c.split()[0] for c in OUTPUT.split(", ")], dtype=object)

    def close(self) -> None:
        pass

    def _wait(self, until: int) -> None:
        """One timer a device: that of its silence, or once that is told, of forgetting it."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(until)

    def _restored(self):
        accept, motion, total, seen, quiet = folds.LastAccepted(**self.filters), folds.OldMotion(**self.motion), 0, None, False
        if self.last.exists():
            i, ms, sms, la, lo, total, seen, quiet, accept.day, accept.count = self.last.get()
            if i is not None:
                accept.last = motion.last = SimpleNamespace(id=i, fix_ms=ms, server_ms=sms, latitude=la, longitude=lo, total_mm=total, keys=())
        if self.moves.exists():
            motion.streak, motion.state, i, ms, mm = self.moves.get()
            motion.mark = SimpleNamespace(id=i, fix_ms=ms, total_mm=mm) if i is not None else None
        return accept, motion, total, seen, quiet

    def _save(self, accept, motion, total, seen, quiet) -> None:
        r, m = accept.last, motion.mark
        place = (int(r.id), int(r.fix_ms), int(r.server_ms), float(r.latitude), float(r.longitude)) if r is not None else (None,) * 5
        self.last.update((*place, total, seen, quiet, int(accept.day) if accept.day is not None else None, accept.count))
        self.moves.update((bool(motion.streak), bool(motion.state), *((int(m.id), int(m.fix_ms), int(m.total_mm)) if m is not None else (None,) * 3)))


def live_path(
    stream: DataFrame, geofences: DataFrame, stored: DataFrame | None = None, filters: dict | None = None, motion: dict | None = None,
    limit_kn: float = 60.0, minimal_s: int = 15, silent_s: int = 1800, forget_s: int = 90 * 86_400, delay: str = "10 minutes",
) -> DataFrame:
    """(OUTPUT) of a stream of POSITION columns, with geofences (geofence_id, area).

    filters are options of folds.LastAccepted, motion those of folds.OldMotion. stored (STORED, a row a device) is where devices begin. Positions
    are tagged by cells before they are dealt by device, so that no task holds the geofences. A device is told inactive once the
    watermark, or its own next position, is silent_s past its last one, and forgotten after forget_s.
    """
    rows = with_time(stream.select(*[c.split()[0] for c in POSITION.split(", ")]), delay)
    tags = pipeline.tagged(rows, geofences, ["fix_time"])
    blank = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in POSITION.split(", ") if c.split()[0] not in ("id", "device_id", "fix_ms")}
    both = rows.withColumn("geofence_id", F.lit(None).cast("long")).unionByName(tags.withColumns(blank).withColumn("geofence_id", F.col("geofence_id").cast("long")))
    path = Path(filters or {}, motion or {}, limit_kn, minimal_s, silent_s, forget_s)
    start = stored.groupBy("device_id") if stored is not None else None
    return both.groupBy("device_id").transformWithStateInPandas(path, OUTPUT, "append", "eventTime", start)
