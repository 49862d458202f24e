"""Ordered folds per device, for state machines that look-back columns can't express.

Rows are dealt by ranges of (key, order), so that a key with very many rows lies in many tasks, and a task holds no more than
its range. Each range is walked at once, its first key from a fresh state. Where that key began in an earlier range, it is walked
again from the state at that range's end, until no range's start differs from what it was walked from. State machines of this
kind forget how they began after a few events, so that few ranges are walked more than twice; the result is that of one walk.
"""

from __future__ import annotations

import io
import pickle
from collections import deque, namedtuple
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce
from itertools import pairwise
from math import atan2, cos, radians, sin, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import KNOTS
from .tables import settled


@lru_cache(maxsize=64)
def _row_type(names: tuple[str, ...]) -> type:
    kind = namedtuple("Row", names)  # noqa: PYI024
    kind.__reduce__ = lambda self: (_row, (names, tuple(self)))
    return kind


def _row(names: tuple[str, ...], values: tuple):
    return _row_type(names)(*values)


def _saved(state) -> bytes:
    """What a state holds; equal bytes for equal values, whichever objects are shared in it."""
    out = io.BytesIO()
    pickler = pickle.Pickler(out, 5)
    pickler.fast = True
    pickler.dump(vars(state))
    return out.getvalue()


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable, schema: str) -> DataFrame:
    """start() makes a state with step(row) -> list of output tuples and finish() -> the same.

    A state holds a bounded number of rows and plain values in its attributes. Rows of a null key are one key. Rows should differ in
    (key, order): those that don't are walked in any order, and lie in one range. The driver gets one state a range.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kind = dict(df.dtypes)[key]
    columns = [*names, "x_part", "x_place", "x_first", "x_last", "x_single", "x_state"]
    blank = (None,) * len(names)

    def walk(starts: dict[int, bytes], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = at = first = part = None
        keys = 0
        frame = lambda rows: pd.DataFrame(rows, columns=columns, dtype=object)
        place = lambda rows, where: [(*x, part, where, None, None, None, None) for x in rows]
        for b in batches:
            if not len(b):
                continue
            part, out = int(b["x_part"].iloc[0]), []
            row = _row_type(tuple(c for c in b.columns if c != "x_part"))
            for r in map(row._make, zip(*[b[c] for c in row._fields], strict=True)):
                k = getattr(r, key)
                if state is None or not _same(k, at):
                    out += place(state.finish(), "head" if keys == 1 else "own") if state else []
                    state, at, keys = start(), k, keys + 1
                    if keys == 1:
                        first = k
                        vars(state).update(pickle.loads(starts[part]) if part in starts else {})
                out += place(state.step(r), "head" if keys == 1 else "own")
            yield frame(out)
        if state:
            known = _saved(state)
            yield frame([*place(state.finish(), "end"), (*blank, part, "state", first, at, keys == 1, known)])

    def walked(rows: DataFrame, starts: dict[int, bytes]) -> tuple[DataFrame, dict]:
        out = settled(rows.mapInPandas(partial(walk, starts), f"{schema}, x_part int, x_place string, x_first {kind}, x_last {kind}, x_single boolean, x_state binary"))
        return out, {r.x_part: r for r in out.where("x_place = 'state'").select(*columns[len(names) :]).collect()}

    rows = settled(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("x_part", F.spark_partition_id()))
    out, ranges = walked(rows, {})
    outs, latest = [out], dict.fromkeys(ranges, 0)
    before = {b: a for a, b in pairwise(sorted(ranges)) if _same(ranges[a].x_last, ranges[b].x_first)}
    ends, begun = {p: r.x_state for p, r in ranges.items()}, {}
    while wrong := {b: ends[a] for b, a in before.items() if begun.get(b) != ends[a]}:
        heads = F.broadcast(df.sparkSession.createDataFrame([(p, ranges[p].x_first) for p in wrong], f"h_part int, h_key {kind}"))
        out, found = walked(rows.join(heads, (F.col("x_part") == F.col("h_part")) & F.col(key).eqNullSafe(F.col("h_key")), "left_semi"), wrong)
        ends |= {p: r.x_state for p, r in found.items() if ranges[p].x_single}
        begun |= wrong
        latest |= dict.fromkeys(wrong, len(outs))
        outs.append(out)

    carried = set(before.values())

    def counted(n: int) -> DataFrame:
        """What counts of the n-th walk: the first keys that weren't walked later, and the ends that no other range carries on."""
        heads = [p for p, k in latest.items() if k == n]
        ends_ = [p for p, r in ranges.items() if (not r.x_single and (n == 0 and p not in carried or n and latest[p] == n)) or (r.x_single and latest[p] == n and p not in carried)]
        place, part = F.col("x_place"), F.col("x_part")
        return outs[n].where((place == "own") | ((place == "head") & part.isin(heads)) | ((place == "end") & part.isin(ends_))).select(*names)

    return reduce(DataFrame.union, [counted(n) for n in range(len(outs))])


EVENTS = "device_id long, type string, position_id long, event_ms long"


def _metres(a, b, radius: float = 6_378_137.0) -> float:
    y, x = sin(radians(b.latitude - a.latitude) / 2), sin(radians(b.longitude - a.longitude) / 2)
    h = y * y + cos(radians(a.latitude)) * cos(radians(b.latitude)) * x * x
    return 2 * atan2(sqrt(h), sqrt(1 - h)) * radius


class OldMotion:
    """Motion by duration or distance. A gap of no_data_s ends a trip at the position before it.

    decide(row) -> [(type, row that the event is about)]. moving: what the device does before the first row.
    """

    needs = ["motion", "total_mm", "ignition"]

    def __init__(self, distance_m=500, trip_s=300, parking_s=300, no_data_s=900, use_ignition=False, moving=False):
        self.d, self.trip, self.park, self.gap, self.ign = distance_m * 1000, trip_s * 1000, parking_s * 1000, no_data_s * 1000, use_ignition
        self.streak = self.state = moving
        self.mark = self.last = None

    def decide(self, r) -> list[tuple]:
        last, self.last = self.last, r
        if last is not None and self.streak and self.gap and r.fix_ms - last.fix_ms >= self.gap:
            self.streak, self.state, self.mark = False, False, None
            return [("deviceStopped", last)]
        if self.state != r.motion:
            self.state = r.motion
            self.mark = None if self.streak == r.motion else r
        elif self.mark is not None and self._due(self.mark, r):
            kind, at = "deviceMoving" if r.motion else "deviceStopped", self.mark
            self.streak, self.mark = r.motion, None
            return [(kind, at)]
        return []

    def _due(self, since, r) -> bool:
        if r.motion:
            return r.fix_ms - since.fix_ms >= self.trip or r.total_mm - since.total_mm >= self.d
        return r.fix_ms - since.fix_ms >= self.park or (self.ign and r.ignition is not None and not r.ignition)


class NewMotion:
    """Motion by displacement, over the positions of the last duration_s and one before them."""

    needs = ["latitude", "longitude", "distance_mm"]

    def __init__(self, distance_m=200, duration_s=180, gap_s=3600, moving=False):
        self.d, self.t, self.gap = distance_m, duration_s * 1000, gap_s * 1000
        self.streak, self.q, self.event = moving, deque(), None

    def _fast(self, metres: float, ms: int) -> bool:
        return ms > 0 and metres / ms > self.d / self.t

    def decide(self, r) -> list[tuple]:
        made = self._made(r) if self.q else []
        if made:
            self.event = made[-1][1]
        elif self.event is None:
            self.event = r
        self.q.append(r)
        while len(self.q) > 2 and r.fix_ms - self.q[1].fix_ms >= self.t:
            self.q.popleft()
        return made

    def _made(self, r) -> list[tuple]:
        last = self.q[-1]
        gap, step = r.fix_ms - last.fix_ms, r.distance_mm / 1000
        if gap > self.gap and step >= self.d and self._fast(step, gap):
            was, self.streak = self.streak, False
            return [("deviceStopped", last)] * was + [("deviceMoving", last), ("deviceStopped", r)]
        if not self.streak:
            if _metres(self.event, r) < self.d:
                return []
            self.streak = True
            return [("deviceMoving", self._began(r))]
        if any(_metres(p, r) >= self.d for p in self.q) or self._fast(_metres(last, r), gap) or r.fix_ms - self.q[0].fix_ms < self.t:
            return []
        self.streak = False
        return [("deviceStopped", r)]

    def _began(self, r):
        """Back from r, whose own leg may be slow, over fast legs, but not to the last event."""
        began = r
        for p in reversed(self.q):
            if p.fix_ms <= self.event.fix_ms or (began is not r and not self._fast(_metres(p, began), began.fix_ms - p.fix_ms)):
                break
            began = p
        return began


class MotionV2:
    """UNKNOWN, MOVING, PAUSED, STOPPED by quality, gaps, Doppler speed and steps; an event per change of state.

    Rows that are not valid, off the globe or at (0, 0) move the time on but leave the place; the step of the next row
    counts from the last place that was taken.
    """

    needs = ["valid", "speed", "quality", "latitude", "longitude"]

    def __init__(self, gap_s=300, stable_s=45, speed_mps=0.5, step_m=50, moving=False):
        self.gap, self.stable, self.v, self.far = gap_s * 1000, stable_s, speed_mps, step_m
        self.state, self.pause, self.ms, self.place = "UNKNOWN", 0, 0, None

    def decide(self, r) -> list[tuple]:
        state = self._next(r)
        if state == self.state:
            return []
        self.state = state
        return [(state, r)]

    def _next(self, r) -> str:
        ms, before, place = self.ms, r.fix_ms - self.ms, self.place
        if not r.valid or not (abs(r.latitude) <= 90 and abs(r.longitude) <= 180) or max(abs(r.latitude), abs(r.longitude)) < 1e-9:
            self.ms = r.fix_ms
            return "UNKNOWN"
        if ms and before <= 0:
            return "UNKNOWN"
        self.ms, self.place = r.fix_ms, r
        if (ms and before > self.gap) or r.quality != "GOOD":
            return "UNKNOWN"
        step = _metres(place, r, 6_371_000.0) if ms and place is not None else None
        quiet = r.speed / KNOTS["mps"] < self.v and (step is None or step / (before / 1000) < self.v)
        if self.state in ("PAUSED", "STOPPED"):
            if step is not None and step > self.far:
                return "MOVING"
            return "STOPPED" if (r.fix_ms - self.pause) // 1000 >= self.stable else self.state
        if quiet:
            self.pause = r.fix_ms
        return "PAUSED" if quiet else "MOVING"


class Told:
    """The events of a motion algorithm as rows of EVENTS."""

    def __init__(self, motion):
        self.motion = motion

    def step(self, r) -> list[tuple]:
        return [(r.device_id, kind, p.id, p.fix_ms) for kind, p in self.motion.decide(r)]

    def finish(self) -> list[tuple]:
        return []


class Spans:
    """Trips, or stops: from each event of one kind to the next of the other. The first row opens one if it does what is asked
    for, and the last row ends one that is open. A span's top speed is that since the event before the one that ends it."""

    def __init__(self, motion: Callable, trips: bool, fields: list[str]):
        self.motion, self.trips, self.fields = motion, trips, fields
        self.fold = self.open = self.last = None
        self.top = 0.0

    def step(self, r) -> list[tuple]:
        if self.fold is None:
            self.fold = self.motion(moving=bool(r.motion))
            self.open = r if bool(r.motion) == self.trips else None
        self.last, self.top = r, max(self.top, r.speed)
        out, made = [], self.fold.decide(r)
        for kind, p in made:
            if (kind == "deviceMoving") == self.trips:
                self.open = p
            elif self.open is not None:
                out.append(self._span(self.open, p))
                self.open = None
        if made:
            self.top = 0.0
        return out

    def _span(self, a, b) -> tuple:
        return (a.device_id, a.id, a.fix_ms, b.id, b.fix_ms, self.top, *[getattr(x, f) for f in self.fields for x in (a, b)])

    def finish(self) -> list[tuple]:
        return [self._span(self.open, self.last)] if self.open is not None else []


class LastAccepted:
    """The filters that look at the last accepted position, and those that don't, together: a row per position with the
    names of the filters that drop it, joined by commas, and "" where it stays and is the last accepted one from then on.

    r has `keys`, the names of its attributes, and `own`, the names of the filters without look-back that drop it. A filter that
    is 0 or false is off. Duplicate, Static and Distance give way where the server waited over skip_limit_s for the row or it has one
    of skip_keys; `exempt` rows pass everything.
    """

    def __init__(self, min_distance_m=0.0, max_speed_kn=0.0, min_period_s=0, duplicates=False, daily_limit=0, daily_interval_s=None, skip_limit_s=0, skip_keys=()):
        self.near, self.fast, self.period, self.same = min_distance_m, max_speed_kn, min_period_s * 1000, duplicates
        self.limit, self.wait, self.skip, self.skip_keys = daily_limit, daily_interval_s, skip_limit_s * 1000, set(skip_keys)
        self.last, self.day, self.count = None, None, 0

    def _names(self, r) -> list[str]:
        last, names = self.last, set(r.own.split(",")) - {""}
        dt = r.fix_ms - last.fix_ms if last is not None else None
        if last is not None:
            metres = _metres(last, r)
            names |= {
                n for n, hit in (
                    ("Duplicate", self.same and dt == 0 and set(r.keys) <= set(last.keys)), ("Distance", self.near and metres < self.near),
                    ("MaxSpeed", self.fast and dt > 0 and metres / (dt / 1000) * KNOTS["mps"] > self.fast), ("MinPeriod", 0 < dt < self.period),
                ) if hit
            }
        if self.limit and self.count >= self.limit and (self.wait is None or r.fix_ms - (last.fix_ms if last is not None else 0) < self.wait * 1000):
            names.add("DailyLimit")
        waited = self.skip and last is not None and r.server_ms - last.server_ms > self.skip
        if waited or not self.skip_keys.isdisjoint(r.keys):
            names -= {"Duplicate", "Static", "Distance"}
        return sorted(names)

    def step(self, r) -> list[tuple]:
        if r.fix_ms // 86_400_000 != self.day:
            self.day, self.count = r.fix_ms // 86_400_000, 0
        names = [] if r.exempt else self._names(r)
        if not names:
            self.last, self.count = r, self.count + 1 if self.limit else 0
        return [(r.device_id, r.id, r.fix_ms, ",".join(names))]

    def finish(self) -> list[tuple]:
        return []


class Decimate:
    """Keeps the first and last point, and points metres or seconds away from the last kept one."""

    def __init__(self, metres=12.0, seconds=120):
        self.m, self.ms, self.kept, self.last = metres, seconds * 1000, None, None

    def step(self, r) -> list[tuple]:
        self.last = r
        if self.kept is None or _metres(self.kept, r) >= self.m or r.fix_ms - self.kept.fix_ms >= self.ms:
            self.kept = r
            return [(r.device_id, r.id, r.fix_ms)]
        return []

    def finish(self) -> list[tuple]:
        return [(self.last.device_id, self.last.id, self.last.fix_ms)] if self.last is not None and self.last.id != self.kept.id else []


ALGORITHMS = {"old": OldMotion, "new": NewMotion, "v2": MotionV2}


def motion_events(df: DataFrame, algorithm: str = "old", **options) -> DataFrame:
    kind = ALGORITHMS[algorithm]
    return ordered_fold(df.select("device_id", "id", "fix_ms", *kind.needs), "device_id", ["fix_ms", "id"], lambda: Told(kind(**options)), EVENTS)


def motion_spans(df: DataFrame, trips: bool, fields: list[str], algorithm: str = "old", **options) -> DataFrame:
    """device_id, start_id, start_ms, end_id, end_ms, max_speed, and start_ and end_ of fields: trips or stops of each device."""
    kind = ALGORITHMS[algorithm]
    names = list(dict.fromkeys(["motion", "speed", *kind.needs, *fields]))
    types = dict(df.dtypes)
    schema = "device_id long, start_id long, start_ms long, end_id long, end_ms long, max_speed double" + "".join(f", {x}_{f} {types[f]}" for f in fields for x in ("start", "end"))
    return ordered_fold(df.select("device_id", "id", "fix_ms", *names), "device_id", ["fix_ms", "id"], lambda: Spans(partial(kind, **options), trips, fields), schema)


#: Attributes that a position has where they are not null.
KEYS = ["alarm", "fuel", "ignition", "driver_unique_id"]


def judged(df: DataFrame, own: dict[str, Column] | None = None, exempt: Column | None = None, keys: list[str] = KEYS, **options) -> DataFrame:
    """device_id, id, fix_ms, filters: what LastAccepted says of each position. own: filter name -> condition without look-back."""
    named = F.array_join(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in (own or {}).items()]), ",")
    has = F.filter(F.array(*[F.when(F.col(k).isNotNull(), k) for k in keys]), lambda x: x.isNotNull())
    rows = df.select("device_id", "id", "fix_ms", "server_ms", "latitude", "longitude", named.alias("own"), has.alias("keys"), F.coalesce(exempt if exempt is not None else F.lit(False), F.lit(False)).alias("exempt"))
    return ordered_fold(rows, "device_id", ["fix_ms", "id"], lambda: LastAccepted(**options), "device_id long, id long, fix_ms long, filters string")


def accepted(df: DataFrame, **options) -> DataFrame:
    """Positions that judged() keeps."""
    return judged(df, **options).where("filters = ''").drop("filters")


def decimated(df: DataFrame, **options) -> DataFrame:
    return ordered_fold(df.select("device_id", "id", "fix_ms", "latitude", "longitude"), "device_id", ["fix_ms", "id"], lambda: Decimate(**options), "device_id long, id long, fix_ms long")
