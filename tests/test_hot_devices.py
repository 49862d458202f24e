"""Folds over ranges of rows give what one walk over each device gives, wherever the ranges are cut."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import folds

COLUMNS = "device_id long, id long, fix_ms long, server_ms long, latitude double, longitude double, speed double, motion boolean, ignition boolean, total_mm long, distance_mm long, alarm string, fuel double, driver_unique_id string, valid boolean, quality string"


def ride(n, devices, seed):
    """Positions of which the first device has nine in ten: rides, stands, and gaps."""
    rng, rows, at = random.Random(seed), [], {}
    for i in range(n):
        d = 1 if rng.random() < 0.9 else rng.randrange(2, devices + 2)
        ms, la, total, moving = at.get(d, (0, 40.0, 0, False))
        moving = moving if rng.random() < 0.97 else not moving
        ms += 1000 * rng.choice([20, 30, 60, 60, 60, 1000 if rng.random() < 0.05 else 60])
        step = rng.choice([0, 100, 400]) if moving else 0
        la, total = la + step / 111_000, total + step * 1000
        at[d] = ms, la, total, moving
        rows.append((d, i, ms, ms + 1000, la, 1.0, float(step) / 10, moving, True, total, step * 1000, None, 1.0, None, True, "GOOD" if rng.random() < 0.95 else "POOR"))
    return rows


def plain(rows, state, needs):
    """One walk over each device, in plain Python."""
    names, out, by = [c.split()[0] for c in COLUMNS.split(", ")], [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        by.setdefault(r[0], []).append(SimpleNamespace(**{c: v for c, v in zip(names, r, strict=True)}))
    for of in by.values():
        s = state()
        for r in of:
            out += s.step(r)
        out += s.finish()
    return sorted(map(tuple, out))


@pytest.fixture
def cut(spark):
    """Small ranges: sixteen, none merged."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("algorithm", ["old", "new", "v2"])
def test_motion_of_a_hot_device(cut, algorithm):
    rows = ride(1500, 4, 1)
    got = sorted(map(tuple, folds.motion_events(cut.createDataFrame(rows, COLUMNS), algorithm).collect()))
    assert got == plain(rows, lambda: folds.Told(folds.ALGORITHMS[algorithm]()), None) != []


@pytest.mark.parametrize("trips", [True, False])
def test_spans_of_a_hot_device(cut, trips):
    rows = ride(1200, 3, 2)
    got = sorted(map(tuple, folds.motion_spans(cut.createDataFrame(rows, COLUMNS), trips, ["total_mm"]).collect()))
    assert got == plain(rows, lambda: folds.Spans(folds.OldMotion, trips, ["total_mm"]), None) != []


def test_filters_and_decimation_of_a_hot_device(cut):
    rows = ride(1200, 3, 3)
    df = cut.createDataFrame(rows, COLUMNS)
    got = sorted((r.device_id, r.id) for r in folds.decimated(df, metres=300, seconds=600).collect())
    assert got == sorted((d, i) for d, i, _ in plain(rows, lambda: folds.Decimate(300, 600), None)) != []
    for options in ({"min_distance_m": 150}, {"min_period_s": 100}, {"daily_limit": 50}):
        names = {i: f for _, i, _, f in plain([(*r[:11], None, *r[12:]) for r in rows], lambda o=options: Named(folds.LastAccepted(**o)), None)}
        assert {r.id: r.filters for r in folds.judged(df, **options).collect()} == names and len(set(names.values())) == 2


class Named:
    """The rows that judged() hands over, from whole positions."""

    def __init__(self, fold):
        self.fold = fold

    def step(self, r):
        r.own, r.exempt, r.keys = "", False, [k for k in folds.KEYS if getattr(r, k) is not None]
        return self.fold.step(r)

    def finish(self):
        return []


class Count:
    """Never forgets how it began, so each range waits for the one before it."""

    n = 0

    def step(self, r):
        self.n += 1
        return [(r.k, r.id, self.n)]

    def finish(self):
        return [(1 if self.n is None else -1, -1, self.n)]


def test_states_that_never_meet_null_keys_and_no_rows(cut):
    df = cut.range(400).select(F.when(F.col("id") % 10 != 0, F.lit(2**60 + 1)).when(F.col("id") % 20 == 0, 7).alias("k"), "id")
    got = [tuple(r) for r in folds.ordered_fold(df, "k", ["id"], Count, "k long, id long, n long").collect()]
    by = {}
    for k, i, n in got:
        if i >= 0:
            by.setdefault(k, []).append((i, n))
    assert {k: [n for _, n in sorted(v)] for k, v in by.items()} == {k: list(range(1, m + 1)) for k, m in ((2**60 + 1, 360), (7, 20), (None, 20))}
    assert sorted(n for k, i, n in got if i < 0) == [20, 20, 360]
    assert folds.ordered_fold(df.where("id < 0"), "k", ["id"], Count, "k long, id long, n long").collect() == []
