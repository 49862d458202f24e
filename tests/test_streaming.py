"""Streaming operators give what the batch ones give, fed file by file."""

from pyspark.sql import functions as F

from roadtrace.operators import events, folds
from roadtrace.sources import adapter
from roadtrace.streaming import live

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, build, mode="append"):
    df = adapter.with_distance(adapter.positions(spark, SF)).select("id", "device_id", "fix_ms", "server_ms", "speed", "motion", "total_mm", "ignition")
    for k in range(3):  # in time order, one file a batch
        df.where(F.floor(F.col("id") * 3 / 1001) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.POSITION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName("live_" + tmp_path.name.replace("-", "_")).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df, spark.table("live_" + tmp_path.name.replace("-", "_"))


def as_set(df):
    return {tuple(r) for r in df.select("device_id", "position_id", "event_ms").collect()}


def test_old_motion(spark, tmp_path):
    df, out = run(spark, tmp_path, live.old_motion)
    assert as_set(out) == as_set(folds.motion_events(df)) != set()


def test_overspeed(spark, tmp_path):
    df, out = run(spark, tmp_path, lambda s: live.overspeed(s, 20, 15))
    assert as_set(out) == as_set(events.overspeed(df, F.lit(20.0), 15)) != set()


def test_once(spark, tmp_path):
    df, out = run(spark, tmp_path, lambda s: live.once(s.union(s), ["id"]).select("id"))
    assert out.count() == df.count()


def test_inactivity(spark, tmp_path):
    """Sessions of two minutes close once the watermark, ten minutes behind the last row that has been seen, has passed them."""
    df, out = run(spark, tmp_path, lambda s: live.inactivity(s, "2 minutes"))
    rows = {}
    for r in df.orderBy("device_id", "fix_ms").collect():
        ends = rows.setdefault(r.device_id, [])
        if ends and r.fix_ms - ends[-1] < 120_000:
            ends[-1] = r.fix_ms
        else:
            ends.append(r.fix_ms)
    last = max(r.fix_ms for r in df.collect())
    before = max(r.fix_ms for r in df.where("id * 3 < 2002").collect())  # when the last file came
    closed = lambda mark: {(d, t) for d, ends in rows.items() for t in ends if t + 120_000 < mark - 600_000}
    got = {tuple(r) for r in out.collect()}
    assert got and closed(before) <= got <= closed(last + 1)


def test_reordered(spark, tmp_path):
    """Each device's positions come in order, once the watermark has passed them, and none twice."""
    df, out = run(spark, tmp_path, live.reordered)
    rows, last = df.collect(), max(r.fix_ms for r in df.collect())
    got = out.collect()
    before = max(r.fix_ms for r in df.where("id * 3 < 2002").collect())
    passed = lambda mark: {r.id for r in rows if r.fix_ms < mark - 600_000}
    assert len(got) == len({r.id for r in got}) and passed(before) <= {r.id for r in got} <= passed(last + 1) != set()
    at = {}
    for r in got:
        assert at.get(r.device_id, 0) <= r.fix_ms
        at[r.device_id] = r.fix_ms


def test_ledger_rejects_conflicts(spark, tmp_path):
    message = lambda s: s.selectExpr("cast(id div 3 as string) as message_id", "id", "device_id % 1 as device_id", "id div 3 as sequence", "if(id % 3 = 2 and id % 2 = 0, 'x', 'y') as payload")
    df, out = run(spark, tmp_path, lambda s: live.ledger(message(s)))
    first, want = {}, {}
    for r in message(df).orderBy("id").collect():
        h = (r.device_id, r.sequence, r.payload)
        want[r.id] = "accepted" if r.message_id not in first else "duplicate" if first[r.message_id] == h else "rejected"
        first.setdefault(r.message_id, h)
    assert {r.id: r.outcome for r in out.collect()} == want and set(want.values()) == {"accepted", "duplicate", "rejected"}


def test_sliding_and_daily_counts(spark, tmp_path):
    df, out = run(spark, tmp_path, live.sliding_counts, "complete")
    want = {}
    for r in df.collect():
        for start in (r.fix_ms // 300_000 * 300_000, r.fix_ms // 300_000 * 300_000 - 300_000):
            want[r.device_id, start] = want.get((r.device_id, start), 0) + 1
    assert {(r.device_id, round(r.s * 1000)): r.messages for r in out.selectExpr("device_id", "cast(window.start as double) s", "messages").collect()} == want
