"""Retries of forwarded messages: waits, dead letters, replays, and a stream whose receiver fails twice."""

import time

import pytest
from pyspark.sql import functions as F

from roadtrace.sources import adapter
from roadtrace.streaming import forward

SF = "/root/testdata/sf0.001"


def messages(spark, *ids):
    return spark.createDataFrame([(i, f"body {i}") for i in ids], forward.MESSAGE)


def failing(times):
    """A receiver that refuses the messages x... so many times."""
    return lambda df: df.withColumn("error", F.when(F.col("message_id").startswith("x") & (F.col("sent") < times), "down"))


def queue(spark, path):
    return sorted((r.message_id, r.sent, r.due_ms) for r in forward.waiting(spark, path).collect())


def test_waits_double_and_end(spark, tmp_path):
    path, send = str(tmp_path), failing(99)
    none = messages(spark, "x1").where("false")
    assert forward.forward(messages(spark, "x1", "a1", None), 0, path, send, 1000, retries=2)
    assert queue(spark, path) == [("x1", 1, 1100)]
    assert forward.forward(messages(spark, "a2"), 1, path, send, 1099, retries=2) and queue(spark, path) == [("x1", 1, 1100)]
    assert forward.forward(none, 2, path, send, 1100, retries=2) and queue(spark, path) == [("x1", 2, 1300)]
    assert forward.forward(none, 3, path, send, 1300, retries=2) and queue(spark, path) == []
    assert [tuple(r) for r in forward.dead(spark, path).collect()] == [("x1", "body x1", 2, "down", "retries")]
    assert sorted((r.message_id, r.sent_ms) for r in forward.delivered(spark, path).collect()) == [("a1", 1000), ("a2", 1099)]
    assert not forward.forward(messages(spark, "a3"), 2, path, send, 9999) and forward.delivered(spark, path).count() == 2


def test_no_more_than_so_many_wait(spark, tmp_path):
    path = str(tmp_path)
    forward.forward(messages(spark, "x3"), 0, path, failing(99), 1000, pending=2)
    forward.forward(messages(spark, "x1", "x2", "x4"), 1, path, failing(99), 1050, pending=2)
    assert queue(spark, path) == [("x1", 1, 1150), ("x3", 1, 1100)]
    assert sorted((r.message_id, r.reason) for r in forward.dead(spark, path).collect()) == [("x2", "pending"), ("x4", "pending")]


def test_lost_before_the_commit(spark, tmp_path):
    """A receiver that breaks off leaves the queue as it was; the same epoch then sends again."""
    path = str(tmp_path)
    forward.forward(messages(spark, "x1"), 0, path, failing(1), 0)
    broken = lambda df: df.withColumn("error", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        forward.forward(messages(spark, "a1"), 1, path, broken, 200)
    assert queue(spark, path) == [("x1", 1, 100)] and forward.delivered(spark, path).count() == 0
    assert forward.forward(messages(spark, "a1"), 1, path, failing(1), 200) and queue(spark, path) == []
    assert sorted((r.message_id, r.sent) for r in forward.delivered(spark, path).collect()) == [("a1", 0), ("x1", 1)]


def test_stream_whose_receiver_fails_twice(spark, tmp_path):
    """Four files a batch each; every third position is refused twice, and is there two batches later."""
    df = adapter.positions(spark, SF).where("id <= 120").selectExpr("concat(if(id % 3 = 0, 'x', 'a'), id) as message_id", "protocol as body", "id")
    for k in range(4):
        df.where(F.col("id") % 4 == k).select("message_id", "body").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ticks = iter(range(0, 10**6, 1000))
    stream = spark.readStream.schema(forward.MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write = forward.forwarder(str(tmp_path / "out"), failing(2), lambda: next(ticks))
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    done = {r.message_id: r.sent for r in forward.delivered(spark, str(tmp_path / "out")).collect()}
    left = forward.waiting(spark, str(tmp_path / "out")).collect()
    assert len(done) + len(left) == 120 and all(n == (2 if m[0] == "x" else 0) for m, n in done.items())
    assert len(left) == 20 and all(r.message_id[0] == "x" for r in left) and forward.dead(spark, str(tmp_path / "out")).count() == 0


def test_heartbeat_brings_retries(spark, tmp_path):
    messages(spark, "x1", "a1").write.parquet(str(tmp_path / "in"))
    stream = forward.with_heartbeat(spark.readStream.schema(forward.MESSAGE).parquet(str(tmp_path / "in")))
    out = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(forward.forwarder(out, failing(2), lambda: int(time.time() * 1000))).option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 90
    while time.time() < until and forward.delivered(spark, out).count() < 2:
        time.sleep(1)
    q.stop()
    assert {r.message_id: r.sent for r in forward.delivered(spark, out).collect()} == {"a1": 0, "x1": 2}
