"""Two tables in one commit: broken attempts aren't seen, and replays change nothing."""

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import request
from roadtrace.sources import adapter
from roadtrace.streaming import commits, live

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_broken_attempts_are_not_seen(spark, tmp_path):
    path = str(tmp_path)
    rows, broken = spark.range(5), spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    assert ids(commits.read(spark, path, "a", "id long")) == []
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, path, 0, {"a": rows, "b": broken})
    assert ids(commits.read(spark, path, "a", "id long")) == ids(commits.read(spark, path, "b", "id long")) == []
    assert commits.commit(spark, path, 0, {"a": rows, "b": rows})
    assert not commits.commit(spark, path, 0, {"a": rows, "b": broken})
    assert commits.commit(spark, path, 1, {"a": spark.range(7, 8), "b": rows.where("false")})
    assert ids(commits.read(spark, path, "a", "id long")) == [0, 1, 2, 3, 4, 7] and ids(commits.read(spark, path, "b", "id long")) == [0, 1, 2, 3, 4]


def test_stream_killed_between_tables(spark, tmp_path):
    """Batch 1 breaks after its positions were written, and before its ledger; the restarted stream gives what a batch job gives."""
    df = adapter.positions(spark, SF).withColumn("total_mm", F.col("id")).select(*[c.split()[0] for c in live.POSITION.split(", ")])
    for k in range(5):
        df.where(F.floor(F.col("id") * 5 / 1001) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, calls = str(tmp_path / "out"), []

    def outcomes(batch):
        calls.append(1)
        message = F.raise_error(F.lit("killed")).cast("string") if len(calls) == 2 else F.lit("accepted")
        return batch.select("id", message.alias("outcome"))

    def start():
        stream = spark.readStream.schema(live.POSITION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        write = commits.positions_and_ledger(out, live.POSITION, outcomes, merge_every=2)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    with pytest.raises(Exception, match="killed"):
        start()
    assert len(ids(commits.read(spark, out, "positions", live.POSITION))) == len(ids(commits.read(spark, out, "ledger", "id long, outcome string"))) < df.count()
    start()
    assert ids(commits.read(spark, out, "positions", live.POSITION)) == ids(commits.read(spark, out, "ledger", "id long, outcome string")) == ids(df)
    want = {(r.device_id, r.id) for r in request.latest(df).collect()}
    assert {(r.device_id, r.id) for r in commits.latest_state(spark, out, live.POSITION).collect()} == want
    assert commits.read(spark, out, "base", live.POSITION).select("epoch").distinct().count() == 2
