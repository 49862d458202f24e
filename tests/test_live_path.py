"""The live path gives, file by file, what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import events, folds, pipeline
from roadtrace.sources import adapter
from roadtrace.streaming import path

SF = "/root/testdata/sf0.001"
FILTERS, LIMIT = {"min_distance_m": 30}, 20.0


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", path.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def ran(spark, tmp_path, files, name, **options):
    for k, df in enumerate(files):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(path.POSITION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = path.live_path(stream, adapter.geofences(spark), **options)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    return spark.table(name)


def told(df, *kinds):
    return sorted((r.device_id, r.type, r.position_id, r.event_ms, r.value) for r in df.where(F.col("type").isin(*kinds)).collect())


def wanted(df, value=None):
    value = F.col(value).cast("long") if value else F.lit(None).cast("long")
    return sorted(tuple(r) for r in df.select("device_id", "type", "position_id", "event_ms", value).collect())


def test_equals_the_batch(rocks, tmp_path):
    df = adapter.positions(rocks, SF).select(*[c.split()[0] for c in path.POSITION.split(", ")])
    got = ran(rocks, tmp_path, [df.where(F.floor(F.col("id") * 3 / 1001) == k) for k in range(3)], "path_all", filters=FILTERS, limit_kn=LIMIT, silent_s=120).cache()
    kept = folds.accepted(df.withColumns({k: F.lit(None).cast("string") for k in folds.KEYS if k not in df.columns}), **FILTERS)
    rows = adapter.with_distance(df.join(kept.select("id"), "id", "left_semi")).cache()
    assert 0 < rows.count() < df.count()
    at = rows.select("device_id", F.lit("accepted").alias("type"), F.col("id").alias("position_id"), F.col("fix_ms").alias("event_ms"), "total_mm")
    assert told(got, "accepted") == wanted(at, "total_mm")
    assert told(got, "deviceMoving", "deviceStopped") == wanted(folds.motion_events(rows)) != []
    assert told(got, "deviceOverspeed") == wanted(events.overspeed(rows, F.lit(LIMIT)).withColumn("type", F.lit("deviceOverspeed"))) != []
    assert told(got, "geofenceEnter", "geofenceExit") == wanted(events.geofence(pipeline.tagged(rows, adapter.geofences(rocks)), rows), "geofence_id") != []
    keeps, inner, ends = {r.id for r in rows.collect()}, set(), {}
    for r in df.orderBy("device_id", "fix_ms", "id").collect():
        d, last = r.device_id, ends.get(r.device_id)
        if last and r.fix_ms - last[0] >= 120_000:
            inner.add((d, *last[1]))
        ends[d] = (r.fix_ms, (r.id, r.fix_ms) if r.id in keeps else last[1])
    quiet = [(d, i, t) for d, _, i, t, _ in told(got, "deviceInactive")]
    assert inner and inner <= set(quiet) <= inner | {(d, *last) for d, (_, last) in ends.items()} and len(quiet) == len(set(quiet))
    assert got.where("type = 'late'").count() == 0 and got.where("type = 'dropped'").count() == df.count() - rows.count()


M = 60_000


def one(spark, *rows):
    """Rows (id, minute, latitude, speed, motion) of device 1."""
    return spark.createDataFrame([(1, i, m * M, m * M, float(la), 1.0, float(v), mo, True) for i, m, la, v, mo in rows], path.POSITION)


def test_stored_devices_late_rows_and_silence(rocks, tmp_path):
    """A stored device goes on where it was: its trip ends by the gap, its geofence is left, its distance grows. Device 2 has sent nothing since."""
    stored = rocks.createDataFrame([(1, 5, 0, 0, 40.001, -3.701, 7000, True, [1]), (2, 6, 0, 0, 1.0, 1.0, 0, False, None)], path.STORED)
    files = [one(rocks, (10, 20, 10, 0, False)), one(rocks, (11, 100, 10, 0, False), (12, 19, 10, 0, False)), one(rocks, (13, 200, 10, 0, False))]
    for f in files:  # one file a batch, in this order
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = rocks.readStream.schema(path.POSITION).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = path.live_path(stream, adapter.geofences(rocks), stored, silent_s=3600)
    q = out.writeStream.format("memory").queryName("path_stored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    rows = [(r.device_id, r.type, r.position_id, r.event_ms) for r in rocks.table("path_stored").collect()]
    assert (1, "deviceStopped", 5, 0) in rows and (1, "geofenceExit", 10, 20 * M) in rows and (1, "late", 12, 19 * M) in rows
    assert min(r.value for r in rocks.table("path_stored").where("type = 'accepted'").collect()) > 7000
    assert (2, "deviceInactive", 6, 0) in rows and rows.count((2, "deviceInactive", 6, 0)) == 1
    assert (1, "deviceInactive", 11, 100 * M) in rows and not any(t == "deviceInactive" and i == 5 for _, t, i, _ in rows)
