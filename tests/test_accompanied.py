"""Motion without company, and summaries by odometer and fuel rules."""

from pyspark.sql import functions as F

from roadtrace.operators import events, reports

COLUMNS = "device_id long, id long, fix_ms long, latitude double, longitude double, motion boolean"


def alone(spark, rows, links):
    df = spark.createDataFrame([(d, i, i * 1000, la, 0.0, m) for d, i, la, m in rows], COLUMNS)
    return sorted(r.position_id for r in events.unaccompanied(df, spark.createDataFrame(links, "device_id long, linked_id long"), 1000).collect())


def test_motion_with_and_without_company(spark):
    near, far = (2, 1, 10.001, False), (3, 2, 20.0, False)
    begins = [(1, 3, 10.0, False), (1, 4, 10.0, True), (1, 5, 10.0, True)]
    assert alone(spark, [near, far, *begins], [(1, 2), (1, 3)]) == []
    assert alone(spark, [near, far, *begins], [(1, 3)]) == [4]
    assert alone(spark, [near, far, *begins], [(1, 9), (1, 9)]) == [4]  # a linked device that never sent
    assert alone(spark, [near, far, *begins], [(2, 1)]) == []  # no links of its own
    assert alone(spark, [far, *begins, (2, 6, 10.0, False)], [(1, 2)]) == [4]  # company comes later
    assert alone(spark, [(1, 1, 10.0, True), (1, 2, 10.0, True)], [(1, 2)]) == []  # no position before


def test_summary_rules(spark):
    rows = [(1, 1, 0, 1.0, 5, 0, 100.0, 9.0, 1.0, 50.0), (1, 2, 3_600_000, 2.0, 5000, 3_600_000, 1100.0, 4.0, None, 40.0)]
    df = spark.createDataFrame(rows, "device_id long, id long, fix_ms long, speed double, total_mm long, hours_ms long, odometer double, fuel double, fuel_used double, fuel_level double")
    by = lambda d, **o: reports.summary(d, ["device_id"], **o).first()
    assert (by(df).distance, by(df).spent_fuel, by(df, ignore_odometer=True).distance) == (1000.0, 5.0, 4.995)
    assert by(df.withColumn("odometer", F.when(F.col("id") == 2, 7.0).otherwise(0.0))).distance == 4.995
    assert by(df.withColumn("fuel_used", F.col("id") * 2.0)).spent_fuel == 2.0
    level = df.drop("fuel").withColumn("tank", F.lit(60.0))
    assert (by(level).spent_fuel, by(level, capacity="tank").spent_fuel) == (0.0, 6.0)
