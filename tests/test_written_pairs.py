"""Rows for each user of a device: all of them, in an order in which files hold a row in a small part of a byte."""

import os

import pytest
from pyspark.sql import functions as F

from roadtrace.operators import hierarchy, reports

USERS, DEVICES, PLACES = 3_000, 4_000, 5
PAIRS = USERS // PLACES * DEVICES


@pytest.fixture(scope="module")
def access(spark):
    groups = spark.range(PLACES).select("id", F.lit(None).cast("long").alias("group_id"))
    devices = spark.range(DEVICES).select("id", (F.col("id") % PLACES).alias("group_id"))
    users = spark.range(USERS).select(F.col("id").alias("user_id"), (F.col("id") % PLACES).alias("group_id"))
    return hierarchy.access(spark.createDataFrame([(1, 1)], "user_id long, device_id long"), users, groups, devices)


def written(df, folder):
    """df as read from files, and their bytes."""
    df.write.parquet(f"{folder}/out")
    return df.sparkSession.read.parquet(f"{folder}/out"), sum(x.stat().st_size for x in os.scandir(f"{folder}/out") if x.name.endswith(".parquet"))


def test_pairs(access, tmp_path):
    got, size = written(access.pairs(), tmp_path)
    assert got.count() == got.distinct().count() == PAIRS
    assert not got.where(F.col("user_id") % PLACES != F.col("device_id") % PLACES).count()
    assert size < 0.25 * PAIRS


def test_notifications(spark, access, tmp_path):
    """Of each device's three events one is told in two ways, one in one and one not at all."""
    alarm = F.element_at(F.array(F.lit("sos"), F.lit("tow"), F.lit("jam")), (F.col("id") % 3 + 1).cast("int"))
    events = spark.range(3 * DEVICES).select((F.col("id") % DEVICES).alias("device_id"), F.col("id").alias("position_id"), F.lit("alarm").alias("type"), alarm.alias("alarm_type"))
    rules = spark.createDataFrame([(1, "alarm", "sos", "web,mail"), (2, "alarm", "fault,tow", "sms")], "notification_id int, type string, alarms string, notificators string")
    got, size = written(reports.notifications(events, rules, access), tmp_path)
    assert got.distinct().count() == 3 * PAIRS
    assert {tuple(r) for r in got.groupBy("notification_id", "notificator").count().collect()} == {(1, "web", PAIRS), (1, "mail", PAIRS), (2, "sms", PAIRS)}
    assert not got.where(F.col("user_id") % PLACES != F.col("position_id") % DEVICES % PLACES).count()
    assert size < 0.25 * 3 * PAIRS
