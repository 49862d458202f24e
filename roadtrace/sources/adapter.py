"""The telemetry model over the star-schema and events tables.

Times are epoch milliseconds. `positions` is a deterministic walk per user of `events`; groups, devices, users and links
come from region, nation, customer, supplier and lineitem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START_MS = 1_704_067_200_000  # 2024-01-01 UTC
HOUR, DAY = 3_600_000, 86_400_000

#: id, name, area; circles have a radius in metres, lines a reach of 400 m.
GEOFENCES = [
    (1, "depot", "CIRCLE (40.001 -3.701, 600)"),
    (2, "yard", "CIRCLE (39.99 -3.71, 1500)"),
    (3, "port", "CIRCLE (40.02 -3.68, 900)"),
    (4, "centre", "POLYGON ((39.995 -3.705, 39.995 -3.695, 40.005 -3.695, 40.005 -3.705))"),
    (5, "south", "POLYGON ((39.95 -3.75, 39.95 -3.65, 39.985 -3.7))"),
    (6, "road", "LINESTRING (39.98 -3.72, 40 -3.7, 40.02 -3.72)"),
]
LINE_M = 400.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_time(*more: str) -> Window:
    """The order in which a device's positions are handled."""
    return Window.partitionBy("device_id").orderBy("fix_ms", "id", *more)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    still = F.col("event_type").isin("error", "signup")
    step = lambda a, b, c: F.when(still, 0).otherwise(F.col("event_id") * a % b - c)
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select(
        (F.col("event_id") + 1).alias("id"), F.col("user_id").alias("device_id"),
        F.element_at(F.array(F.lit("osmand"), F.lit("h02"), F.lit("mobile")), (F.col("event_id") % 3 + 1).cast("int")).alias("protocol"),
        (F.col("event_id") * 2000 + START_MS).alias("fix_ms"),
        (F.col("event_id") * 2000 + START_MS + F.col("event_id") * 7919 % 600 * 1000).alias("server_ms"),
        (40 + F.sum(step(37, 101, 50)).over(w) / 10000.0).alias("latitude"), (-3.7 + F.sum(step(53, 103, 51)).over(w) / 10000.0).alias("longitude"),
        F.col("k").cast("double").alias("altitude"), (F.col("event_id") * 13 % 360).cast("double").alias("course"), (F.col("event_id") * 31 % 150).cast("double").alias("accuracy"),
        F.when(still, 0.0).otherwise(F.least("value", F.lit(120.0))).alias("speed"), (F.col("event_type") != "error").alias("ignition"),
        F.when(F.col("event_type") == "purchase", "sos").when(F.col("event_type") == "error", "fault,lowBattery").alias("alarm"),
        F.col("k").cast("double").alias("fuel"), F.concat(F.lit("D"), (F.col("user_id") % 7 + F.floor(F.col("k") / 50)).cast("string")).alias("driver_unique_id"),
        (~still & (F.col("value") > 0.01)).alias("motion"),
    )


def with_distance(df: DataFrame) -> DataFrame:
    """Adds distance_mm from the device's position before, and total_mm so far."""
    from ..functions.geo import distance_mm

    w = by_time()
    step = distance_mm(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return df.withColumn("distance_mm", F.coalesce(step, F.lit(0))).withColumn("total_mm", F.sum("distance_mm").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("group_id"))
    return top.union(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long"), "n_name", (F.col("n_regionkey") + 1000).cast("long")))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("group_id"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("balance"))


def user_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").cast("long").alias("group_id"))


def user_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, order = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("user_id"), F.col("o_custkey").alias("device_id")).distinct()


def geofences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GEOFENCES, "geofence_id long, name string, area string")


#: The same model as DuckDB common table expressions, for the oracles.
SQL = f"""base AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type IN ('error', 'signup') AS still FROM events),
p AS (SELECT event_id + 1 AS id, user_id AS device_id, ['osmand', 'h02', 'mobile'][CAST(event_id % 3 AS INT) + 1] AS protocol, event_id * 2000 + {START_MS} AS fix_ms,
  event_id * 2000 + {START_MS} + event_id * 7919 % 600 * 1000 AS server_ms,
  40 + CAST(sum(CASE WHEN still THEN 0 ELSE event_id * 37 % 101 - 50 END) OVER w AS DOUBLE) / 10000 AS latitude,
  -3.7 + CAST(sum(CASE WHEN still THEN 0 ELSE event_id * 53 % 103 - 51 END) OVER w AS DOUBLE) / 10000 AS longitude,
  CAST(k AS DOUBLE) AS altitude, CAST(event_id * 13 % 360 AS DOUBLE) AS course, CAST(event_id * 31 % 150 AS DOUBLE) AS accuracy,
  CASE WHEN still THEN 0 ELSE least(value, 120) END AS speed, event_type <> 'error' AS ignition,
  CASE event_type WHEN 'purchase' THEN 'sos' WHEN 'error' THEN 'fault,lowBattery' END AS alarm, CAST(k AS DOUBLE) AS fuel,
  'D' || CAST(user_id % 7 + k // 50 AS VARCHAR) AS driver_unique_id, NOT still AND value > 0.01 AS motion
  FROM base WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
grp AS (SELECT r_regionkey + 1000 AS id, r_name AS name, CAST(NULL AS BIGINT) AS group_id FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey + 1000 FROM nation),
dev AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS group_id, c_mktsegment AS category, c_acctbal AS balance FROM customer),
ug AS (SELECT s_suppkey AS user_id, s_nationkey AS group_id FROM supplier),
ud AS (SELECT DISTINCT l_suppkey AS user_id, o_custkey AS device_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def sql_haversine(a: str, b: str, c: str, d: str, radius: float = 6_378_137.0) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * atan2(sqrt({h}), sqrt(1 - {h})) * {radius})"


SQL_DISTANCE = f"""d AS (SELECT *, CAST(sum(distance_mm) OVER (PARTITION BY device_id ORDER BY fix_ms, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_mm FROM (
  SELECT *, coalesce(CAST(round({sql_haversine("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")} * 1000) AS BIGINT), 0) AS distance_mm
  FROM p WINDOW w AS (PARTITION BY device_id ORDER BY fix_ms, id)))"""
