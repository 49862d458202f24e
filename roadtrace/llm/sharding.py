"""Sharding: rendezvous (highest random weight) hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BITS = 52


def draw(key: Column, shard: int) -> Column:
    """A stable number in [0, 2^52) for a key and a shard: the first 13 hex digits of md5('key:shard')."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(shard)))), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float], draws: Column | None = None) -> Column:
    """The shard, 0 to len(weights) - 1, that wins a key: the largest -weight / ln(draw); ties go to the smaller shard.

    With equal weights the largest draw wins. Depends on the key and the weights alone, so a shard that is added takes
    keys only into itself, and one that is removed gives away only its own. A null key counts as the empty string.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    d = draws if draws is not None else F.array(*[draw(key, i) for i in range(len(weights))])
    if len(set(weights)) == 1:
        scored = F.slice(d, 1, len(weights))
    else:
        scored = F.transform(d, lambda x, i: -F.element_at(F.array(*map(F.lit, map(float, weights))), i + 1) / F.log((x + 0.5) / float(1 << BITS)))
    return (F.array_position(scored, F.array_max(scored)) - 1).cast("int")


def assign(docs: DataFrame, weights: list[float], grown: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of docs.

    slot numbers a shard's rows without gaps from 0, in the order of md5('key:crc'), key and size. Rows are numbered
    within (shard, bucket), where the bucket is a leading part of that md5, and shifted by the counts of the buckets
    before, so no task holds a shard. Null or repeated keys go where their key goes; a null text has size 1 and CRC 0.
    Rows that are equal in key and text are interchangeable. An empty table gives an empty one.
    """
    n = max(len(weights), len(grown))
    base = docs.select(F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    base = base.withColumn("d", F.array(*[draw(F.col("doc_id"), i) for i in range(n)]))
    base = base.select("doc_id", "size", "text_crc32", rendezvous(F.col("doc_id"), weights, F.col("d")).alias("shard"), rendezvous(F.col("doc_id"), grown, F.col("d")).alias("grown_shard"))
    base = base.withColumn("o", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"))))
    # 3 hex digits: 4096 buckets a shard, each a 65,536th of the rows at 16 shards.
    base = base.withColumn("bucket", F.substring("o", 1, 3))
    counts = base.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("shift"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("o", F.col("doc_id").asc_nulls_first(), "size")) - 1
    return base.withColumn("within", within).join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("within") + F.col("shift")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """Writes docs as Parquet under path/shard=N/. Large shards are written by several tasks."""
    docs.withColumn("shard", rendezvous(F.col(key), weights)).write.partitionBy("shard").parquet(path)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)


_DRAWS = ", ".join(f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{i}'), 1, 13) AS BIGINT)" for i in range(17))
# CRC-32 (polynomial 0xEDB88320) byte by byte, with its table made by the usual eight shifts.
OP9_SQL = f"""
WITH c AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
           FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
x AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, [{_DRAWS}] AS d,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT))),
            lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, c),
s AS (SELECT *, list_position(d[1:16], list_max(d[1:16])) - 1 AS shard, list_position(d, list_max(d)) - 1 AS grown_shard FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(crc AS VARCHAR)), doc_id NULLS FIRST, size) - 1 AS BIGINT) AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM s
"""
