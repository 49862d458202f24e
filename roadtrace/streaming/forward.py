"""Forwarding with retries: what a receiver didn't take waits in a table, longer each time, and ends among the dead letters.

Each epoch sends its new messages and those that have come due, and commits what was delivered, what waits and what was given up
together. A process that is lost between sending and that commit sends the same messages again: at least once, and no wait lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import settled
from .commits import commit, committed, read

MESSAGE = "message_id string, body string"
#: sent: how often the message was sent before.
QUEUE = f"{MESSAGE}, sent int, due_ms long"
DELIVERED = "message_id string, sent int, sent_ms long"
DEAD = f"{MESSAGE}, sent int, error string, reason string"


def waiting(spark: SparkSession, path: str) -> DataFrame:
    """(QUEUE) of the messages that wait after the last committed epoch."""
    last = committed(spark, path).agg(F.max("epoch")).first()[0]
    return read(spark, path, "queue", QUEUE).where(F.col("epoch") == F.lit(-1 if last is None else last)).drop("epoch")


def delivered(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, "delivered", DELIVERED).drop("epoch")


def dead(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, "dead", DEAD).drop("epoch")


def forward(messages: DataFrame, epoch: int, path: str, send: Callable[[DataFrame], DataFrame], now_ms: int, delay_ms: int = 100, retries: int = 10, pending: int | None = None) -> bool:
    """One epoch for messages (MESSAGE); False, and nothing sent, if it was committed before. Epochs rise.

    send(rows with message_id, body and sent) adds `error`, null where the receiver took the row. A message that failed waits
    delay_ms, then twice as long each time; after so many retries it is dead for the reason `retries`. With `pending`, only so
    many wait, those due first (then by message_id), and the others are dead for the reason `pending`. message_id is one message's own;
    rows without one are left out.
    """
    spark = messages.sparkSession
    if not committed(spark, path).where(F.col("epoch") >= epoch).isEmpty():
        return False
    queue = waiting(spark, path)
    new = messages.select("message_id", "body", F.lit(0).alias("sent"))
    due = queue.where(F.col("due_ms") <= now_ms).select("message_id", "body", "sent")
    # Settled, so that the tables below don't send again.
    tried = settled(send(new.unionByName(due).where("message_id is not null")).select("message_id", "body", F.col("sent").cast("int").alias("sent"), F.col("error").cast("string").alias("error")))
    failed = tried.where("error is not null")
    again = failed.where(F.col("sent") < retries).withColumn("due_ms", F.lit(now_ms) + F.expr(f"shiftleft({int(delay_ms)}L, least(sent, 32))")).withColumn("sent", F.col("sent") + 1)
    wait = queue.where(F.col("due_ms") > now_ms).withColumn("error", F.lit(None).cast("string")).unionByName(again)
    gone = failed.where(F.col("sent") >= retries).withColumn("reason", F.lit("retries"))
    if pending is not None:
        stay = settled(wait.orderBy("due_ms", "message_id").limit(pending))
        over = wait.join(stay.select("message_id"), "message_id", "left_anti")
        gone, wait = gone.unionByName(over.select("message_id", "body", "sent", "error", F.lit("pending").alias("reason"))), stay
    return commit(spark, path, epoch, {
        "delivered": tried.where("error is null").select("message_id", "sent", F.lit(now_ms).cast("long").alias("sent_ms")),
        "queue": wait.select(*[c.split()[0] for c in QUEUE.split(", ")]), "dead": gone.select(*[c.split()[0] for c in DEAD.split(", ")]),
    })


def forwarder(path: str, send: Callable[[DataFrame], DataFrame], clock: Callable[[], int], **options) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer of forward(). clock() gives the time in milliseconds."""

    def write(batch: DataFrame, epoch: int) -> None:
        forward(batch, epoch, path, send, clock(), **options)

    return write


def with_heartbeat(stream: DataFrame) -> DataFrame:
    """A stream of MESSAGE with rows of null ids in between, so that batches run, and retries come due, also when nothing new comes."""
    beat = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return stream.select("message_id", "body").unionByName(beat.select(F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("body")))
