"""Several tables written as one: an epoch's rows are seen in all of them or in none, however often a batch is replayed.

A table's rows of an epoch lie in a folder of the attempt that wrote them. The attempt counts once its row is in the list of
commits, which is written last, as one file. Readers join tables to that list, so that what a broken attempt left is not seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "epoch long, attempt string"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows below path; an empty table of that schema where nothing was ever written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, attempt) of all that counts."""
    return _table(spark, f"{path}/commits", COMMIT).select("epoch", "attempt")


def commit(spark: SparkSession, path: str, epoch: int, tables: dict[str, DataFrame]) -> bool:
    """Writes the tables' rows of an epoch; False, and nothing done, if that epoch was committed before.

    One writer at a time, as a stream's batches are. A table may have any columns but epoch and attempt. When this fails, or the
    process is lost, before the list of commits has its row, the same call does it all again in folders of its own.
    """
    if not committed(spark, path).where(F.col("epoch") == epoch).isEmpty():
        return False
    attempt = f"a{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}/epoch={epoch}/attempt={attempt}")
    spark.createDataFrame([(epoch, attempt)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/of={epoch}")
    return True


def read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The committed rows of a table (schema: its columns), and their epoch."""
    rows = _table(spark, f"{path}/{name}", f"{schema}, {COMMIT}")
    return rows.join(committed(spark, path), ["epoch", "attempt"], "left_semi").drop("attempt")


def latest_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Each device's latest committed position: the last merged table and what epochs after it brought, so that old epochs aren't read again."""
    from ..operators.request import latest

    base = read(spark, path, "base", schema)
    at = base.agg(F.max("epoch")).first()[0]
    if at is None:
        return latest(read(spark, path, "latest", schema).drop("epoch"))
    return latest(base.where(F.col("epoch") == at).unionByName(read(spark, path, "latest", schema).where(F.col("epoch") > at)).drop("epoch"))


def positions_and_ledger(path: str, schema: str, outcomes: Callable[[DataFrame], DataFrame], merge_every: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: a batch's positions, the ledger rows that outcomes() makes of it, and the latest positions, in one commit.

    Every merge_every epochs, the latest positions so far are merged into one table, in the same commit.
    """
    from ..operators.request import latest

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*[c.split()[0] for c in schema.split(", ")]).persist()
        try:
            tables = {"positions": rows, "ledger": outcomes(batch), "latest": latest(rows)}
            if epoch and epoch % merge_every == 0:
                tables["base"] = latest(latest_state(spark, path, schema).unionByName(rows))
            commit(spark, path, epoch, tables)
        finally:
            rows.unpersist()

    return write
