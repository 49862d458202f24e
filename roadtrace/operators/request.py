"""The request algebra: columns, conditions and an order, composed into one DataFrame query.

Filters and projections stay declarative, so Catalyst pushes them to the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def include(*names: str):
    return lambda df: df.select(*names)


def exclude(*names: str):
    return lambda df: df.drop(*names)


def equals(name: str, value) -> Column:
    return F.col(name) == F.lit(value)


def compare(name: str, op: str, value) -> Column:
    c, v = F.col(name), F.lit(value)
    return {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v, "=": c == v, "<>": c != v}[op]


def between(name: str, low, high) -> Column:
    """Both ends included."""
    return F.col(name).between(low, high)


def contains(names: list[str], keyword: str) -> Column:
    """Any column holds the keyword, whatever its case. `%` and `_` in the keyword are wildcards."""
    return reduce(Column.__or__, [F.lower(F.col(n)).like(f"%{keyword.lower()}%") for n in names])


def merge(conditions: list[Column]) -> Column | None:
    return reduce(Column.__and__, conditions) if conditions else None


@dataclass
class Order:
    """Positions ordered by fix time take the smaller id first among equals, also when descending."""

    name: str
    descending: bool = False
    limit: int | None = None
    offset: int | None = None
    tie: str | None = field(default=None)

    def apply(self, df: DataFrame) -> DataFrame:
        tie = self.tie or ("id" if self.name in ("fix_ms", "fix_time") else None)
        keys = [F.col(self.name).desc() if self.descending else F.col(self.name).asc()] + ([F.col(tie).asc()] if tie else [])
        df = df.orderBy(*keys)
        df = df.offset(self.offset) if self.offset else df
        return df.limit(self.limit) if self.limit is not None else df


def query(df: DataFrame, columns=None, condition: Column | None = None, order: Order | None = None) -> DataFrame:
    df = df if condition is None else df.where(condition)
    df = df if order is None else order.apply(df)
    return df if columns is None else columns(df)


def latest(df: DataFrame) -> DataFrame:
    """Each device's last position: largest fix time, then smallest id. One aggregation, no sort."""
    row = F.struct(*df.columns)
    return df.groupBy("device_id").agg(F.max_by(row, F.struct("fix_ms", -F.col("id"))).alias("r")).select("r.*")


def edge(df: DataFrame, last: bool) -> DataFrame:
    if last:
        return latest(df)
    return df.groupBy("device_id").agg(F.min_by(F.struct(*df.columns), F.struct("fix_ms", "id")).alias("r")).select("r.*")


def in_range(df: DataFrame, low: int, high: int, extra: bool = False) -> DataFrame:
    """Positions of the range; with extra, also each device's last one before it."""
    inside = df.where(between("fix_ms", low, high))
    return inside.unionByName(latest(df.where(F.col("fix_ms") < low))) if extra else inside
