"""Unit conversions on columns. Factors are fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import Column

KNOTS = {"kph": 0.539957, "mph": 0.868976, "mps": 1.94384, "cps": 0.0194384449}
METRES = {"ft": 0.3048, "mi": 1609.34}
MILLIS = {"hours": 3_600_000, "minutes": 60_000, "seconds": 1_000}


def to_knots(x: Column, unit: str) -> Column:
    return x * KNOTS[unit]


def from_knots(x: Column, unit: str) -> Column:
    return x / KNOTS[unit]


def to_metres(x: Column, unit: str) -> Column:
    return x * METRES[unit]


def from_metres(x: Column, unit: str) -> Column:
    return x / METRES[unit]


def to_millis(x: Column, unit: str) -> Column:
    return x * MILLIS[unit]
