"""Parsing and formatting: field patterns, bits, checksums, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dm_to_degrees(value: Column, hemisphere: Column) -> Column:
    """`DDMM.mmmm` or `DDDMM.mmmm` with its hemisphere letter to signed degrees."""
    v = value.cast("double")
    whole = F.floor(v / 100)
    return (whole + (v - whole * 100) / 60) * F.when(hemisphere.isin("S", "W"), -1).otherwise(1)


def bit(value: Column, index: int) -> Column:
    return F.shiftright(value, index).bitwiseAND(F.lit(1)) == 1


def bits(value: Column, low: int, high: int) -> Column:
    """Bits low to high - 1 of a long."""
    return F.shiftright(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def nmea_checksum(sentence: Column) -> Column:
    """Two hex digits: exclusive or of the bytes between `$` and `*`."""
    chars = F.filter(F.split(F.regexp_extract(sentence, r"^\$?([^*]*)", 1), ""), lambda c: c != "")
    return F.lpad(F.hex(F.aggregate(chars, F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))), 2, "0")


def byte_sum(hexed: Column, modulo: int = 256) -> Column:
    """Sum of the bytes of a hex text, modulo 256."""
    pairs = F.regexp_extract_all(hexed, F.lit("([0-9A-Fa-f]{2})"), F.lit(1))
    return F.aggregate(pairs, F.lit(0), lambda a, p: (a + F.conv(p, 16, 10).cast("int")) % modulo)


def canonical_hash(*fields: Column) -> Column:
    """SHA-256 in hex of the fields joined by `|`, nulls as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def rollout_bucket(unique_id: Column) -> Column:
    """0 to 99: the first two bytes of the id's SHA-256, big-endian, modulo 100."""
    return (F.conv(F.substring(F.sha2(unique_id, 256), 1, 4), 16, 10).cast("long") % 100).cast("int")


def version_key(version: Column) -> Column:
    """Dotted version as array<int>, which compares as versions do."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "warning", 2).when(severity == "info", 1).otherwise(0)


def cell_guard(cell: Column) -> Column:
    """Spreadsheet cells that would run as formulas become empty."""
    return F.when(cell.rlike(r"^[=+\-@]"), "").otherwise(cell)


def flexible_millis(text: Column) -> Column:
    """Epoch seconds (below 1e11), epoch milliseconds or an ISO time, as epoch milliseconds."""
    n = text.try_cast("double")
    return F.when(n.isNotNull(), F.when(F.abs(n) < 1e11, n * 1000).otherwise(n).cast("long")).otherwise(F.unix_millis(F.try_to_timestamp(text)))
