"""Reading and writing of device fields: hex, BCD, signed magnitude, checksums, OBD, dates, areas, addresses, JSON, text frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import EQUATORIAL_M
from .text import dm_to_degrees


def hex_text(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def text_hex(hexed: Column) -> Column:
    """The text of its UTF-8 bytes in hex; null where it is no hex."""
    return F.when(hexed.rlike("^([0-9A-Fa-f]{2})*$"), F.decode(F.unhex(hexed), "UTF-8"))


def bcd(hexed: Column) -> Column:
    """The number whose decimal digits are the hex digits; null where one is none."""
    return F.when(hexed.rlike("^[0-9]+$"), hexed.try_cast("long"))


def signed_magnitude(value: Column, bits: int) -> Column:
    """A number whose highest of so many bits is its sign."""
    size = value.bitwiseAND(F.lit((1 << (bits - 1)) - 1))
    return F.when(F.shiftright(value, bits - 1).bitwiseAND(F.lit(1)) == 1, -size).otherwise(size)


def crc16(hexed: Column, polynomial: int = 0x1021, start: int = 0xFFFF) -> Column:
    """CRC-16 of bytes in hex, highest bit first, without reflection: eight shifts a byte."""
    values = F.transform(F.regexp_extract_all(hexed, F.lit("([0-9A-Fa-f]{2})"), F.lit(1)), lambda p: F.conv(p, 16, 10).cast("int"))

    def byte(a: Column, b: Column) -> Column:
        a = a.bitwiseXOR(F.shiftleft(b, 8))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), a, lambda x, _: F.when(x.bitwiseAND(F.lit(0x8000)) != 0, F.shiftleft(x, 1).bitwiseXOR(F.lit(polynomial))).otherwise(F.shiftleft(x, 1)).bitwiseAND(F.lit(0xFFFF)))

    return F.aggregate(values, F.lit(start), byte)


def xor_sum(hexed: Column) -> Column:
    """Exclusive or of bytes in hex."""
    return F.aggregate(F.regexp_extract_all(hexed, F.lit("([0-9A-Fa-f]{2})"), F.lit(1)), F.lit(0), lambda a, p: a.bitwiseXOR(F.conv(p, 16, 10).cast("int")))


#: Parameter id -> (name, factor, divisor, offset) of the value's whole number.
OBD = {
    0x04: ("engineLoad", 100, 255, 0),
    0x05: ("coolantTemp", 1, 1, -40),
    0x0B: ("mapIntake", 1, 1, 0),
    0x0C: ("rpm", 1, 4, 0),
    0x0D: ("obdSpeed", 1, 1, 0),
    0x0F: ("intakeTemp", 1, 1, -40),
    0x11: ("throttle", 100, 255, 0),
    0x21: ("milDistance", 1, 1, 0),
    0x2F: ("fuel", 100, 255, 0),
    0x31: ("clearedDistance", 1, 1, 0),
}


def obd(pid: Column, value: Column) -> tuple[Column, Column]:
    """(name, value) of an OBD parameter, in whole numbers; null for one that isn't known."""
    name, number, whole = F.lit(None).cast("string"), F.lit(None).cast("long"), value.cast("long")
    for k, (n, factor, divisor, offset) in OBD.items():
        name = F.when(pid == k, n).otherwise(name)
        number = F.when(pid == k, F.call_function("div", whole * factor, F.lit(divisor)) + offset).otherwise(number)
    return name, number


def trouble_code(value: Column) -> Column:
    """A diagnostic trouble code of two bytes: the system's letter by the two highest bits, then a digit of two bits and three of four."""
    letter = F.element_at(F.array(*map(F.lit, "PCBU")), (F.shiftright(value, 14).bitwiseAND(F.lit(3)) + 1).cast("int"))
    return F.concat(letter, F.shiftright(value, 12).bitwiseAND(F.lit(3)).cast("string"), F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFF))), 3, "0"))


def built_date(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, zone: str = "UTC") -> Column:
    """Epoch milliseconds; years of two digits are of this century; null where the parts are no date."""
    full = F.when(year < 100, year + 2000).otherwise(year)
    return F.unix_millis(F.call_function("try_make_timestamp", full, month, day, hour, minute, second.cast("decimal(8,6)"), F.lit(zone)))


def nearest_day(ms: Column, now_ms: Column) -> Column:
    """The time of day of ms on the day, yesterday, today or tomorrow, that is nearest to now_ms."""
    day = 86_400_000
    today = now_ms - F.pmod(now_ms, F.lit(day)) + F.pmod(ms, F.lit(day))
    order = F.array_sort(F.array(*[F.struct(F.abs(today + k * day - now_ms).alias("far"), (today + k * day).alias("at")) for k in (-1, 0, 1)]))
    return order[0]["at"]


def circle_area(radius: Column) -> Column:
    return F.lit(3.141592653589793) * radius * radius


def ring_area(ring: Column) -> Column:
    """Square metres inside a ring of array<struct<lat,lon>> on the sphere."""
    n = F.size(ring)

    def edge(i: Column) -> Column:
        a, b = ring[i], ring[(i + 1) % n]
        return F.radians(b["lon"] - a["lon"]) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"])))

    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), edge), F.lit(0.0), lambda s, x: s + x)) * EQUATORIAL_M * EQUATORIAL_M / 2


def as_number(value: Column, default: float = 0.0) -> Column:
    """An attribute of any kind as a number: what is missing or no number is the default."""
    return F.coalesce(value.cast("string").try_cast("double"), F.when(F.lower(value.cast("string")) == "true", 1.0), F.lit(default))


def as_flag(value: Column) -> Column:
    """An attribute of any kind as a boolean: only true, in any case, is true."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def address(parts: dict[str, Column], pattern: str = "%h %r, %t, %s, %c") -> Column:
    """A pattern with %tokens replaced by parts; separators around those that are missing go."""
    out = F.lit(pattern)
    for token, part in parts.items():
        out = F.replace(out, F.lit("%" + token), F.coalesce(part, F.lit("")))
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(out, r"[, ]*,[, ]*", ", "), " +", " ")), "^, |,$", "")


def clamped(body: Column, limits: dict[str, tuple[int, int]]) -> Column:
    """A JSON object's listed whole numbers, each held within its limits, in the list's order; what isn't listed goes, what isn't there stays away."""
    j = F.from_json(body, ", ".join(f"{n} long" for n in limits))
    return F.to_json(F.struct(*[F.when(j[n].isNotNull(), F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), j[n]))).alias(n) for n, (low, high) in limits.items()]))


#: A text frame: identifier, HHMMSS, validity, latitude and longitude in degrees and minutes with hemispheres, knots, course, DDMMYY.
FRAME = r"^\$\$([0-9A-Za-z]+),([0-9]{6}),([AV]),([0-9.]+),([NS]),([0-9.]+),([EW]),([0-9.]+),([0-9.]+),([0-9]{6})(?:\*([0-9A-F]{2}))?$"


def decoded(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """frames with unique_id, fix_ms, valid, latitude, longitude, speed, course and raw (the frame in hex); null where the frame is none."""
    g = lambda i: F.regexp_extract(F.col(frame), FRAME, i)
    ok = F.col(frame).rlike(FRAME)
    two = lambda i, k: F.substring(g(i), k, 2).cast("int")
    return frames.withColumns({
        "unique_id": F.when(ok, g(1)), "fix_ms": F.when(ok, built_date(two(10, 5), two(10, 3), two(10, 1), two(2, 1), two(2, 3), two(2, 5))), "valid": F.when(ok, g(3) == "A"),
        "latitude": F.when(ok, dm_to_degrees(g(4), g(5))), "longitude": F.when(ok, dm_to_degrees(g(6), g(7))), "speed": F.when(ok, g(8).cast("double")), "course": F.when(ok, g(9).cast("double")),
        "raw": hex_text(F.col(frame)),
    })


ENVELOPES = "array<struct<messageId:string,sequence:long,observedAt:long,latitude:double,longitude:double,speedKmh:double>>"


def batch_rows(batches: DataFrame, body: str = "body") -> DataFrame:
    """A row per envelope of JSON arrays, speeds in knots. What is no array gives none."""
    return batches.withColumn("e", F.explode(F.from_json(F.col(body), ENVELOPES))).select(
        *[c for c in batches.columns if c != body], F.col("e.messageId").alias("message_id"), "e.sequence", F.col("e.observedAt").alias("fix_ms"), "e.latitude", "e.longitude", F.round(F.col("e.speedKmh") * 0.539957, 9).alias("speed")
    )
