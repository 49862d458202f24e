"""Frames of tracking devices as columns: patterns of text, layouts of bytes, and query strings, each compiled to expressions.

A text pattern is a list of parts: text(), skip(), field(), maybe() and either(). Its one regular expression runs once a row, whatever
the number of fields. A layout of bytes is a list of (name, width) with fixed offsets, and a list of records is such a layout
repeated as often as the frame tells.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import built_date

#: Stand between the fields of a match; frames that hold one don't match.
MARK, EDGE = "\x1f", "\x1e"


@dataclass(frozen=True)
class Part:
    """A regular expression, and the names of its groups in order."""

    regex: str
    names: tuple[str, ...] = ()


def _joined(parts: tuple[Part, ...]) -> Part:
    return Part("".join(p.regex for p in parts), tuple(n for p in parts for n in p.names))


def text(s: str) -> Part:
    return Part(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", s))


def skip(regex: str) -> Part:
    """What is matched and not kept; regex has no groups of its own."""
    return Part(f"(?:{regex})")


def field(name: str, regex: str) -> Part:
    return Part(f"({regex})", (name,))


def maybe(*parts: Part) -> Part:
    p = _joined(parts)
    return Part(f"(?:{p.regex})?", p.names)


def either(*ways: Part | list[Part]) -> Part:
    """The first way that fits. Ways may share names: a field is that of the way taken."""
    ps = [_joined(tuple(w)) if isinstance(w, list) else w for w in ways]
    return Part("(?:" + "|".join(p.regex for p in ps) + ")", tuple(n for p in ps for n in p.names))


def matched(frame: Column, *parts: Part) -> dict[str, Column]:
    """name -> text of the field, null where it is empty or absent; all null for frames that don't match as a whole."""
    p = _joined(parts)
    row = F.regexp_replace(frame, f"(?s)^{p.regex}$", EDGE + MARK.join(f"${i + 1}" for i in range(len(p.names))))
    ok = row.startswith(EDGE) & ~frame.contains(MARK) & ~frame.contains(EDGE)
    got = F.when(ok, F.split(F.substring(row, 2, 1 << 30), MARK, -1))
    at: dict[str, list[int]] = {}
    for i, n in enumerate(p.names):
        at.setdefault(n, []).append(i)
    filled = lambda i: F.when(got[i] != "", got[i])
    return {n: F.coalesce(*map(filled, places)) for n, places in at.items()}


def number(c: Column) -> Column:
    return c.try_cast("double")


def degrees(whole: Column, minutes: Column, side: Column | None = None) -> Column:
    """Degrees and minutes, negative for S and W or, without a side, for a minus before the degrees."""
    value = F.coalesce(F.abs(number(whole)), F.lit(0.0)) + number(minutes) / 60
    return F.when(side.isin("S", "W") if side is not None else whole.startswith("-"), -value).otherwise(value)


def moment(date: Column, time: Column, order: str = "dmy") -> Column:
    """Epoch milliseconds of six digits of a date, in that order, and six of a time; null where they are none."""
    two = lambda c, k: F.substring(c, 2 * k + 1, 2).try_cast("int")
    y, m, d = (two(date, order.index(x)) for x in "ymd")
    return built_date(y, m, d, two(time, 0), two(time, 1), two(time, 2))


def _axis(name: str, sides: str) -> Part:
    """A latitude or longitude with its hemisphere: -DD-MM.M, DDMM.M or DDMMMMMM."""
    end = [text(","), field(f"{name}_side", f"[{sides}]"), text(",")]
    return either(
        [text("-"), field(f"{name}_deg", r"\d+"), text("-"), field(f"{name}_min", r"\d+\.\d+"), *end],
        [field(f"{name}_deg", r"\d*?"), field(f"{name}_min", r"\d?\d\.\d+"), *end],
        [field(f"{name}_deg", r"\d+"), field(f"{name}_min4", r"\d{6}"), *end],
    )


#: Formats of frames: fixed by the devices that send them.
STAR = (
    text("*"), skip(".."), text(","), maybe(field("unique_id", r"\d+")), text(","), either([text("V4,"), field("result", ".*"), text(",")], [skip("V[^,]*"), text(",")]),
    maybe(field("time", r"\d{6}")), text(","), either([maybe(field("valid", "[ABV]")), text(",")], [skip(r"\d+"), text(",")]), _axis("lat", "NS"), _axis("lon", "EW"),
    skip(" *"), field("speed", r"\d+\.?\d*"), text(","), maybe(field("course", r"\d+\.?\d*")), text(","), maybe(skip(r"\d+"), text(",")), maybe(field("date", r"\d{6}")),
    maybe(text(","), field("status", "[0-9a-fA-F]{8}"), skip("(?:,.*)?")), text("#"),
)
RMC = (
    text("$G"), skip("[PLN]"), text("RMC,"), field("time", r"\d{6}"), skip(r"\.?\d*"), text(","), field("valid", "[AV]"), text(","), field("lat_deg", r"\d\d"), field("lat_min", r"\d\d\.\d+"), text(","), field("lat_side", "[NS]"),
    text(","), field("lon_deg", r"\d{2,3}"), field("lon_min", r"\d\d\.\d+"), text(","), field("lon_side", "[EW]"), text(","), maybe(field("speed", r"\d+\.?\d*")), text(","), maybe(field("course", r"\d+\.?\d*")), text(","),
    field("date", r"\d{6}"), text(","), skip(".*"),
)


def position(frame: Column, *parts: Part) -> dict[str, Column]:
    """unique_id, fix_ms, valid, latitude, longitude, speed (knots), course and status of frames in one of the formats above.

    Frames that don't match give nulls. A field that a frame leaves out is null, but for valid: only A is true.
    """
    g = matched(frame, *parts)
    none = F.lit(None).cast("string")
    minutes = lambda axis: F.coalesce(g[f"{axis}_min"], (number(g.get(f"{axis}_min4", none)) / 10000).cast("string"))
    axis = lambda a: F.when(g[f"{a}_side"].isNotNull(), degrees(g[f"{a}_deg"], minutes(a), g[f"{a}_side"]))
    return {
        "unique_id": g.get("unique_id", none), "fix_ms": moment(g["date"], g["time"]), "valid": F.when(g["lat_side"].isNotNull(), F.coalesce(g["valid"] == "A", F.lit(False))),
        "latitude": axis("lat"), "longitude": axis("lon"), "speed": number(g["speed"]), "course": number(g["course"]), "status": g.get("status", none),
    }


def unsigned(data: Column, at: Column | int, width: int, little: bool = False) -> Column:
    """The whole number in width bytes (7 at most) of binary data from offset at; null where the data end before."""
    digits = F.hex(F.substring(data, F.lit(at) + 1, F.lit(width)))
    if little:
        digits = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), 1)), "")
    return F.when(F.octet_length(data) >= F.lit(at) + width, F.conv(digits, 16, 10).cast("long"))


def signed(data: Column, at: Column | int, width: int, little: bool = False) -> Column:
    """The same in two's complement."""
    v = unsigned(data, at, width, little)
    return F.when(v >= 1 << (8 * width - 1), v - (1 << (8 * width))).otherwise(v)


def bits(value: Column, low: int, count: int = 1) -> Column:
    return F.shiftright(value, low).bitwiseAND(F.lit((1 << count) - 1))


def layout(data: Column, fields: list[tuple[str, int]], at: Column | int = 0, little: bool = False) -> dict[str, Column]:
    """name -> whole number, of fields that follow each other from offset at; a negative width is a signed field, a name of "" a gap."""
    out, offset = {}, F.lit(at)
    for name, width in fields:
        if name:
            out[name] = (signed if width < 0 else unsigned)(data, offset, abs(width), little)
        offset = offset + abs(width)
    return out


def records(data: Column, count: Column, fields: list[tuple[str, int]], at: int, little: bool = False) -> Column:
    """Array of structs: count records of fields from offset at. Records that the data have no room for are left out."""
    width = sum(abs(w) for _, w in fields)
    n = F.greatest(F.lit(0), F.least(count, F.floor((F.octet_length(data) - at) / width)))
    one = lambda i: F.struct(*[c.alias(k) for k, c in layout(data, fields, F.lit(at) + (i * width).cast("int"), little).items()])
    return F.transform(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>")), one)


#: A location message, led by 0x7878 and its length: the fields up to course and flags. Fixed by the devices.
LOCATION = [("lead", 2), ("length", 1), ("kind", 1), ("year", 1), ("month", 1), ("day", 1), ("hour", 1), ("minute", 1), ("second", 1), ("satellites", 1), ("lat", 4), ("lon", 4), ("speed", 1), ("flags", 2)]
LOCATION_KINDS = [0x10, 0x11, 0x12, 0x16, 0x22]


def location(data: Column) -> dict[str, Column]:
    """fix_ms, valid, satellites, latitude, longitude, speed (knots) and course of binary location messages; null for other data.

    A message counts only if its length byte agrees with the data. Coordinates are in 1/30,000 of a minute, speed in km/h.
    """
    f = layout(data, LOCATION)
    ok = (f["lead"] == 0x7878) & (f["length"] + 5 == F.octet_length(data)) & f["kind"].isin(LOCATION_KINDS) & f["flags"].isNotNull()
    i = lambda n: f[n].cast("int")
    half = lambda n: bits(f["satellites"], n, 4)
    side = lambda c, minus: F.when(minus, -c).otherwise(c)
    found = {
        "fix_ms": built_date(i("year"), i("month"), i("day"), i("hour"), i("minute"), i("second")), "valid": bits(f["flags"], 12) == 1, "satellites": half(0),
        "latitude": side(f["lat"] / 1_800_000, bits(f["flags"], 10) == 0), "longitude": side(f["lon"] / 1_800_000, bits(f["flags"], 11) == 1),
        "speed": f["speed"] * 0.539957, "course": bits(f["flags"], 0, 10),
    }
    return {n: F.when(ok, c) for n, c in found.items()}


#: Parameters of a query string that are a position's own fields; all others are attributes.
OWN = ["id", "deviceid", "valid", "timestamp", "lat", "lon", "location", "speed", "bearing", "heading", "altitude", "accuracy"]


def _once(value: Column, f) -> Column:
    """f of a value, which is evaluated once however often f mentions it."""
    return F.transform(F.array(value), f)[0]


def query_fields(q: Column) -> Column:
    """The fields of query_string() as one struct, in which each step is evaluated once; select it as a column of its own."""
    pairs = F.filter(F.transform(F.split(F.regexp_replace(q, r"^\?", ""), "&"), lambda x: F.split(x, "=", 2)), lambda x: x[0] != "")
    pairs = F.transform(pairs, lambda x: F.struct(F.try_url_decode(x[0]).alias("key"), F.try_url_decode(F.coalesce(F.get(x, F.lit(1)), F.lit(""))).alias("value")))
    pairs = F.filter(pairs, lambda x: x["key"].isNotNull())
    last = lambda p, n: F.element_at(F.filter(p, lambda x: x["key"] == n), -1)["value"]
    named = lambda p: _once(F.array_distinct(F.transform(p, lambda x: x["key"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda n: last(p, n))))

    def texts(m: Column) -> Column:
        v = lambda *keys: F.coalesce(*[F.when(F.element_at(m, k) != "", F.element_at(m, k)) for k in keys])
        found = {"id": v("id", "deviceid"), "stamp": v("timestamp"), "pair": F.split(v("location"), ","), "valid": v("valid"), "lat": v("lat"), "lon": v("lon"), "speed": v("speed"), "course": v("bearing", "heading"), "altitude": v("altitude"), "accuracy": v("accuracy")}
        return F.struct(*[c.alias(n) for n, c in found.items()], F.map_filter(m, lambda k, _: ~k.isin(*OWN)).alias("more"))

    def fields(t: Column) -> Column:
        stamp, pair = t["stamp"], t["pair"]
        whole = stamp.try_cast("long")
        wall = F.regexp_replace(F.substring(stamp, 1, 19), "T", " ")
        dated = F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(F.concat(wall, F.lit(" UTC")), F.lit("yyyy-MM-dd HH:mm:ss VV")), "UTC"))
        found = {
            "unique_id": t["id"], "fix_ms": F.when(whole.isNotNull(), F.when(whole < 2**31, whole * 1000).otherwise(whole)).otherwise(dated),
            "valid": F.when(t["more"].isNotNull(), ~F.coalesce(F.lower(t["valid"]).isin("false", "0"), F.lit(False))),
            "latitude": F.coalesce(number(t["lat"]), number(F.get(pair, F.lit(0)))), "longitude": F.coalesce(number(t["lon"]), number(F.get(pair, F.lit(1)))),
            "speed": number(t["speed"]), "course": number(t["course"]), "altitude": number(t["altitude"]), "accuracy": number(t["accuracy"]), "attributes": t["more"],
        }
        return F.struct(*[c.alias(n) for n, c in found.items()])

    return _once(_once(_once(pairs, named), texts), fields)


def query_string(q: Column) -> dict[str, Column]:
    """unique_id, fix_ms, valid, latitude, longitude, speed, course, altitude, accuracy and attributes (a map) of URL query strings.

    Of a parameter given twice the last counts. timestamp is in seconds, in milliseconds from 2^31 on, or a UTC date and time;
    location is "lat,lon". valid is true unless said otherwise. What can't be read is null, as is everything of a null string.
    """
    return fields_of(query_fields(q))


def fields_of(s: Column) -> dict[str, Column]:
    """The columns of query_string() from a struct of query_fields()."""
    return {n: s[n] for n in ("unique_id", "fix_ms", "valid", "latitude", "longitude", "speed", "course", "altitude", "accuracy", "attributes")}
