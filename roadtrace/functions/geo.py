"""Geographic column expressions: all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EQUATORIAL_M, MEAN_M = 6_378_137.0, 6_371_000.0
DEGREE_M = 111_320.0


def haversine(lat1, lon1, lat2, lon2, radius: float = EQUATORIAL_M) -> Column:
    """Great-circle metres between two points in degrees."""
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    y, x = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = y * y + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * x * x
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * radius


def distance_mm(lat1, lon1, lat2, lon2, radius: float = EQUATORIAL_M) -> Column:
    """Whole millimetres: sums of these don't depend on the order of rows."""
    return F.round(haversine(lat1, lon1, lat2, lon2, radius) * 1000).cast("long")


def distance_to_line(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Metres from a point to a segment: the triangle's height, or the nearer end where that lies outside."""
    return to_side(haversine(lat, lon, lat1, lon1), haversine(lat1, lon1, lat2, lon2), haversine(lat2, lon2, lat, lon))


def to_side(d0: Column, d1: Column, d2: Column) -> Column:
    """The same from a triangle's sides, of which d1 is the segment."""
    half = (d0 + d1 + d2) / 2
    area = F.sqrt(F.greatest(half * (half - d0) * (half - d1) * (half - d2), F.lit(0.0)))
    return F.when(d0 * d0 > d1 * d1 + d2 * d2, d2).when(d2 * d2 > d1 * d1 + d0 * d0, d0).otherwise(F.try_divide(2 * area, d1))


def latitude_delta(metres: Column) -> Column:
    return metres / DEGREE_M


def longitude_delta(metres: Column, lat: Column) -> Column:
    return metres / (F.cos(F.radians(lat)) * DEGREE_M)


def numbers(wkt: Column) -> Column:
    """All numbers of a WKT text in order, as array<double>."""
    return F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))


def points(wkt: Column) -> Column:
    """A WKT's `lat lon` pairs, as array<struct<lat,lon>>."""
    n = numbers(wkt)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / 2).cast("int") - 1), lambda i: F.struct(n[i * 2].alias("lat"), n[i * 2 + 1].alias("lon")))


def in_circle(lat: Column, lon: Column, circle: Column) -> Column:
    """circle: numbers() of `CIRCLE (lat lon, radius)`."""
    return haversine(circle[0], circle[1], lat, lon) <= circle[2]


def edges(ring: Column) -> Column:
    """A ring's edges, each from a vertex back to the one before, with what their test needs. Rings over the 180th meridian use 0 to 360 degrees.

    Differences are those of the decimal numbers that the area's text has, as the doubles' own are off by more than the last
    place, so that a point on an edge would not always count as such.
    """
    wide, n = F.exists(ring, lambda p: p["lon"] > 90) & F.exists(ring, lambda p: p["lon"] < -90), F.size(ring)
    turned = lambda x: wide & (x < -90)
    norm = lambda x: F.when(turned(x), x + 360).otherwise(x)
    exact = lambda x: x.try_cast("decimal(30,18)")
    turns = lambda x: F.when(turned(x), 360).otherwise(0)

    def edge(i: Column) -> Column:
        a, b = ring[i], ring[(i + n - 1) % n]
        ax, bx = norm(a["lon"]), norm(b["lon"])
        up = F.coalesce((exact(b["lat"]) - exact(a["lat"])).cast("double"), b["lat"] - a["lat"])
        along = F.coalesce((exact(b["lon"]) - exact(a["lon"]) + (turns(b["lon"]) - turns(a["lon"]))).cast("double"), bx - ax)
        return F.struct(a["lat"].alias("lat"), ax.alias("lon"), bx.alias("to"), up.alias("up"), along.alias("along"), wide.alias("wide"))

    return F.transform(F.sequence(F.lit(0), n - 1), edge)


def within(lat: Column, lon: Column, edges: Column) -> Column:
    """Even-odd test along the meridian over edges(); an edge holds its eastern end."""

    def crossed(e: Column) -> Column:
        x = F.when(e["wide"] & (lon < -90), lon + 360).otherwise(lon)
        between = ((e["lon"] < x) & (e["to"] >= x)) | ((e["to"] < x) & (e["lon"] >= x))
        return between & (e["lat"] + F.try_divide((x - e["lon"]) * e["up"], e["along"]) < lat)

    return F.coalesce(F.size(F.filter(edges, crossed)) % 2 == 1, F.lit(False))


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    return within(lat, lon, edges(ring))


def segments(line: Column) -> Column:
    """A polyline's segments with their length and the cosines of their ends' latitudes, as array of structs."""

    def segment(i: Column) -> Column:
        a, b = line[i], F.get(line, i + 1)
        cos = lambda p: F.cos(F.radians(p["lat"]))
        ends = [x for k, p in ((1, a), (2, b)) for x in (p["lat"].alias(f"lat{k}"), p["lon"].alias(f"lon{k}"), cos(p).alias(f"cos{k}"))]
        return F.struct(*ends, haversine(a["lat"], a["lon"], b["lat"], b["lon"]).alias("d1"))

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0))), segment)


def along(lat: Column, lon: Column, segments: Column, metres: Column) -> Column:
    """Whether any of segments() is within metres: distance_to_line() step by step, as lambdas evaluate each mention of a column anew."""
    half = lambda c: F.sin(F.radians(c) / 2)
    s = F.transform(segments, lambda s: F.struct(half(s["lat1"] - lat).alias("y0"), half(s["lon1"] - lon).alias("x0"), half(lat - s["lat2"]).alias("y2"), half(lon - s["lon2"]).alias("x2"), F.cos(F.radians(lat)).alias("c"), s["cos1"].alias("cos1"), s["cos2"].alias("cos2"), s["d1"].alias("d1")))
    s = F.transform(s, lambda s: F.struct((s["y0"] * s["y0"] + s["c"] * s["cos1"] * s["x0"] * s["x0"]).alias("a0"), (s["y2"] * s["y2"] + s["cos2"] * s["c"] * s["x2"] * s["x2"]).alias("a2"), s["d1"].alias("d1")))
    metres_of = lambda a: 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EQUATORIAL_M
    s = F.transform(s, lambda s: F.struct(metres_of(s["a0"]).alias("d0"), s["d1"].alias("d1"), metres_of(s["a2"]).alias("d2")))
    return F.exists(s, lambda s: to_side(s["d0"], s["d1"], s["d2"]) <= metres)


def near_line(lat: Column, lon: Column, line: Column, metres: Column) -> Column:
    """Whether any segment of a polyline is within metres."""
    return along(lat, lon, segments(line), metres)


def gcj02(lat: Column, lon: Column) -> Column:
    """WGS-84 to GCJ-02, as struct<lat,lon>: the published polynomial and sine shift."""
    pi, a, ee = F.lit(3.14159265358979324), 6378245.0, 0.00669342162296594323
    x, y = lon - 105.0, lat - 35.0
    waves = lambda *terms: sum((F.sin(arg * pi) * amp for amp, arg in terms), F.lit(0.0)) * 2.0 / 3.0
    common = waves((20.0, 6.0 * x), (20.0, 2.0 * x))
    dy = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + common + waves((20.0, y), (40.0, y / 3.0)) + waves((160.0, y / 12.0), (320.0, y / 30.0))
    dx = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + common + waves((20.0, x), (40.0, x / 3.0)) + waves((150.0, x / 12.0), (300.0, x / 30.0))
    rad = F.radians(lat)
    magic = 1 - ee * F.sin(rad) * F.sin(rad)
    root = F.sqrt(magic)
    return F.struct((lat + dy * 180.0 / ((a * (1 - ee)) / (magic * root) * pi)).alias("lat"), (lon + dx * 180.0 / (a / root * F.cos(rad) * pi)).alias("lon"))
