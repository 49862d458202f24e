"""Exports and payloads, as text columns that any sink can write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions.text import cell_guard, nmea_checksum


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _quoted(cell: Column) -> Column:
    return F.when(cell.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def _cells(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns as cells: texts are trimmed, and empty where they would run as formulas; numbers stay as they are."""
    texts = {n for n, t in df.dtypes if t == "string"}
    return [_quoted(cell_guard(F.coalesce(F.trim(c), F.lit(""))) if c in texts else F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """id and a CSV line; texts that would run as formulas are emptied, and cells with commas, quotes or line ends are quoted."""
    return df.select("id", F.concat_ws(",", *_cells(df, columns)).alias("line"))


def attribute_keys(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """key and rows: the keys that open attributes have, and how many rows have each."""
    return df.select(F.explode(F.map_keys(attributes)).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))


def csv_open(df: DataFrame, columns: list[str], attributes: str = "attributes") -> DataFrame:
    """id and a CSV line of the columns and of every key that any row's open attributes have, keys in order of their code points.

    The heading is the line of id null. Rows are read twice: for the keys, of which each distinct one is kept once, and for the lines. Texts
    are trimmed, and empty where they would run as formulas; cells with commas, quotes or line ends are quoted.
    """
    keys = attribute_keys(df, attributes).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    rows = df.withColumn("x_keys", keys.scalar())
    cells = F.transform("x_keys", lambda k: _quoted(A.cell(F.try_element_at(F.col(attributes), k))))
    lines = rows.select("id", F.array_join(F.concat(F.array(*_cells(df, columns)), cells), ",").alias("line"))
    heading = keys.select(F.lit(None).cast(dict(df.dtypes)["id"]).alias("id"), F.array_join(F.concat(F.array(*map(F.lit, columns)), F.transform("keys", _quoted)), ",").alias("line"))
    return heading.unionByName(lines)


def gpx_points(df: DataFrame) -> DataFrame:
    """id and its `<trkpt>` element, with 5 decimals."""
    f = lambda c: F.format_string("%.5f", F.col(c))
    return df.select("device_id", "id", F.concat(F.lit('<trkpt lat="'), f("latitude"), F.lit('" lon="'), f("longitude"), F.lit('"><time>'), iso(F.col("fix_ms")), F.lit("</time></trkpt>")).alias("trkpt"))


def kml_coordinates(df: DataFrame) -> DataFrame:
    """id and its `lon,lat,altitude` with 5 and 1 decimals."""
    return df.select("device_id", "id", F.format_string("%.5f,%.5f,%.1f", "longitude", "latitude", "altitude").alias("coord"))


def payload(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and value for a Kafka sink."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def templated(df: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """id and the template with `{name}` replaced by URL-encoded columns, and `{statusCode}` by the device's state."""
    out = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit("")))
    code = F.when(F.col("alarm").isNotNull(), "0xF841").when(F.col("speed") < 1, "0xF020").otherwise("0xF11C")
    return df.select("id", F.replace(out, F.lit("{statusCode}"), code).alias("url"))


def gprmc(df: DataFrame) -> DataFrame:
    """id and an NMEA sentence with its checksum."""
    a = F.abs("latitude")
    o = F.abs("longitude")
    dm = lambda x, w: F.concat(F.lpad(F.floor(x).cast("string"), w, "0"), F.lpad(F.format_string("%.4f", (x - F.floor(x)) * 60), 7, "0"))
    t = F.timestamp_millis("fix_ms")
    body = F.concat_ws(",", F.lit("GPRMC"), F.date_format(t, "HHmmss"), F.lit("A"), dm(a, 2), F.when(F.col("latitude") < 0, "S").otherwise("N"), dm(o, 3), F.when(F.col("longitude") < 0, "W").otherwise("E"), F.format_string("%.2f", "speed"), F.format_string("%.2f", "course"), F.date_format(t, "ddMMyy"), F.lit(""))
    return df.select("id", F.concat(F.lit("$"), body, F.lit("*"), nmea_checksum(body)).alias("sentence"))
