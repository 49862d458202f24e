"""Open attributes: whatever keys a position has, as map<string,variant>, with typed getters that read any kind of value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = "map<string,variant>"


def parsed(json: Column) -> Column:
    """The attributes of a JSON object; none where the text is null or no object. Keys whose value is null are left out."""
    v = F.try_parse_json(json)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    none = F.from_json(F.lit("{}"), OPEN)
    return F.map_filter(F.coalesce(F.when(is_object, v.cast(OPEN)), none), lambda _, x: x.isNotNull() & ~F.is_variant_null(x))


def put(attributes: Column, key: str, value: Column) -> Column:
    """The attributes with a key set to a value of any plain type; a null or an empty text changes nothing."""
    others = F.map_filter(attributes, lambda k, _: k != key)
    return F.when(value.isNull() | (value.cast("string") == ""), attributes).otherwise(F.map_concat(others, F.create_map(F.lit(key), value.cast("variant"))))


def _get(attributes: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(F.try_element_at(attributes, F.lit(key)), "$", kind)


def text(attributes: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(shown(F.try_element_at(attributes, F.lit(key))), F.lit(default))


def number(attributes: Column, key: str, default: float | None = 0.0) -> Column:
    """Numbers, and texts that are numbers; other texts are null, missing keys the default."""
    return F.when(F.map_contains_key(attributes, key), _get(attributes, key, "double")).otherwise(F.lit(default))


def whole(attributes: Column, key: str, default: int | None = 0) -> Column:
    """Numbers without their fraction, and texts that are whole numbers; other texts are null, missing keys the default."""
    v = F.try_element_at(attributes, F.lit(key))
    digits = shown(v)
    known = F.when(F.schema_of_variant(v) == "STRING", F.when(digits.rlike("^[+-]?[0-9]+$"), digits.try_cast("long"))).otherwise(F.try_variant_get(v, "$", "double").cast("long"))
    return F.when(F.map_contains_key(attributes, key), known).otherwise(F.lit(default))


def flag(attributes: Column, key: str, default: bool | None = False) -> Column:
    """Truth values, and the text true in any case; all else is false, missing keys the default."""
    return F.when(F.map_contains_key(attributes, key), F.coalesce(F.lower(text(attributes, key)) == "true", F.lit(False))).otherwise(F.lit(default))


def shown(value: Column) -> Column:
    """A variant as text: fractions as doubles, objects and lists as JSON."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    return F.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.try_variant_get(value, "$", "double").cast("string")).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value)).otherwise(plain)


def cell(value: Column) -> Column:
    """A variant as a spreadsheet's cell: texts are trimmed, and empty where they would run as formulas; numbers stay as they are."""
    trimmed = F.trim(shown(value))
    return F.coalesce(F.when((F.schema_of_variant(value) == "STRING") & trimmed.rlike(r"^[=+\-@]"), "").otherwise(trimmed), F.lit(""))
