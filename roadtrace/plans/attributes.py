"""Queries over positions whose attributes are an open JSON object with differing keys, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as A
from ..sources import egress
from .catalog import by, pos

#: One expression in both languages: sat always, power, note, alarm and ignition on some rows, and a few rows without any or with broken JSON.
JSON = """CASE WHEN id % 41 = 0 THEN NULL WHEN id % 43 = 0 THEN '{"sat":' ELSE concat('{"sat":', id % 12,
  CASE WHEN id % 5 = 0 THEN concat(',"power":', id % 7, '.5') ELSE '' END, CASE WHEN id % 3 = 0 THEN concat(',"note":" ', CASE WHEN id % 2 = 0 THEN '=' ELSE '' END, 'n', id, '"') ELSE '' END,
  CASE WHEN alarm IS NOT NULL THEN concat(',"alarm":"', alarm, '"') ELSE '' END, CASE WHEN id % 4 = 0 THEN concat(',"ignition":', CASE WHEN ignition THEN 'true' ELSE 'false' END) ELSE '' END, '}') END"""
VALID = f"o AS (SELECT *, CASE WHEN json_valid({JSON}) THEN CAST({JSON} AS JSON) ELSE CAST('{{}}' AS JSON) END AS a FROM p)"
opened = lambda s, d: pos(s, d).withColumn("attributes", A.parsed(F.expr(JSON)))

by("open_attribute_keys", "SELECT k AS key, count(*) AS rows FROM (SELECT unnest(json_keys(a)) AS k FROM o) GROUP BY 1", lambda s, d: egress.attribute_keys(opened(s, d)), VALID)
by(
    "open_attribute_getters",
    """SELECT id, coalesce(CAST(a->>'sat' AS BIGINT), 0) AS sat, coalesce(CAST(a->>'power' AS DOUBLE), 0) AS power, trim(a->>'note') AS note, coalesce(a->>'ignition' = 'true', false) AS ignition,
  coalesce(CAST(a->>'sat' AS BIGINT), 0) + 1 AS added FROM o""",
    lambda s, d: opened(s, d)
    .withColumn("attributes", A.put(F.col("attributes"), "more", A.whole(F.col("attributes"), "sat") + 1))
    .select("id", *[x.alias(n) for n, x in (
        ("sat", A.whole(F.col("attributes"), "sat")), ("power", A.number(F.col("attributes"), "power")), ("note", F.trim(A.text(F.col("attributes"), "note"))),
        ("ignition", A.flag(F.col("attributes"), "ignition")), ("added", A.whole(F.col("attributes"), "more")),
    )]),
    VALID,
)
by(
    "csv_open_attributes",
    """SELECT NULL AS id, 'id,device_id,protocol,' || string_agg(k, ',' ORDER BY k) AS line FROM ks UNION ALL
  SELECT id, id || ',' || device_id || ',' || protocol || ',' || string_agg(CASE WHEN contains(c, ',') THEN chr(34) || c || chr(34) ELSE c END, ',' ORDER BY k) AS line
  FROM (SELECT id, device_id, protocol, k, CASE WHEN regexp_matches(trim(coalesce(a->>k, '')), '^[=+@-]') AND json_type(a->k) = 'VARCHAR' THEN '' ELSE trim(coalesce(a->>k, '')) END AS c FROM o CROSS JOIN ks)
  GROUP BY id, device_id, protocol""",
    lambda s, d: egress.csv_open(opened(s, d), ["id", "device_id", "protocol"]),
    VALID,
    "ks AS (SELECT DISTINCT unnest(json_keys(a)) AS k FROM o)",
)
