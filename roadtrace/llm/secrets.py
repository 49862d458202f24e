"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned once per rule version: pairs that
the ledger has already are skipped, new findings are added to it, and findings are joined back to all paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matches, spans_text, table, unused, written

RULE_VERSION = "1"
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "pem"]
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: A private key from its header to its END line; the header alone where no END line is the next with five dashes.
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:[^-]|-[^-]|--[^-]|---[^-]|----[^-])*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
LEAST = {"assign": 12, "access": 18, "hex": 16, "pem": 1}
LEDGER = "blob string, rules string, findings array<struct<kind:string,start:int,end:int>>"


def scan(blobs: DataFrame, text: str = "text") -> DataFrame:
    """blobs with `m_<kind>` per kind of KINDS: the spans that are long enough; null texts have none."""
    t = F.col(text)
    df = matches(blobs, text, {
        "assign": (ASSIGN, t.rlike(r"[:=]") & t.rlike(ASSIGN)), "access": (ACCESS, t.contains("AKIA")),
        "hex": (HEX, t.rlike(HEX)), "pem": (PEM, t.contains("-----BEGIN ")),
    })
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= LEAST["assign"]
    return df.withColumns({"m_assign": F.filter("m_assign", value), "m_access": F.filter("m_access", lambda s: F.length(s["hit"]) >= LEAST["access"])})


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows at path, one for each blob and rule version that was scanned; none where nothing has been written yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def append_ledger(new: DataFrame, path: str) -> None:
    """Adds ledger rows at path. Rows that a repeated scan adds again do no harm: readers take one of a blob and rule version."""
    new.write.mode("append").parquet(path)


def scan_to(versions: DataFrame, path: str, text: str = "text") -> DataFrame:
    """scan_versions() against the ledger at path, which then has the blobs that were new."""
    found, new = scan_versions(versions, load_ledger(versions.sparkSession, path), text)
    append_ledger(new, path)
    return found


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(versions with `blob` and `m_<kind>` findings, new ledger rows) for a table with one row per version of a path.

    ledger: rows of LEDGER from earlier scans. A (blob, RULE_VERSION) pair that it has is not scanned again. Texts that
    are equal are one blob, however many rows hold them; a null text counts as the empty blob. The new ledger rows hold
    every blob scanned now, with findings or without, so that the next scan skips them. Columns of versions named blob or
    m_<kind> are replaced; all others but the text come out as they went in. Empty texts have no findings and take no part in
    the join of findings to paths.
    """
    x = unused(versions)
    at = versions.drop(*[f"m_{k}" for k in KINDS]).withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    blobs = at.select("blob", F.col(text).alias("body")).dropDuplicates(["blob"])
    seen = None
    if ledger is not None:
        seen = ledger.where(F.col("rules") == RULE_VERSION).select("blob", "findings").dropDuplicates(["blob"])
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    tagged = F.concat(*[F.transform(f"m_{k}", _tag(k)) for k in KINDS])
    new = written(scan(blobs, "body").select("blob", F.lit(RULE_VERSION).alias("rules"), tagged.alias("findings")), "ledger")
    found = new.select("blob", "findings").where(F.size("findings") > 0)
    if seen is not None:
        found = found.union(seen.where(F.size("findings") > 0))
    blank = F.coalesce(F.col(text) == "", F.lit(True))
    joined = at.where(~blank).drop(text).join(found.withColumnRenamed("findings", f"{x}found"), "blob", "left")
    every = joined.unionByName(at.where(blank).drop(text), allowMissingColumns=True)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    every = every.withColumns({f"m_{k}": F.coalesce(F.filter(f"{x}found", _is(k)), none) for k in KINDS})
    return every.drop(f"{x}found"), new


def _tag(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = scan_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select(
        "doc_id", *[F.size(f"m_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(spans_text(BASE, True), 256).alias("base_sha256"), spans_text(KINDS, True).alias("spans"),
    )


def _sql(kind: str, pattern: str, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""list_filter((SELECT list({{'s': s, 'e': s + length(h), 'h': h}} ORDER BY s) FROM (
        SELECT h, sum(length(g)) OVER (ORDER BY i) + coalesce(sum(length(h)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT unnest(regexp_extract_all(t, '{p}')) AS h, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS g, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i))), lambda x: {keep}) AS m_{kind}"""


_A = ASSIGN.replace("'", "''")
_PART = lambda r, k: f"coalesce(list_transform(m_{k}, lambda x: {{'s': CAST(x.s AS BIGINT), 'k': {r}, 't': '{k}:' || CAST(x.s AS BIGINT) || ':' || CAST(x.e AS BIGINT)}}), [])"
_ALL = lambda kinds: f"array_to_string(list_transform(list_sort({' || '.join(_PART(r, k) for r, k in enumerate(kinds))}), lambda y: y.t), ',')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id,
  {_sql("assign", ASSIGN, f"length(regexp_extract(x.h, '{_A}', 1)) >= 12")},
  {_sql("access", ACCESS, "length(x.h) >= 18")},
  {_sql("hex", "[0-9a-f]+", "length(x.h) >= 16")},
  {_sql("pem", PEM.replace("*+", "*"), "true")}
  FROM d)
SELECT doc_id, {", ".join(f"coalesce(len(m_{k}), 0) AS n_{k}" for k in BASE)}, sha256({_ALL(BASE)}) AS base_sha256, {_ALL(KINDS)} AS spans
FROM m
"""
