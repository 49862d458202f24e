"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust their score.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, matches, spans_text, table, unused

BASE = ["email", "ip", "card", "phone"]
#: The method adds IBANs, and numbers in the form of US social security numbers where a word before them says so.
KINDS = [*BASE, "iban", "ssn"]
# The possessive quantifiers and look-behinds keep each pattern linear without changing its leftmost greedy matches.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,}+"
SSN = r"(?<![0-9])[0-9]++-[0-9]++-[0-9]++"
#: Score in percent of a confirmed span before its context is seen, and words that raise it by BOOST where they stand within
#: WINDOW code points before it (and after the kind's match before). Added spans need KEEP; base ones stay whatever their score.
SCORE = {"email": 90, "ip": 60, "card": 80, "phone": 50, "iban": 90, "ssn": 30}
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|addr|server", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax", "iban": "iban|bank|account|transfer", "ssn": "ssn|social|security"}
BOOST, WINDOW, KEEP = 20, 40, 50
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    """The IBAN's remainder: first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substr(hit, F.lit(5)), F.substring(hit, 1, 4))
    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c <= "9", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(256)) <= 255),
        "card": lambda: n.between(13, 19) & F.call_function("luhn_check", _digits(hit)),
        "phone": lambda: n.between(9, 15),
        "iban": lambda: (F.length(hit) <= 34) & (_mod97(hit) == 1),
        "ssn": lambda: hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    }[kind]()


def _confirmed(kind: str):
    return lambda s: valid(kind, s["hit"])


def _scored(kind: str):
    def scored(s: Column) -> Column:
        near = F.when(F.translate(s["near"], *LOWER).rlike(CONTEXT[kind]), BOOST).otherwise(0)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), (F.least(F.lit(100), near + SCORE[kind]) / 100).alias("score"))

    return scored


def _ranked(rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("kind"), s["end"].alias("end"))


def find(docs: DataFrame, text: str = "text", prefix: str = "m_") -> DataFrame:
    """docs with `<prefix><kind>` per kind: array<struct<start,end,hit,score>> of confirmed spans in text order.

    A null text counts as empty and has no spans. Base kinds stay whatever their score; the others need KEEP percent: IBANs
    have it by their mod-97 check, social security numbers by a word before them. Columns of docs that are named as the
    new ones are replaced; all others come out as they went in.
    """
    t = F.col(text)
    digit = t.rlike("[0-9]{2}|[0-9][ .-]")
    df = matches(docs, text, {
        "email": (EMAIL, t.contains("@")), "ip": (IP, digit & t.contains(".")), "card": (CARD, digit),
        "phone": (PHONE, t.contains("+")), "iban": (IBAN, digit & t.rlike("[A-Z]{2}[0-9]{2}")), "ssn": (SSN, digit & t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    }, prefix, WINDOW)
    for kind in KINDS:
        scored = F.transform(F.filter(f"{prefix}{kind}", _confirmed(kind)), _scored(kind))
        df = df.withColumn(f"{prefix}{kind}", scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= KEEP / 100))
    return df


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of find() in text replaced by its kind in brackets; a null text stays null, and all other columns
    come out as they went in.

    Of overlapping spans the first in (start, kind) order names the replacement, and all that they cover goes. Spans are
    walked in blocks, each of which is cut out of the text once, so that a text full of spans isn't read from its start for each.
    """
    x = unused(docs)
    df = find(docs, text, x)
    every = F.array_sort(F.concat(*[F.transform(f"{x}{k}", _ranked(i)) for i, k in enumerate(KINDS)]))
    df = df.withColumn(f"{x}all", every).withColumn(f"{x}end", F.array_max(F.transform(f"{x}all", lambda s: s["end"])))
    block = lambda c: f"transform(sequence(0, greatest(size({c}) - 1, 0) div {BLOCK}), k -> slice({c}, k * {BLOCK} + 1, {BLOCK}))"
    df = df.withColumn(f"{x}blocks", F.expr(block(f"{x}all")))
    # How far the blocks before reach; then the pieces of text that stay, each with the span that ends it.
    df = df.withColumn(f"{x}from", F.expr(f"aggregate({x}blocks, named_struct('p', 0, 'o', cast(array() as array<int>)), (a, b) -> named_struct('p', greatest(a.p, coalesce(array_max(transform(b, s -> s.end)), 0)), 'o', array_append(a.o, a.p)), a -> a.o)"))
    shape = "array<struct<from:int,start:int,kind:int>>"
    df = df.withColumn(f"{x}cuts", F.expr(
        f"""flatten(zip_with({x}blocks, {x}from, (b, p) -> aggregate(b, named_struct('p', p, 'o', cast(array() as {shape})), (a, s) -> named_struct(
              'p', greatest(a.p, s.end), 'o', if(s.start >= a.p, array_append(a.o, named_struct('from', a.p, 'start', s.start, 'kind', s.kind)), a.o)), a -> a.o)))"""
    ))
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    df = df.withColumn(f"{x}parts", F.expr(
        f"""transform({block(f"{x}cuts")}, b -> named_struct('b', b, 't', substr(`{text}`, b[0].from + 1, element_at(b, -1).start - b[0].from)))"""
    ))
    new = F.expr(
        f"""concat(array_join(flatten(transform({x}parts, c -> transform(c.b, s -> concat(substr(c.t, s.from - c.b[0].from + 1, s.start - s.from), array({names})[s.kind])))), ''), substr(`{text}`, {x}end + 1))"""
    )
    return df.withColumn(text, F.when(F.size(f"{x}all") > 0, new).otherwise(F.col(text))).select(docs.columns)


def _percent(kind: str):
    return lambda s: F.round(s["score"] * 100).cast("int").cast("string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select(
        "doc_id", *[F.size(f"m_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(spans_text(BASE, False), 256).alias("base_sha256"),
        spans_text(KINDS, False).alias("spans"), F.array_join(F.concat(*[F.transform(f"m_{k}", _percent(k)) for k in KINDS]), ",").alias("scores"),
    )


def _sql(kind: str, pattern: str, keep: str) -> str:
    p = pattern.replace("'", "''")
    score = f"{SCORE[kind]} + CASE WHEN regexp_matches(translate(right(g, {WINDOW}), '{LOWER[0]}', '{LOWER[1]}'), '{CONTEXT[kind]}') THEN {BOOST} ELSE 0 END"
    stays = "" if kind in BASE else f" AND x.q >= {KEEP}"
    return f"""list_filter((SELECT list({{'s': s, 'e': s + length(h), 'h': h, 'q': least(100, {score})}} ORDER BY s) FROM (
        SELECT h, g, sum(length(g)) OVER (ORDER BY i) + coalesce(sum(length(h)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT unnest(regexp_extract_all(t, '{p}')) AS h, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS g, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i))), lambda x: {keep}{stays}) AS m_{kind}"""


_D = "regexp_replace(x.h, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN (length({_D}) - i) % 2 = 0 THEN CAST({_D}[i] AS INT) ELSE CAST({_D}[i] AS INT) * 2 - CASE WHEN CAST({_D}[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD = "list_reduce(list_prepend(0, list_transform(range(1, length(x.h) + 1), lambda i: CASE WHEN (x.h[5:] || x.h[1:4])[i] <= '9' THEN ascii((x.h[5:] || x.h[1:4])[i]) - 48 ELSE 1000 + ascii((x.h[5:] || x.h[1:4])[i]) - 55 END)), lambda a, c: CASE WHEN c < 1000 THEN (a * 10 + c) % 97 ELSE (a * 100 + c - 1000) % 97 END) = 1"
_JOINED = lambda k: f"coalesce(list_transform(m_{k}, lambda x: '{k}:' || CAST(x.s AS BIGINT) || ':' || CAST(x.e AS BIGINT)), [])"
_SCORES = lambda k: f"coalesce(list_transform(m_{k}, lambda x: CAST(x.q AS VARCHAR)), [])"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id,
  {_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")},
  {_sql("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(x.h, '.'), lambda p: CAST(p AS HUGEINT))) <= 255")},
  {_sql("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_D}) BETWEEN 13 AND 19 AND {_LUHN}")},
  {_sql("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 9 AND 15")},
  {_sql("iban", r"[A-Z][A-Z][0-9][0-9][A-Z0-9]{11,}", f"length(x.h) <= 34 AND {_MOD}")},
  {_sql("ssn", "[0-9]+-[0-9]+-[0-9]+", "regexp_full_match(x.h, '[0-9]{3}-[0-9]{2}-[0-9]{4}')")}
  FROM d)
SELECT doc_id, {", ".join(f"coalesce(len(m_{k}), 0) AS n_{k}" for k in KINDS)},
  sha256(array_to_string({" || ".join(_JOINED(k) for k in BASE)}, ',')) AS base_sha256,
  array_to_string({" || ".join(_JOINED(k) for k in KINDS)}, ',') AS spans, array_to_string({" || ".join(_SCORES(k) for k in KINDS)}, ',') AS scores
FROM m
"""
