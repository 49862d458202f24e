"""URL filters: explicit host and path rules, and a path-template tree for the rest.

Per host, paths are split into segments and generalised level by level: a segment that looks like a number or a
code becomes `*`, and so do the children of a node that has many rare ones. Labelled branches of a node whose share of bad
labels doesn't differ from the node's by more than chance are merged. A template is rejected where the smoothed share of
bad labels in its merged branch is high. Shares are smoothed towards the parent's, and the host's towards PRIOR, so that a
branch with few or no labels is judged by what is known above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused, written

#: Fixed values of the contract: (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VARIABLE = r"^[0-9]+$|^(?=.*[0-9])[0-9A-Fa-f_-]{8,}$|^.{40,}$"
#: A node with over WIDE children, whose children have under RARE rows on average, has variable children.
WIDE, RARE = 50, 4
LEVELS = 8  # of the tree: its last one takes all the rest of a path as one segment
STRENGTH, PRIOR = 4.0, 0.1  # smoothing: the weight, in labelled URLs, of a prior share of bad ones
REJECT = 0.5  # smoothed share of bad labels from which a template is rejected
CLOSE = 1.96  # standard errors within which a branch counts as like its node


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with `host` and `path`: both empty where the URL is null or has no `://`."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    x = unused(urls) + "rest"
    df, host = urls.withColumn(x, rest), F.regexp_extract(x, r"^[^/?#]*", 0)
    after = F.expr(f"substr({x}, length(regexp_extract({x}, '^[^/?#]*', 0)) + 1)")
    return df.withColumn("host", F.translate(host, *LOWER)).withColumn("path", F.regexp_extract(after, r"^[^?#]*", 0)).drop(x)


def ruled(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null where none does. Of equally long ones the first in order of text."""
    fits = [
        F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    ]
    best = F.coalesce(*fits)
    return best["rule"], best["verdict"]


def segments() -> Column:
    """The path's segments with variable ones as `*`, joined by `/`; empty ones are left out."""
    split = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    stem = lambda s: F.regexp_replace(s, r"\.[A-Za-z][A-Za-z0-9]{0,5}$", "")
    return F.array_join(F.transform(split, lambda s: F.when(stem(s).rlike(VARIABLE), "*").otherwise(s)), "/")


def verdicts(urls: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """urls with host, path, rule, template and verdict.

    labels: (host, path, bad 0/1) rows; without it, the rows that a rule decides are the labels. A URL without a rule
    takes its template's verdict: block where the smoothed share of bad labels is REJECT or more. A branch's share is smoothed
    towards its parent's, so a template without labels takes the share above it; a host without labels is allowed. Null
    and malformed URLs have an empty host and path and are allowed. Rows that repeat count as often. Columns of urls named
    host, path, rule, template or verdict are replaced, all others come out as they went in. An empty table gives an empty one.
    """
    rule, verdict = ruled(rules)
    urls = urls.drop("host", "path", "rule", "template", "verdict")
    x = unused(urls)
    key, decided, share = x + "key", x + "verdict", x + "share"
    df = parts(urls, url).withColumn("rule", rule).withColumn(decided, verdict).withColumn(key, segments())
    if labels is None:
        seen = df.select("host", F.col(key).alias("x_key"), F.when(F.col(decided) == "block", 1).when(F.col(decided) == "allow", 0).alias("bad"))
    else:
        seen = df.select("host", F.col(key).alias("x_key"), F.lit(None).cast("int").alias("bad")).union(labels.select(F.translate("host", *LOWER), segments(), F.col("bad").cast("int")))
    judged = df.join(tree(seen).withColumnsRenamed({"x_key": key, "x_share": share}), ["host", key], "left")
    return judged.withColumn("verdict", F.coalesce(decided, F.when(F.col(share) >= REJECT, "block"), F.lit("allow"))).select(*urls.columns, "host", "path", "rule", "template", "verdict")


def tree(seen: DataFrame) -> DataFrame:
    """(host, x_key, template, x_share) per distinct (host, x_key) of seen (host, x_key, bad 0/1/null)."""
    at = written(seen.groupBy("host", "x_key").agg(F.count("*").alias("n"), F.count("bad").alias("m"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")), "templates")
    depth = at.agg(F.coalesce(F.max(F.size(F.split("x_key", "/", LEVELS))), F.lit(0))).first()[0]
    share = lambda b, m, prior: (F.col(b) + STRENGTH * prior) / (F.col(m) + STRENGTH)
    root = at.groupBy("host").agg(F.sum("m").alias("hm"), F.sum("b").alias("hb"))
    at = at.join(root, "host").select("host", "x_key", "n", "m", "b", F.lit("").alias("template"), share("hb", "hm", F.lit(PRIOR)).alias("x_share"))
    for level in range(depth):
        at = at.withColumn("s", F.coalesce(F.try_element_at(F.split("x_key", "/", LEVELS), F.lit(level + 1)), F.lit("")))
        kids = at.groupBy("host", "template", "s").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("b").alias("b"))
        node = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("wn"), F.sum("m").alias("wm"), F.sum("b").alias("wb"))
        kids = kids.join(node, ["host", "template"]).withColumn("g", F.when((F.col("kids") > WIDE) & (F.col("wn") < RARE * F.col("kids")) & (F.col("s") != ""), "*").otherwise(F.col("s")))
        branch = kids.groupBy("host", "template", "g").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.max("wm").alias("wm"), F.max("wb").alias("wb"))
        rate, whole = F.try_divide("b", "m"), F.try_divide("wb", "wm")
        like = (F.col("m") > 0) & (F.abs(rate - whole) <= CLOSE * F.sqrt(F.try_divide(F.greatest(whole * (1 - whole), F.lit(0.01)), "m")))
        branch = branch.withColumn("own", F.when(like, "").otherwise(F.concat(F.lit("="), "g")))
        merged = branch.groupBy("host", "template", "own").agg(F.sum("m").alias("jm"), F.sum("b").alias("jb"))
        branch = branch.select("host", "template", "g", "own").join(merged, ["host", "template", "own"])
        step = kids.select("host", "template", "s", "g").join(branch.select("host", "template", "g", "jm", "jb"), ["host", "template", "g"])
        at = at.join(step, ["host", "template", "s"])
        deeper = F.col("s") != ""
        at = written(at.select("host", "x_key", "n", "m", "b", F.when(deeper, F.concat("template", F.lit("/"), "g")).otherwise(F.col("template")).alias("template"), F.when(deeper, share("jb", "jm", F.col("x_share"))).otherwise(F.col("x_share")).alias("x_share")), "templates")
    return at.select("host", "x_key", "template", "x_share")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template")


def _sql() -> str:
    fits = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])))
    share = lambda b, m: f"({b} + {STRENGTH * PRIOR}) / ({m} + {STRENGTH})"
    ctes = [
        "u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{LOWER[0]}', '{LOWER[1]}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u)",
        f"r AS (SELECT *, CASE {fits} END AS fit, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM h)",
        "v AS (SELECT page_id, host, path, regexp_extract(fit, '^[^|]*') AS rule, string_split(fit, '|')[2] AS verdict, array_to_string(list_transform(segs, lambda s: CASE WHEN "
        "regexp_matches(regexp_replace(s, '[.][A-Za-z][A-Za-z0-9]{0,5}$', ''), '^[0-9]+$|^.{40,}$') OR (regexp_matches(regexp_replace(s, '[.][A-Za-z][A-Za-z0-9]{0,5}$', ''), '^[0-9A-Fa-f_-]{8,}$') AND "
        "regexp_matches(regexp_replace(s, '[.][A-Za-z][A-Za-z0-9]{0,5}$', ''), '[0-9]')) THEN '*' ELSE s END), '/') AS k FROM r)",
        "l AS (SELECT host, k, count(*) AS n, count(verdict) AS m, count(*) FILTER (verdict = 'block') AS b FROM v GROUP BY ALL)",
        f"a0 AS (SELECT *, '' AS t, {share('sum(b) OVER (PARTITION BY host)', 'sum(m) OVER (PARTITION BY host)')} AS p FROM l)",
    ]
    for i in range(LEVELS):
        own = f"string_split(k, '/')[{i + 1}]" if i + 1 < LEVELS else f"array_to_string(string_split(k, '/')[{LEVELS}:], '/')"
        ctes += [
            f"s{i} AS (SELECT *, coalesce({own}, '') AS s FROM a{i})",
            f"k{i} AS (SELECT host, t, s, sum(n) AS n, sum(m) AS m, sum(b) AS b FROM s{i} GROUP BY ALL)",
            f"w{i} AS (SELECT *, CASE WHEN count(*) OVER w > {WIDE} AND sum(n) OVER w < {RARE} * count(*) OVER w AND s <> '' THEN '*' ELSE s END AS g, sum(m) OVER w AS wm, sum(b) OVER w AS wb FROM k{i} WINDOW w AS (PARTITION BY host, t))",
            f"b{i} AS (SELECT host, t, g, sum(m) AS m, sum(b) AS b, max(wm) AS wm, max(wb) AS wb FROM w{i} GROUP BY ALL)",
            f"o{i} AS (SELECT *, CASE WHEN m > 0 AND abs(b / m - wb / wm) <= {CLOSE} * sqrt(greatest((wb / wm) * (1 - wb / wm), 0.01) / m) THEN '' ELSE '=' || g END AS own FROM b{i})",
            f"j{i} AS (SELECT host, t, g, sum(m) OVER (PARTITION BY host, t, own) AS jm, sum(b) OVER (PARTITION BY host, t, own) AS jb FROM o{i})",
            f"a{i + 1} AS (SELECT x.host, x.k, x.n, x.m, x.b, CASE WHEN x.s <> '' THEN x.t || '/' || y.g ELSE x.t END AS t, CASE WHEN x.s <> '' THEN (j.jb + {STRENGTH} * x.p) / (j.jm + {STRENGTH}) ELSE x.p END AS p "
            f"FROM s{i} x JOIN w{i} y ON x.host = y.host AND x.t = y.t AND x.s = y.s JOIN j{i} j ON j.host = y.host AND j.t = y.t AND j.g = y.g)",
        ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT v.page_id, v.host, v.path, v.rule, coalesce(v.verdict, CASE WHEN a.p >= {REJECT} THEN 'block' END, 'allow') AS verdict, a.t AS template FROM v JOIN a{LEVELS} a ON a.host = v.host AND a.k = v.k"


OP10_SQL = _sql()
