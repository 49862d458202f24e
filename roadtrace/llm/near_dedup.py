"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Texts with equal shingle sets form a class; the rest works on classes, named by their smallest doc_id.
2. A class keeps its k smallest shingle hashes. Inverted lists are made of runs of three neighbouring retained values.
   Two sets of Jaccard similarity 0.8 or more share such a run: for sets that are retained whole this is certain (a union of
   u has at most u/5 values that are not shared, so some run of shared ones has three, from u = 6; sets of four or five
   add runs of two, and smaller ones are equal or below 0.8), and for larger sets it fails with a chance of about
   0.7^k, at most 3e-8 at k = 48.
3. Each list links its members to one centre, the member that shares most values with others. Union sketches estimate
   those pairs' similarity, and full sets confirm it. So big groups of copies join up by as many pairs as they have members.
4. Only lists whose members are still in several components go on. Short ones pair their members of different
   components. The full sets of long ones' members, ordered rare values first, meet by exact prefix, position and size bounds.
5. The confirmed links' connected components are the answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_IDS, components, picked, small_batches, table, tidied, written

K = 48
#: Of a union's 48 smallest values a pair at 0.8 shares 38; under 20 has a chance below 1e-8.
LEAST_SHARED = 20 / 48
#: Lists of up to so many members pair them directly.
SHORT = 16

_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes (as int64) of the shingles of the whole text; of a shorter text, of all its words.

    bytes.lower() and bytes.split() touch just A-Z and the six ASCII white spaces.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_words) > 50_000:
        _words.clear()
    known, digest = _words, xxhash.xxh64_intdigest
    h = np.array([known.get(w) or known.setdefault(w, digest(w)) for w in words], np.uint64)
    n = min(width, len(h))
    g = h[: len(h) - n + 1]
    for j in range(1, n):
        g = _mix(g) * np.uint64(3) + h[j : len(h) - n + 1 + j]
    return np.unique(_mix(g + np.uint64(n)).view(np.int64))


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _features(width: int, k: int):
    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                s = shingles(t, width)
                rows.append((len(s), _digest(s), s[:k]))
            out = pd.DataFrame(rows, columns=["n", "set", "sketch"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out
        _words.clear()

    return run


def _sets(width: int):
    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, want, t in zip(b["doc_id"], b["set"], b["text"]):
                s = shingles(t, width)
                if _digest(s) == want:
                    rows.append((i, want, s))
            yield pd.DataFrame(rows, columns=["rep", "set", "all"])
        _words.clear()

    return run


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) whose union sketch doesn't rule out the similarity."""
    s = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")).join(pairs, "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    s = s.withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    return s.where(F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) >= LEAST_SHARED * F.size("u")).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets are similar enough. Only the sets that pairs name are shuffled."""
    ids = written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ids")
    named = picked(sets, ids, "left_semi", "rep")
    s = named.select(F.col("rep").alias("a"), F.col("all").alias("sa")).join(pairs, "a").join(named.select(F.col("rep").alias("b"), F.col("all").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return s.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels among members (rep, label, all) that exact bounds don't rule out.

    Sets are ordered by one order of all values: first those that no two labels have in common, then the others, rare
    ones first. p is a value's place in its set.
    """
    each = members.select("rep", "label", F.size("all").alias("n"), F.explode("all").alias("v"))
    common = written(each.groupBy("v").agg(F.count("*").alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("v", "c"), "common")
    ordered = each.join(common, "v").groupBy("rep", "label", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("o"))
    # A partner that has enough in common shares one of the first n - ceil(percent * n) + 1 values.
    own = F.col("n") - F.size("o")
    first = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100.0 - 1e-9) + 1 - own
    firsts = ordered.select("rep", "label", "n", own.alias("own"), F.posexplode(F.slice("o", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("i", "z"))
    firsts = written(firsts.select("rep", "label", "n", F.col("z.v").alias("v"), (F.col("own") + F.col("i")).alias("p")), "prefixes")
    # The label with most entries of a value meets only the others.
    main = firsts.groupBy("v", "label").count().groupBy("v").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    rest = firsts.join(written(main.select("v", "main"), "main"), "v").where("label <> main").select("v", *[F.col(c).alias(f"{c}2") for c in ("rep", "label", "n", "p")])
    # The first value that two sets have in common leaves at most the values from it on to share.
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("n2")) / F.lit(100 + percent) - 1e-9)
    met = firsts.join(rest, "v").where((F.col("label") != F.col("label2")) & (F.least(F.col("n") - F.col("p"), F.col("n2") - F.col("p2")) >= need))
    return met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs (doc_id, text; other columns are not looked at).

    Links join texts whose sets of width-word shingles have 100 * intersection >= percent * union; component_id is the
    smallest doc_id that links reach. Null and empty texts, and texts of white space, are linked with nothing and kept.
    Rows that repeat an id are one node; texts that share an id count as linked. A null id is its own or its copies'
    component, null where there is none with an id, and kept only then. An empty table gives an empty one.
    """
    if percent < 80:
        raise ValueError("runs of three find pairs from 80 percent")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # Ids travel as text: pandas would turn whole numbers beside nulls into doubles.
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = named.mapInPandas(_features(width, k), "doc_id string, n long, set binary, sketch array<long>").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = written(rows, "sketches")
    classes = written(rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).where("rep is not null"), "classes")
    label = _labels(docs, classes, width, percent, k)

    named = classes.select("set", "rep").join(label, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("component", "rep").alias("c"))
    out = rows.select("doc_id", "n", "set").join(named, "set", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _labels(docs: DataFrame, classes: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """(node, component) of the classes that have a link."""
    three = F.transform(F.sequence(F.lit(1), F.size("sketch") - 2), lambda i: F.xxhash64(F.col("sketch")[i - 1], F.col("sketch")[i], F.col("sketch")[i + 1]))
    two = F.transform(F.sequence(F.lit(1), F.size("sketch") - 1), lambda i: F.xxhash64(F.lit(2), F.col("sketch")[i - 1], F.col("sketch")[i]))
    none = F.array().cast("array<long>")
    runs = F.concat(F.when(F.size("sketch") >= 3, three).otherwise(none), F.when(F.size("sketch").between(4, 5), two).otherwise(none))
    keys = classes.select("rep", F.explode(F.array_distinct(runs)).alias("key"))
    lists = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    lists = written(keys.join(lists, "key"), "lists")
    weight = written(lists.groupBy("rep").agg(F.sum("size").alias("weight")), "listed")
    # What the listed classes hold: sketches and full sets, once for all steps below.
    listed = written(picked(classes, weight.select("rep"), "left_semi", "rep").select("rep", "set", "sketch"), "listed")
    few, text = listed.select("rep", "set"), docs.where("doc_id is not null")
    met = text.join(F.broadcast(few) if few.count() <= MOST_IDS else few, F.col("doc_id") == F.col("rep")).select("doc_id", "set", "text")
    sets = written(met.mapInPandas(_sets(width), "rep long, set binary, all array<long>").dropDuplicates(["rep", "set"]).drop("set"), "sets")

    heads = lists.join(weight, "rep").groupBy("key").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("head"))
    pairs = lists.join(heads, "key").where("rep <> head").select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct()
    pairs = written(_estimated(pairs, listed, k), "pairs")
    links = written(_confirmed(pairs, sets, percent), "links")

    label = components(links)
    labelled = lists.join(label, F.col("rep") == F.col("node"), "left").select("key", "size", "rep", F.coalesce("component", "rep").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    labelled = written(labelled.join(mixed, "key", "left_semi"), "mixed")
    if labelled.isEmpty():
        return label
    # Short lists pair their members; a row meets SHORT others at most.
    short = labelled.where(F.col("size") <= SHORT).drop("size")
    other = short.select("key", F.col("rep").alias("rep2"), F.col("label").alias("label2"))
    more = short.join(other, "key").where("rep < rep2 and label <> label2").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    # Members of long ones meet by their full sets.
    members = written(labelled.where(F.col("size") > SHORT).select("rep", "label").distinct(), "members")
    if not members.isEmpty():
        more = more.union(_across(sets.join(members, "rep"), percent))
    more = written(_estimated(more.distinct(), listed, k), "pairs")
    if more.isEmpty():
        return label
    return components(written(links.union(_confirmed(more, sets, percent)), "links"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP7_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
g AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS g, min(doc_id) AS rep, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT rep, len(s) AS n, unnest(s) AS v FROM g),
p AS (SELECT x.rep AS a, y.rep AS b FROM e x JOIN e y ON x.v = y.v AND x.rep < y.rep AND y.n * 100 >= 80 * x.n AND x.n * 100 >= 80 * y.n
      GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
c AS (SELECT rep AS node, rep AS c FROM g UNION SELECT r.v, c.c FROM c JOIN r ON r.u = c.node AND c.c < r.v),
m AS (SELECT node, min(c) AS c FROM c GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id, s.doc_id = coalesce(m.c, s.doc_id) AS kept
FROM s LEFT JOIN g ON len(s.s) > 0 AND md5(array_to_string(list_sort(s.s), chr(10))) = g.g LEFT JOIN m ON m.node = g.rep
"""
