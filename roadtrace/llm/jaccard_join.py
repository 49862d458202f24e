"""Exact n-gram Jaccard join by set-relation skipping.

1. Texts with equal shingle sets form a class; the rest works on classes, named by their smallest doc_id.
2. A set that holds more values of its own than the asked similarity lets two sets differ in is similar to none. A part of all values, those
   with the least hashes, is dealt out by ranges in sorted blobs to find these sets, which in prose are most; the others' values are counted exactly.
   Values have one global order, rare ones first. Two sets of the asked similarity share one of each one's first n - ceil(percent * n) + 1
   values, so inverted lists of these (class, set size, position) find every pair. Values of one set only aren't listed.
3. Answers of similar sets first: the member of a list with the least position, whose values few other values precede, is the
   list's head. Members are verified against heads, which leaves with every linked class a base: a head whose overlap is known.
4. Lists go on whose members are still in several components. They are cut into blocks of one component and set size, sorted
   by position. A probe skips blocks of its own component, blocks whose size or first position rules them out, and in the others
   the entries from the first position on that is too late. Of each pair that is met, here and with heads, bits of parity tell how much the sets
   must differ at least, which rules most wrong ones out.
5. Answers of the pairs that are left derive from their bases': |a n b| lies between |A n B| less what a and b lack of their bases A
   and B, and |A n B| plus what they have besides. Pairs that this leaves open, and only these, are verified on full sets.

All links between different components are found, so the components are exact. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MOST_IDS, components, picked, small_batches, table, tidied, written
from .near_dedup import _digest as digest
from .near_dedup import shingles

#: Entries of one block; more are dealt out over several.
BLOCK = 1024
#: Values that a task sorts at once, values of one range on average, ranges for each part of their counts, and the bits of a hash that are dealt.
HELD, RANGE, RANGES, KEY = 2_000_000, 1_000_000, 4, 40
#: Places of the parities, 64 to a number.
PLACES = 1024


def _features(width: int):
    """Each text's set size and digest."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, width) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "n": [len(s) for s in sets], "set": [digest(s) for s in sets]})

    return run


def _planes(a: np.ndarray) -> bytes:
    """int64 numbers by bytes of the same weight: those of high weight are alike and pack well in a shuffle."""
    return a.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


def _dealt(width: int, percent: int, ranges: int):
    """(part, keys, holders, reps, over): sorted keys by range with the class that holds each, -1 where the task has it in several; and in rows of
    their own, for each class, how many of its keys the task has in others too, less how many might be before it can be left out."""
    top = _sixteenths(percent) << KEY - 4

    def blobs(keys: list[np.ndarray], reps: list[int], spare: list[int]) -> pd.DataFrame:
        rep, size = np.array(reps, np.int64), [len(k) for k in keys]
        every, owner = np.concatenate(keys), np.repeat(np.arange(len(rep)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first, n = _runs(every)
        seen = np.bincount(owner[np.repeat(n > 1, n)], minlength=len(rep))
        every, holder = every[first], np.where(n == 1, rep[owner[first]], -1)
        ends = np.searchsorted(every * ranges // top, np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(ends))
        rows = [(r, _planes(np.diff(every[ends[r] : ends[r + 1]], prepend=0)), _planes(holder[ends[r] : ends[r + 1]]), b"", b"") for r in some.tolist()]
        rows.append((reps[0] % ranges, b"", b"", _planes(rep), _planes(seen - np.array(spare, np.int64))))
        return pd.DataFrame(rows, columns=["part", "keys", "holders", "reps", "over"])

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, reps, spare, held = [], [], [], 0
        for b in batches:
            for rep, want, s in zip(b["rep"].tolist(), b["set"], (shingles(t, width) for t in b["text"])):
                if digest(s) == want:
                    k = (s.view(np.uint64) >> np.uint64(64 - KEY)).astype(np.int64)
                    keys.append(k[k < top])
                    reps.append(rep)
                    spare.append(len(keys[-1]) - _asked(len(s), percent))
                    held += len(keys[-1])
                if held >= HELD:
                    yield blobs(keys, reps, spare)
                    keys, reps, spare, held = [], [], [], 0
        if reps:
            yield blobs(keys, reps, spare)

    return run


def _sixteenths(percent: int) -> int:
    """The part of all values that is dealt: somewhat over twice the part in which two sets may differ."""
    return min(16, max(1, -(-(100 - percent) * 34 // 100)))


def _asked(n: int, percent: int) -> int:
    """How many values a set is asked for by: two similar sets share one of each one's first so many."""
    return n + 1 - -(-percent * n // 100)


def _shared(targets: int):
    """(part, reps, over), a row for each target: of the classes that are dealt there, how many keys of one range they share with others, and the tasks' own rows."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(_unplaned(k)) for k in b["keys"]])
        holder = np.concatenate([_unplaned(h) for h in b["holders"]])
        order = np.argsort(keys, kind="stable")
        _, n = _runs(keys[order])
        found = holder[order][np.repeat(n > 1, n)]
        rep, over = np.unique(found[found >= 0], return_counts=True)
        own = [np.concatenate([_unplaned(x) for x in b[c]]) for c in ("reps", "over")]
        rep, over = np.r_[rep, own[0]], np.r_[over, own[1]]
        target = ((rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % targets
        order = np.lexsort((rep, target))
        rep, over = rep[order], over[order]
        at, n = _runs(target[order])
        rows = [(t, _planes(np.diff(rep[i : i + k], prepend=0)), _planes(over[i : i + k])) for t, i, k in zip(target[order][at].tolist(), at.tolist(), n.tolist())]
        return pd.DataFrame(rows, columns=["part", "reps", "over"])

    return run


def _left(b: pd.DataFrame) -> pd.DataFrame:
    """(rep): the classes of one target whose counts come to more than nothing."""
    rep, at = np.unique(np.concatenate([np.cumsum(_unplaned(x)) for x in b["reps"]]), return_inverse=True)
    over = np.zeros(len(rep), np.int64)
    np.add.at(over, at, np.concatenate([_unplaned(x) for x in b["over"]]))
    return pd.DataFrame({"rep": rep[over > 0]})


def _parities(s: np.ndarray) -> np.ndarray:
    """For each of PLACES hashed places, whether an odd number of the set's values falls there. Two sets differ in as many values as places, or more."""
    at = ((s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % PLACES
    return np.packbits(np.bincount(at, minlength=PLACES) & 1).view(np.int64)


def _wholes(width: int):
    """(rep, n, all, marks): full sets and their parities."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(rep, len(s), s, _parities(s)) for rep, want, s in zip(b["rep"], b["set"], (shingles(t, width) for t in b["text"])) if digest(s) == want]
            yield pd.DataFrame(rows, columns=["rep", "n", "all", "marks"])

    return run


class Texts:
    """The texts that name classes, by class."""

    def __init__(self, docs: DataFrame, rows: DataFrame, named: DataFrame, width: int):
        self.docs, self.width = docs.where("doc_id is not null"), width
        self.named = named.select(F.col("row").alias("rep"), F.col("rep").alias("doc_id"), "set")
        self.repeated = not rows.where("n > 0").groupBy("doc_id", "set").count().where("count > 1").isEmpty()

    def mapped(self, run, schema: str, ids: DataFrame | None = None) -> DataFrame:
        """run over (rep, set, text) of all classes, or those of ids (rep); a class may come twice where rows repeat."""
        named = self.named if ids is None else self.named.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "rep", "left_semi")
        met = self.docs.join(F.broadcast(named) if named.count() <= MOST_IDS else named, "doc_id").select("rep", "set", "text")
        return met.mapInPandas(run, schema)

    def open(self, values: int, percent: int) -> DataFrame:
        """The classes (rep) that may be similar to others, a written table; values: how many their sets hold, about."""
        ranges = values * _sixteenths(percent) // 16 // RANGE + 1
        dealt = self.mapped(_dealt(self.width, percent, ranges), "part long, keys binary, holders binary, reps binary, over binary")
        shared = dealt.groupBy("part").applyInPandas(_shared(ranges // RANGES + 1), "part long, reps binary, over binary")
        return written(shared.groupBy("part").applyInPandas(_left, "rep long"), "open")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(rep, n, all, marks) of the classes ids (rep)."""
        found = self.mapped(_wholes(self.width), "rep long, n long, all array<long>, marks array<long>", ids)
        return found.dropDuplicates(["rep"]) if self.repeated else found


def _alike(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _need(percent: int) -> Column:
    """The least overlap of similar sets of n and m values."""
    return F.expr(f"((n + m) * {percent} + {99 + percent}) div {100 + percent}")


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """pairs (a, n, b, m) whose parities don't show that the sets differ too much."""
    met = pairs.join(marks.select(F.col("rep").alias("a"), F.col("marks").alias("x")), "a").join(marks.select(F.col("rep").alias("b"), F.col("marks").alias("y")), "b")
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, c: n + c)
    return met.where(differ <= F.col("n") + F.col("m") - 2 * _need(percent)).select("a", "n", "b", "m")


def _overlaps(pairs: DataFrame, sets) -> DataFrame:
    """pairs (a, b, ...), a written table, with `both`: the overlap of the full sets. sets(ids) gives the sets that pairs name."""
    named = sets(written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ids"))
    with_a = named.select(F.col("rep").alias("a"), F.col("all").alias("sa")).join(pairs, "a")
    both = with_a.join(named.select(F.col("rep").alias("b"), F.col("all").alias("sb")), "b")
    return both.withColumn("both", F.size(F.array_intersect("sa", "sb"))).drop("sa", "sb")


def joined(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n, rep), and links (a, b) between classes.

    The links join up the classes that similar sets connect: between any two classes of a component there is a path of links, each of
    which holds 100 * intersection >= percent * union. Not every pair of a component is listed: it could hold all pairs of a hot group.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Ids travel as text: pandas would turn whole numbers beside nulls into doubles.
    found = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_features(width), "doc_id string, n long, set binary")
    rows = written(found.withColumns({"doc_id": F.col("doc_id").cast("long"), "row": F.monotonically_increasing_id()}), "rows")
    first = F.min(F.struct(F.col("doc_id").alias("rep"), "row"))
    named = written(rows.where("n > 0 and doc_id is not null").groupBy("set").agg(first.alias("at")).select("set", "at.rep", "at.row"), "classes")
    member = rows.select("doc_id", "n", "set").join(named.select("set", "rep"), "set", "left").drop("set")
    links = _class_links(Texts(docs, rows, named, width), rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], percent)
    side = lambda c: named.select(F.col("row").alias(c), F.col("rep").alias(f"{c}_rep"))
    links = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    # Classes of texts that share an id.
    several = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    same = member.join(written(several.select("doc_id", "low"), "several"), "doc_id").where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    return member, written(links.union(same), "links")


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """(v, rep, n, p) of the values that several sets (rep, n, all) hold, as far as they are among a set's first; p counts from 0."""
    values = sets.select("rep", "n", F.explode("all").alias("v"))
    held = values.join(values.groupBy("v").agg(F.count("*").alias("often")).where("often > 1"), "v")
    own = Window.partitionBy("rep")
    held = held.withColumns({"place": F.row_number().over(own.orderBy("often", "v")), "held": F.count("*").over(own)})
    # Values of one set only come first in the order.
    held = held.withColumn("p", (F.col("n") - F.col("held") + F.col("place") - 1).cast("int"))
    return held.where(f"p < n + 1 - ({percent} * n + 99) div 100").select("v", "rep", "n", "p")


def _class_links(texts: Texts, values: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, each named by one of its rows. Here `rep` is that row: ids may repeat."""
    sets = written(texts.sets(texts.open(values, percent)), "sets")
    some = lambda ids: picked(sets, ids, "left_semi", "rep")
    marks = sets.select("rep", "marks")
    entries = written(_entries(sets, percent), "entries")
    heads = entries.groupBy("v").agg(F.count("*").alias("size"), F.min(F.struct("p", "rep", "n")).alias("head")).where("size > 1")
    lists = written(entries.join(heads, "v").select("v", "rep", "n", "p", "size", F.col("head.rep").alias("head"), F.col("head.n").alias("m"), F.col("head.p").alias("q")), "lists")

    near = lists.where(_alike(F.col("n"), F.col("m"), percent) & (F.col("rep") != F.col("head")) & (F.least(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= _need(percent)))
    pairs = written(_possible(near.select(F.col("rep").alias("a"), "n", F.col("head").alias("b"), "m").distinct(), marks, percent), "pairs")
    star = written(_overlaps(pairs, some).where((F.col("n") + F.col("m") - F.col("both")) * percent <= F.col("both") * 100), "star")
    links = written(star.select("a", "b"), "links")
    nearest = F.max_by(F.struct("b", "both", "m"), F.struct(F.try_divide(F.col("both"), F.col("n") + F.col("m") - F.col("both")), -F.col("b")))
    bases = written(star.groupBy("a", "n").agg(nearest.alias("h")).select(F.col("a").alias("rep"), F.col("h.b").alias("base"), (F.col("n") - F.col("h.both")).alias("more"), (F.col("h.m") - F.col("h.both")).alias("less")), "bases")

    label = components(links)
    labelled = lists.select("v", "rep", "n", "p", "size").join(label, F.col("rep") == F.col("node"), "left").select("v", "rep", "n", "p", "size", F.coalesce("component", "rep").alias("label"))
    labelled = written(labelled, "labelled")
    mixed = labelled.groupBy("v").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("v")
    open_ = written(labelled.join(mixed, "v", "left_semi"), "open")
    pairs = written(_possible(_open_pairs(open_, percent), marks, percent), "pairs")
    if pairs.isEmpty():
        return links
    return links.union(_derived(pairs, bases, some, percent))


def _open_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, n, b, m) of different labels that sizes and positions in the lists of entries don't rule out."""
    # The label with most entries of a list only probes: all pairs of two labels have one that isn't it.
    main = entries.groupBy("v", "label").count().groupBy("v").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = entries.join(main, "v").where("label <> main")
    deal = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK))
    blocks = rest.groupBy("v", F.col("label").alias("label2"), F.col("n").alias("m"), deal.alias("deal")).agg(F.array_sort(F.collect_list(F.struct("p", "rep"))).alias("block"))
    met = entries.join(blocks.drop("deal"), "v").where((F.col("label") != F.col("label2")) & _alike(F.col("n"), F.col("m"), percent))
    # The first value that two sets have in common leaves at most the values from it on to share.
    met = met.withColumn("need", _need(percent)).where((F.col("n") - F.col("p") >= F.col("need")) & (F.col("m") - F.col("block")[0]["p"] >= F.col("need")))
    late = F.expr("filter(block, e -> m - e.p >= need)")
    met = met.select("rep", "n", "m", F.explode(late).alias("e"))
    swap = F.col("rep") > F.col("e.rep")
    return met.select(F.least("rep", "e.rep").alias("a"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n"), F.greatest("rep", "e.rep").alias("b"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("m")).distinct()


def _derived(pairs: DataFrame, bases: DataFrame, sets, percent: int) -> DataFrame:
    """The links (a, b) among pairs (a, n, b, m), a written table."""
    side = lambda c: bases.select(F.col("rep").alias(c), F.col("base").alias(f"{c}_base"), F.col("more").alias(f"{c}_more"), F.col("less").alias(f"{c}_less"))
    based = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    based = based.withColumns({f"{c}_base": F.coalesce(f"{c}_base", c) for c in "ab"} | {f"{c}_{x}": F.coalesce(f"{c}_{x}", F.lit(0)) for c in "ab" for x in ("more", "less")})
    based = written(based.withColumns({"x": F.least("a_base", "b_base"), "y": F.greatest("a_base", "b_base"), "need": _need(percent)}), "based")
    known = _overlaps(written(based.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "basepairs"), sets)
    known = known.select(F.col("a").alias("x"), F.col("b").alias("y"), "both")
    bound = based.join(known, ["x", "y"]).withColumns({"low": F.expr("both - a_less - b_less"), "high": F.expr("both + a_more + b_more")})
    bound = written(bound.where("high >= need").select("a", "b", "need", "low"), "bounds")
    left = written(bound.where("low < need").drop("low"), "left")
    return bound.where("low >= need").select("a", "b").union(_overlaps(left, sets).where("both >= need").select("a", "b"))


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs (doc_id, text; other columns are not looked at).

    Links join texts whose sets of width-word shingles have 100 * intersection >= percent * union; component_id is the
    smallest doc_id that links reach. Null and empty texts, and texts of white space, have no shingles and are linked with nothing.
    Rows that repeat an id are one node; texts that share an id count as linked. A null id is its own or its copies'
    component, null where there is none with an id. An empty table gives an empty one.
    """
    member, links = joined(docs, width, percent)
    label = components(links)
    out = member.join(label, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS g, min(doc_id) AS rep, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT rep, len(s) AS n, unnest(s) AS v FROM g),
p AS (SELECT x.rep AS a, y.rep AS b FROM e x JOIN e y ON x.v = y.v AND x.rep < y.rep AND y.n * 100 >= 80 * x.n AND x.n * 100 >= 80 * y.n
      GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
c AS (SELECT rep AS node, rep AS c FROM g UNION SELECT r.v, c.c FROM c JOIN r ON r.u = c.node AND c.c < r.v),
m AS (SELECT node, min(c) AS c FROM c GROUP BY node)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id
FROM s LEFT JOIN g ON len(s.s) > 0 AND md5(array_to_string(list_sort(s.s), chr(10))) = g.g LEFT JOIN m ON m.node = g.rep
"""
