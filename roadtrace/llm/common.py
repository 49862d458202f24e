"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where a local master has none set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="roadtrace-")
    return _LOCAL[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, has no lineage and outlives lost executors.

    Tables lie in a folder of the application, which can be deleted once its results are written.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch on its way to Python. By the usual row count alone, batches of long texts take GBs on both sides.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH_BYTES and the row that passes it, unless the user has set a size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def tidied(run):
    """An iterator function for Python workers that, when a task ends, gives memory back that the worker would keep for the next one.

    Workers live on over tasks and stages; what each leaves behind would add up in an executor.
    """

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


#: Up to so many ids (8 bytes each) are broadcast to pick rows; more are joined.
MOST_IDS = 1_000_000


def picked(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """docs joined left_semi or left_anti with a written table of ids (key); few are broadcast, so docs aren't shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, key, how)


def unused(df: DataFrame) -> str:
    """A prefix that no column of df begins with, whatever its case: for columns that an operator adds and drops again."""
    prefix = "x_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "x" + prefix
    return prefix


#: So many matches are placed together. Arrays that grow by one element are copied each time, so they are kept this short.
BLOCK = 256


def matches(df: DataFrame, text: str, rules: dict[str, tuple[str, Column]], prefix: str = "m_", before: int = 0) -> DataFrame:
    """Adds column `<prefix><kind>` per rule: array<struct<start,end,hit>> of the leftmost non-overlapping matches.

    rules: kind -> (Java pattern that never matches the empty string, cheap column that is false only where nothing
    can match). Offsets are code points, end exclusive. The text between matches comes from split() and the matches
    from regexp_extract_all(); sums of their lengths, first by blocks of matches and then within blocks, give the
    offsets without a Python worker, in time that grows with the text. With before, a match also has `near`: up to so many
    code points before it, back to the match before. A null text counts as empty.
    """
    x, shape = unused(df), "struct<start:int,end:int,hit:string,near:string>" if before else "struct<start:int,end:int,hit:string>"
    cut, steps = {}, [{}, {}, {}]
    for kind, (pattern, maybe) in rules.items():
        may, piece = F.coalesce(maybe, F.lit(False)), (lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(before)).alias("near"))) if before else (lambda p: F.struct(F.length(p).alias("n")))
        cut[f"{x}h_{kind}"] = F.when(may, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
        cut[f"{x}g_{kind}"] = F.when(may, F.transform(F.split(F.col(text), pattern, -1), piece))
        h, g, b, o = (f"`{x}{c}_{kind}`" for c in "hgbo")
        near = f", 'near', b.g[i].near" if before else ""
        steps[0][f"{x}b_{kind}"] = F.expr(f"transform(sequence(0, (size({h}) - 1) div {BLOCK}), k -> named_struct('h', slice({h}, k * {BLOCK} + 1, {BLOCK}), 'g', slice({g}, k * {BLOCK} + 1, {BLOCK})))")
        steps[1][f"{x}o_{kind}"] = F.expr(
            f"""aggregate({b}, named_struct('p', 0, 'o', cast(array() as array<int>)), (a, b) -> named_struct(
                'p', a.p + aggregate(b.h, 0, (n, s) -> n + length(s)) + aggregate(slice(b.g, 1, size(b.h)), 0, (n, s) -> n + s.n), 'o', array_append(a.o, a.p)), a -> a.o)"""
        )
        steps[2][f"{prefix}{kind}"] = F.expr(
            f"""if(coalesce(size({h}), 0) < 1, cast(array() as array<{shape}>), flatten(zip_with({b}, {o}, (b, p) -> aggregate(sequence(0, size(b.h) - 1),
                named_struct('p', p, 'o', cast(array() as array<{shape}>)), (a, i) -> named_struct('p', a.p + b.g[i].n + length(b.h[i]), 'o', array_append(a.o,
                named_struct('start', a.p + b.g[i].n, 'end', a.p + b.g[i].n + length(b.h[i]), 'hit', b.h[i]{near}))), a -> a.o))))"""
        )
    df = df.withColumns(cut)
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*[f"{x}{c}_{kind}" for c in "hgbo" for kind in rules])


def _named(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])


def _placed(kind: str, rank: int):
    return lambda s: F.struct(s["start"].alias("s"), F.lit(rank).alias("k"), _named(kind)(s).alias("t"))


def spans_text(kinds: list[str], by_start: bool, prefix: str = "m_") -> Column:
    """kind:start:end of the kept matches `<prefix><kind>`, comma-joined: by kind then start, or by start then kind."""
    if by_start:
        every = F.concat(*[F.transform(f"{prefix}{k}", _placed(k, i)) for i, k in enumerate(kinds)])
        return F.array_join(F.transform(F.array_sort(every), lambda s: s["t"]), ",")
    return F.array_join(F.concat(*[F.transform(f"{prefix}{k}", _named(k)) for k in kinds]), ",")


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one partition as stars: each node with the smallest one that the partition's own links reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist()):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > 500_000:  # what a task holds stays bounded; later rounds join what is given out here
            yield _stars(root, find)
            root.clear()
    yield _stars(root, find)


def _stars(root: dict[int, int], find) -> pd.DataFrame:
    u = [x for x in root if find(x) != x]
    return pd.DataFrame({"u": u, "v": [find(x) for x in u]}, dtype="int64")


#: Links that one task contracts at once.
PACK = 200_000


def _stars_of(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The links of a written table contracted within packs of PACK, and whether one pack held all of them."""
    packs = max(1, -(-edges.count() // PACK))
    found = edges.coalesce(packs).mapInPandas(_contracted, "u long, v long")
    return written(found if packs == 1 else found.distinct(), "links"), packs == 1


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge. Edges are undirected, in a written table.

    Links are contracted within packs, then large-star and small-star steps alternate (Kiveris et al., 2014), which
    settle in about log(n) rounds; each round's links are written to the shared folder. What fits in a pack takes none.
    """
    links, done = _stars_of(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    for _ in range(rounds):
        # A forest of stars: no node has two smaller neighbours, or both a smaller and a larger one.
        ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
        if done or ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        sym = links.union(links.select("v", "u"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links, done = _stars_of(written(small.distinct(), "stars"))
    raise RuntimeError("components did not settle")
