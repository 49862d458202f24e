"""Exact top-k search by inner product with no-random-access aggregation.

A block of queries is broadcast, and each task reads its candidates in place, some at a time. Their components make sorted
lists, one per dimension, read from the end that a query's sign prefers, all to the same depth. What is read, and how far,
gives every candidate a lower and an upper bound of its score. A query's bar is its k-th best score so far in the task, or
lower bound in the lists; lists whose heads can't reach it aren't read, reading stops when no outsider can, or when it rules
too few out to be worth it, and the contenders' scores are then resolved. Queries share the lists, so bounds are matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidied, written

RESULT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) per component. Those past 64 bits are held there. Vectors that are null or hold null or non-finite components go."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vectors.where(v.isNotNull() & F.col(key).isNotNull() & ~F.exists(v, bad)).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def nra(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, bar: np.ndarray | None = None, depths: tuple[float, ...] = (0.2, 0.6)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates of each query that may be among its k best: (row of q, row of x, score), all those that are and the k best at most.

    q and x are whole numbers in float64 whose products stay exact. A query's own id is left out. bar: scores under which nothing
    is asked for. depths: the parts of the lists after which bounds are taken. Ties go to the smaller id.
    """
    n, bar = len(x), np.full(len(q), -np.inf) if bar is None else bar.astype(float)
    lists = np.sort(x, axis=0)
    low, high = lists[0], lists[-1]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    signs = np.hstack([up, down])
    open_ = np.flatnonzero(up @ high + down @ low >= bar)  # what the lists' heads could give
    rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]

    def resolve(some: np.ndarray, inside: np.ndarray) -> None:
        if inside.mean() > 0.1:
            exact = q[some] @ x.T
            exact[~inside] = -np.inf
        else:
            exact = None
        for r, i in enumerate(some.tolist()):
            c = np.flatnonzero(inside[r])
            s = exact[r, c] if exact is not None else x[c] @ q[i]
            c, s = c[s >= bar[i]], s[s >= bar[i]]
            if len(c) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                c, s = c[keep], s[keep]
            order = np.lexsort((xid[c], -s))[:k]
            rows.append(np.full(len(order), i))
            cols.append(c[order])
            scores.append(s[order])

    for step, depth in enumerate(depths):
        if not len(open_):
            break
        r = min(n - 1, int(n * depth))
        # Lists from the top serve positive weights: values above the frontier are read. Those from the bottom, negative ones.
        top, bottom = lists[n - 1 - r], lists[r]
        best = np.hstack([np.maximum(x, top), np.minimum(x, bottom)])
        worst = np.hstack([np.where(x >= top, x, low), np.where(x <= bottom, x, high)])
        own = qid[open_, None] == xid[None, :]
        upper, lower = signs[open_] @ best.T, signs[open_] @ worst.T
        lower[own] = upper[own] = -np.inf
        if n > k:
            bar[open_] = np.maximum(bar[open_], np.partition(lower, n - k, axis=1)[:, n - k])
        inside = (upper >= bar[open_, None]) & ~own
        left = inside.sum(axis=1)
        ready = (left <= max(4 * k, n // 50)) | (left > n // 2) | (step + 1 == len(depths))
        if ready.any():
            resolve(open_[ready], inside[ready])
        open_ = open_[~ready]
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def exact(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for numbers whose products double precision can't hold: by whole numbers of any size, held to 64 bits."""
    s = q.astype(object) @ x.T.astype(object) if q.shape[1] else np.zeros((len(q), len(x)), object)
    s = np.clip(s, -(2**63), 2**63 - 1)
    rows, cols, scores = [], [], []
    for i in range(len(q)):
        order = sorted(np.flatnonzero(xid != qid[i]).tolist(), key=lambda j: (-s[i, j], xid[j]))[:k]
        rows += [i] * len(order)
        cols += order
        scores += [s[i, j] for j in order]
    return np.array(rows, np.int64), np.array(cols, np.int64), np.array(scores, np.int64)


class Best:
    """The k best so far of queries of one length."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q, k
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bar = np.full(len(q), -np.inf)
        self.most = float(np.abs(q.astype("f8")).max(initial=0)) * max(1, q.shape[1])

    def meet(self, xid: np.ndarray, x: np.ndarray, share: int = 512) -> None:
        small = self.most * float(np.abs(x.astype("f8")).max(initial=0)) < 2**53 and x.shape[1] > 0
        for lo in range(0, len(self.q), share):
            part = slice(lo, lo + share)
            if small:
                i, j, s = nra(self.q[part].astype("f8"), self.qid[part], x.astype("f8"), xid, self.k, self.bar[part])
            else:
                i, j, s = exact(self.q[part], self.qid[part], x, xid, self.k)
            self.row, self.id, self.score = np.concatenate([self.row, i + lo]), np.concatenate([self.id, xid[j]]), np.concatenate([self.score, s.astype("i8")])
        order = np.lexsort((self.id, -self.score, self.row))
        row = self.row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[place < self.k]
        full = order[place == self.k - 1]
        self.bar[self.row[full]] = self.score[full].astype("f8") if small else -np.inf
        self.row, self.id, self.score = self.row[keep], self.id[keep], self.score[keep]


def _searched(sent, k: int, block: int):
    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[int, list] = {}
        for i, v in sent.value:
            asked.setdefault(len(v), []).append((i, v))
        best = {n: Best(np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.int64).reshape(len(rows), n), k) for n, rows in asked.items()}
        waiting: dict[int, list] = {n: [] for n in best}

        def meet(n: int) -> None:
            if waiting[n]:
                best[n].meet(np.array([i for i, _ in waiting[n]], np.int64), np.stack([v for _, v in waiting[n]]).astype("i8").reshape(len(waiting[n]), n))
                waiting[n].clear()

        for b in batches:
            for i, v in zip(b["id"], b["v"]):
                if (rows := waiting.get(len(v))) is not None:
                    rows.append((i, v))
                    if len(rows) >= block:
                        meet(len(v))
        for n, x in best.items():
            meet(n)
            yield pd.DataFrame({"query_id": x.qid[x.row], "vec_id": x.id, "score": x.score})

    return run


def blocks(queries: DataFrame, size: int) -> Iterator[list[tuple[int, list[int]]]]:
    """The queries in lists of at most size; the driver holds one, and what goes with it by hash, at a time."""
    parts = -(-queries.count() // max(1, size // 2))
    for p in range(parts):
        rows = [tuple(r) for r in queries.select("id", "v").where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == p).collect()]
        for lo in range(0, len(rows), size):
            yield rows[lo : lo + size]


def search(queries: DataFrame, candidates: DataFrame, k: int, block: int = 2048, query_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over candidates of other ids.

    queries, candidates: (id, v) of quantised(). Vectors meet those of equal length only. Ties go to the smaller id. Rows
    that repeat an id with the same vector count as rows each. Without queries or candidates the result is empty. Scores
    that no long holds count as the nearest long, so that they tie; components are held to longs as well. At most query_block queries are broadcast at a time, for one pass
    over the candidates, which aren't moved; a task holds block of these and k rows a query, and only the latter are shuffled.
    """
    spark, found = queries.sparkSession, []
    for rows in blocks(queries, query_block):
        near = candidates.select("id", "v").mapInPandas(_searched(spark.sparkContext.broadcast(rows), k, block), RESULT)
        if found:
            found[-1] = written(found[-1], "near")
        found.append(near)
    near = reduce(DataFrame.union, found) if found else spark.createDataFrame([], RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = written(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return search(v.where(F.col("id") % 50 == 0), v, 5)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
