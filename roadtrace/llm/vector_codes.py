"""Vector code compression: product quantisation of whole numbers by weighted Lloyd over distinct parts.

1. Components become whole numbers, and vectors are cut into equal parts. Equal parts at one position are one row with a
   weight, so a round's work depends on distinct parts only.
2. Each round, tasks assign their distinct parts to the nearest entry of the broadcast codebooks and add up weights and weighted
   components by entry. Spark adds these up, and the driver gets one number for each component of each entry.
3. Final codes and errors of distinct parts are joined back to the vectors. Parts that many vectors share are broadcast, of
   which there can only be few, and the others meet by a shuffle.

All sums are of whole numbers: int64 where no product can pass it, Python's whole numbers elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_IDS, table, tidied, written

#: Whole numbers are held to this size, up to which doubles are exact.
MOST = 2**53
#: A key that more than one in HEAVY rows has is broadcast. So there are under HEAVY such keys at each position.
HEAVY = 1000


def _bytes(part: np.ndarray) -> bytes:
    """A part in the narrowest of 2, 4 and 8 bytes a component, so that equal parts have equal bytes."""
    most = max(int(part.max()), ~int(part.min()))
    return part.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _rows(parts: list[bytes], width: int) -> np.ndarray:
    """Parts of `width` components as rows; of Python's whole numbers where products could pass 64 bits."""
    out = np.empty((len(parts), width), np.int64)
    for i, p in enumerate(parts):
        out[i] = np.frombuffer(p, f"<i{len(p) // width}")
    return _safe(out)


def _safe(x: np.ndarray) -> np.ndarray:
    return x if np.abs(x).max(initial=0) < 1 << 27 and x.shape[1] <= 128 else x.astype(object)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry by squared Euclidean distance, the first of equally near ones, and that distance."""
    x, entries = (x.astype(object), entries.astype(object)) if object in (x.dtype, entries.dtype) else (x, entries)
    far = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    code = np.argmin(far, axis=1)
    return code, far[np.arange(len(x)), code]


def _cut(size: int, cuts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = size // cuts
        for b in batches:
            rows = [[_bytes(v[i : i + width]) for i in range(0, size, width)] if size and size % cuts == 0 and len(v) == size else None for v in b["v"]]
            yield b.drop(columns="v").assign(parts=rows)

    return run


def _tallied(sent, width: int):
    """(pos, code, at, n, total): weights and weighted components of each entry's parts."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = sent.value
        count = np.zeros((len(books), len(books[0])), object)
        total = np.zeros((len(books), len(books[0]), width), object)
        for b in batches:
            for pos, g in b.groupby("pos"):
                x, w = _rows(g["part"].tolist(), width), g["w"].to_numpy(np.int64)
                code, _ = nearest(x, books[pos])
                if x.dtype == object or int(np.abs(x).max(initial=0)) * int(w.sum()) >= 1 << 62:
                    x, w = x.astype(object), w.astype(object)
                for c in np.unique(code).tolist():
                    own = code == c
                    count[pos, c] += int(w[own].sum())
                    total[pos, c] += (x[own] * w[own, None]).sum(axis=0)
        rows = [(p, c, i, int(count[p, c]), Decimal(int(total[p, c, i]))) for p in range(len(books)) for c in range(len(books[0])) if count[p, c] for i in range(width)]
        yield pd.DataFrame(rows, columns=["pos", "code", "at", "n", "total"])

    return run


def _coded(sent, width: int):
    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pos, g in b.groupby("pos"):
                code, far = nearest(_rows(g["part"].tolist(), width), sent.value[pos])
                error = pd.array([int(d) if d < 1 << 63 else None for d in far], "Int64")
                yield pd.DataFrame({"pos": pos, "part": g["part"].to_numpy(), "w": g["w"].to_numpy(), "code": code, "err": error})

    return run


def lloyd(distinct: DataFrame, books: list[np.ndarray], width: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after some rounds over distinct (pos, part, w), a written table. Entries without parts stay."""
    spark = distinct.sparkSession
    for _ in range(rounds):
        sums = distinct.mapInPandas(_tallied(spark.sparkContext.broadcast(books), width), "pos int, code int, at int, n long, total decimal(38,0)")
        new = [b.astype(object) for b in books]
        for r in sums.groupBy("pos", "code", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            new[r["pos"]][r["code"], r["at"]] = int(r["total"]) // r["n"]
        books = [_safe(b.astype(np.int64)) for b in new]
    return books


def met(rows: DataFrame, values: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with values (keys, weight, ...) on keys, nulls equal. Values of more than one in HEAVY of total are broadcast."""
    on = lambda a, b: [a[k].eqNullSafe(b[f"{k}_"]) for k in keys]
    values = values.withColumnsRenamed({k: f"{k}_" for k in keys})
    often = F.col(weight) * HEAVY > total
    heavy, light = F.broadcast(values.where(often)), values.where(~often)
    rest = rows.join(heavy.select(*[f"{k}_" for k in keys]), on(rows, heavy), "left_anti")
    return rows.join(heavy, on(rows, heavy)).unionByName(rest.join(light, on(rest, light))).drop(weight, *[f"{k}_" for k in keys])


def _whole(x: Column, scale: int) -> Column:
    return F.floor(F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(float(MOST))), F.lit(-float(MOST))))


def compressed(vectors: DataFrame, cuts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 per vector; vectors that are null or hold null or non-finite components go.

    Components become floor(scale * x), held to 2^53 either way. Codebooks begin with the parts of the `entries` vectors of smallest key
    (null keys last, equal keys by their parts; fewer where there are fewer). Rows that repeat count as often. Vectors whose length isn't that of
    the first of these, or no multiple of cuts, have a null code and error, and take no part. Errors, and sums of them, that no
    long holds are null. label_error sums the errors of rows with equal labels, null ones together. An empty table gives an empty one.
    """
    spark, v = vectors.sparkSession, F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    kept = vectors.where(v.isNotNull() & ~F.exists(v, bad))
    # Ids and labels travel as text: pandas would turn whole numbers beside nulls into doubles.
    plain = kept.select(F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("label"), F.transform(v, lambda x: _whole(x, scale)).alias("v"))
    order = [F.col("id").cast("long").asc_nulls_last(), "v"]
    first = [np.array(r["v"], np.int64) for r in plain.orderBy(*order).limit(entries).collect()]
    size = len(first[0]) if first else 0
    first = [f for f in first if len(f) == size]
    rows = plain.mapInPandas(_cut(size, cuts), "id string, label string, parts array<binary>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    if not size or size % cuts:
        none = F.lit(None).cast("string")
        return rows.select(F.col("id").cast("long").alias(key), none.alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), none.alias("codebooks_sha256"))

    width = size // cuts
    each = rows.select("row", F.posexplode("parts").alias("pos", "part"))
    distinct = written(each.groupBy("pos", "part").agg(F.count("*").alias("w")), "distinct")
    books = lloyd(distinct, [_safe(np.array([f[p * width : (p + 1) * width] for f in first], np.int64)) for p in range(cuts)], width, rounds)
    coded = written(distinct.mapInPandas(_coded(spark.sparkContext.broadcast(books), width), "pos int, part binary, w long, code int, err long"), "coded")
    text = ",".join(str(int(x)) for b in books for e in b for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()

    total = rows.count()
    pieces = met(each, coded, ["pos", "part"], "w", total).withColumn("hex", F.lower(F.lpad(F.hex("code"), 2, "0")))
    codes = pieces.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hex"))), lambda s: s["hex"]), "").alias("code"),
        F.when(F.count("err") == cuts, F.try_sum("err")).alias("error"),
    )
    done = written(rows.drop("parts").join(codes, "row", "left"), "codes")
    labels = done.groupBy("label").agg(F.count("*").alias("m"), F.when(F.count("error") == F.count("code"), F.try_sum("error")).alias("label_error"))
    out = met(done, labels, ["label"], "m", total)
    return out.select(F.col("id").cast("long").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql(cuts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    far = "CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT p.vec_id, p.pos, p.x, min(struct_pack(far := {far}, entry := b.entry)) AS near FROM p JOIN b{i} b ON b.pos = p.pos GROUP BY ALL)"
    ctes = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, pos, v[pos * (len(v) // {cuts}) + 1:(pos + 1) * (len(v) // {cuts})] AS x FROM v, (SELECT unnest(range(0, {cuts})) AS pos))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT pos, entry, x FROM p JOIN f USING (vec_id))",
    ]
    for i in range(rounds):
        ctes += [
            near(i),
            f"s{i} AS (SELECT pos, near.entry AS entry, k, sum(x[k])::HUGEINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS k) GROUP BY ALL)",
            f"b{i + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT pos, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS x FROM s{i} GROUP BY ALL) n ON n.pos = b.pos AND n.entry = b.entry)",
        ]
    ctes += [
        near(rounds),
        f"e AS (SELECT vec_id, string_agg(lpad(lower(to_hex(near.entry)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(near.far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (vec_id), h"


OP13_SQL = _sql()
