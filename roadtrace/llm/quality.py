"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed byte pairs and three signs of style, weighted by inverse document frequency. The
principal directions of a bounded labelled sample turn those into short latent vectors. The sample's vectors are broadcast; every
document's cosine with each of them is computed in blocks, and the nearest vote with their similarity as weight.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidied

TERMS = 2048  # hashed byte pairs; the last three are taken by the signs of style
#: The bound of the sample: so many labelled rows of each label at most, those with the smallest hash of their id.
PER_LABEL = 2000
THRESHOLD = 0.3


def terms(text: str | None) -> np.ndarray:
    """Square roots of the counts in the whole text."""
    b = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    h = ((b[:-1] * 256 + b[1:]) * np.uint32(2654435761)) >> np.uint32(21)
    f = np.sqrt(np.bincount(h, minlength=TERMS)).astype(np.float32)
    w = (text or "").split()
    # A word twice in a row, words in capitals, and words that are all symbols or digits.
    f[-3:] = 4 * max(0, sum(map(str.__eq__, w, w[1:])) - 1) ** 0.5, 2 * sum(map(str.isupper, w)) ** 0.5, sum(not x.isalpha() for x in w) ** 0.5
    return f


@dataclass
class Voters:
    weights: np.ndarray  # inverse document frequency per term
    mean: np.ndarray
    axes: np.ndarray  # terms x latent dimensions
    vectors: np.ndarray  # sample x latent dimensions, unit length
    labels: np.ndarray
    rate: float  # of label 1 among all labelled rows
    k: int
    prior: float

    def latent(self, f: np.ndarray) -> np.ndarray:
        return _unit((_unit(f * self.weights) - self.mean) @ self.axes)

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.rate)
        if not len(self.labels):
            return out
        for lo in range(0, len(texts), block):
            part = texts[lo : lo + block]
            some = [i for i, t in enumerate(part) if t and not t.isspace()]
            if not some:
                continue
            cosine = self.latent(np.stack([terms(part[i]) for i in some])) @ self.vectors.T
            k = min(self.k, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 0)
            out[[lo + i for i in some]] = ((w * self.labels[near]).sum(1) + self.prior * self.rate) / (w.sum(1) + self.prior)
        return out.clip(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, latent: int = 24, k: int = 25, prior: float = 2.0) -> Voters:
    """Learns from the labelled rows of docs whose crc32(doc_id) mod 5 is not 0.

    The sample has at most per_label rows of each label. One task, whose input that bounds, makes the model from the sample's
    term counts; the driver gets the short vectors only. An id with several labels takes the smallest, one with several
    texts the first in order; null ids, labels and texts are left out. Without labels every score is 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.5
    none = Voters(*[np.zeros((0, 0))] * 4, np.zeros(0), rate, k, prior)
    if not counts:
        return none
    pick = reduce(DataFrame.union, [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in sorted(counts)])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(pick), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = texts.select("doc_id", "y", F.pandas_udf(_counted, "binary")("text").alias("f"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        weights, mean, axes, vectors = _learnt([np.frombuffer(f, np.float16) for f in rows["f"]], latent)
        return pd.DataFrame({"weights": [weights.tobytes()], "mean": [mean.tobytes()], "axes": [axes.tobytes()], "vectors": [vectors.tobytes()], "labels": [rows["y"].to_numpy("f4").tobytes()]})

    made = sample.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "weights binary, mean binary, axes binary, vectors binary, labels binary").collect()
    if not made:
        return none
    weights, mean, axes, vectors, y = (np.frombuffer(x, np.float32) for x in made[0])
    return Voters(weights, mean, axes.reshape(TERMS, -1), vectors.reshape(len(y), -1), y, rate, k, prior)


def _learnt(counts: list[np.ndarray], latent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights, mean, axes, vectors) of the sample. Sums are made block by block, so that its rows are held as counts only."""
    blocks = [slice(lo, lo + 256) for lo in range(0, len(counts), 256)]
    seen = sum(np.count_nonzero(np.stack(counts[b]), axis=0) for b in blocks)
    weights = (np.log((len(counts) + 1) / (seen + 1)) + 1).astype(np.float32)
    rows = lambda b: _unit(np.stack(counts[b]).astype(np.float32) * weights)
    mean, gram = np.zeros(TERMS), np.zeros((TERMS, TERMS), np.float32)
    for b in blocks:
        x = rows(b)
        mean += x.sum(0, dtype=np.float64)
        gram += x.T @ x
    mean = (mean / len(counts)).astype(np.float32)
    gram -= np.outer(mean, mean) * np.float32(len(counts))
    _, axes = np.linalg.eigh(gram)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :latent])
    return weights, mean, axes, np.concatenate([_unit((rows(b) - mean) @ axes) for b in blocks])


def _counted(texts: pd.Series) -> pd.Series:
    return pd.Series([terms(t).astype(np.float16).tobytes() for t in texts])


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Voters, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with columns named by score, 0 to 1, and predicted, 1 from THRESHOLD on. Null, empty and blank texts take the rate of
    label 1. Columns of docs that have those names are replaced; the other columns come out as they went in.

    The broadcast model holds 2 x PER_LABEL short vectors at most, whatever the size of docs.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(shared.value.score(b.tolist()))

    df = docs.withColumn(score, F.pandas_udf(scored, "double")(F.col(text)))
    return df.withColumn(predicted, F.when(F.col(score) >= THRESHOLD, 1).otherwise(0))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
