"""The corpus pipeline: quality, near-dedup, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the
columns of documents; the last returns the tokens of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadtrace.llm import decontaminate, near_dedup, pii, quality, sentencepiece_bpe
from roadtrace.llm.common import picked, table, unused, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Empty ones take the rate of good labels and so are mostly kept.

    Columns of docs that are named score or predicted are no inputs and stay as they are.
    """
    model, x = quality.fit(docs, table(spark, sf_dir, "labels")), unused(docs)
    return quality.score(docs, model, score=x + "score", predicted=x + "predicted").where(F.col(x + "predicted") == 1).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest doc_id.

    Rows that repeat a doc_id go or stay together. Rows with a null doc_id stay.
    """
    gone = written(near_dedup.near_duplicates(docs, width=5).where("not kept").select("doc_id").distinct(), "gone")
    return picked(docs, gone, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Each row is judged by its own text, whatever its doc_id."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows, and stays where the text is null."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return sentencepiece_bpe.tokenize(docs, sentencepiece_bpe.default_model(), with_ids=False)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("tokens", tokens_stage)]

#: SQL can't express the classifier or the alignment; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
