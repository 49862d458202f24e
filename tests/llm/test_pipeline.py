"""The pipeline's stages against plain Python over the smallest tables."""

import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece

from roadtrace.llm import decontaminate, pii, quality

from .conftest import brute_components

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    left = [(i, t) for (i, t), s in zip(rows.items(), model.score(list(rows.values()))) if s >= quality.THRESHOLD]
    groups = brute_components(left, 5)
    index = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = [i for i, t in left if groups[i][1] == i and not index.search(t)]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i in left:
        ids = lib.encode(clean[i] or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < len(rows)


def test_stages_keep_columns_and_take_empty_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_leave_extra_columns_alone(spark):
    """Every name that an operator uses for itself, as an extra column of documents."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["score", "predicted", "m_email", "m_ip", "m_iban", "x_email", "x_all", "x_score", "x_predicted", "x_h_email", "xx_g_ip", "blob", "rep", "set", "sketch", "component_id", "kept", "item_id", "k", "t", "n", "all"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *[f"'{n}' as {n}" for n in names])
    odd = spark.createDataFrame([(None, None), (7, None), (7, ""), (None, "only one of these")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'web' as source", "0 as n_chars", *[f"'{n}' as {n}" for n in names])
    docs = docs.limit(60).union(odd.select([odd[c].cast(t).alias(c) for c, t in docs.dtypes]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert 0 < len(rows) <= 64 and all(r[n] == n for r in rows for n in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 64


def test_rows_without_id_are_judged_by_their_text(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, item), (None, "clean text"), (3, item), (3, "another clean one")], "doc_id long, text string")
    assert sorted(r.text for r in corpus_pipeline.decontamination_stage(spark, docs, SF).collect()) == ["another clean one", "clean text"]
