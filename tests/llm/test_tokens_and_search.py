import hashlib
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from roadtrace.llm import quality, sentencepiece_bpe, topk

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "Hello world", "Hello  world ", "a\tb\nc\r\n", "ünïcode é é ﬁ", "🎉🎉 漢字かな", "▁▁a ▁", "x" * 9000, "ab" * 4000 + " end", "\u0000​﻿", "don't stop-me 12,345.67", "<0x41> <s> </s> <unk>"]


def test_tokens_match_the_library(frame):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = frame([(i, t, i) for i, t in enumerate(TEXTS + TEXTS[4:6])], "doc_id long, text string, ids long")
    for r in sentencepiece_bpe.tokenize(df, PATH).collect():
        text = (TEXTS + TEXTS[4:6])[r.doc_id] or ""
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == lib.decode(ids), text[:50]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert sentencepiece_bpe.tokenize(df.where("false"), PATH).count() == 0


def test_runs_and_long_words_match_the_library():
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PATH), sentencepiece_bpe.Model(PATH)
    ids = lambda t: list(struct.unpack(f"<{len(own.encode(t)) // 4}I", own.encode(t)))
    r = random.Random(3)
    bits = [" ", "   ", "a", "the", "ing", "漢", "é", "\t", "\n", "▁", "🎉", "x" * 70, " " * 17]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(12))) for _ in range(3000)] + [a + " " * k + b for k in range(70) for a, b in (("", ""), ("a", "b"), ("\n", "\tq"), ("", "漢"))]
    texts += [" " * 100_000, "x" * 100_000, " " * 30_000 + "漢" + " " * 20_000 + "b", "".join(r.choice("abcdefghij") for _ in range(50_000))]
    assert all(ids(t) == lib.encode(t, add_bos=True, add_eos=True) for t in texts)
    began = time.perf_counter()
    assert len(own.encode(" " * 100_000 + "w" * 1_000_000)) > 4 * 100_000 and time.perf_counter() - began < 30


def test_documents_match_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_bpe.op1(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_topk_is_brute_force(frame):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 420)]  # ties
    rows += [(420, None), (421, [1.0, None] + [0.0] * 6), (422, [float("nan")] * 8), (423, [float("inf")] + [0.0] * 7), (450, [0.0] * 8), (500, [1.0, 2.0]), (501, [3.0, 1.0])]
    v = topk.quantised(frame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, v int"))
    got = topk.search(v.where("id % 50 = 0"), v, 5, block=64, query_block=3).collect()
    good = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows if x is not None and None not in x and np.isfinite(np.array(x, float)).all()}
    want = []
    for q in [i for i in good if i % 50 == 0]:
        scores = sorted((-int(good[q] @ good[c]), c) for c in good if c != q and len(good[c]) == len(good[q]))
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.search(v.where("false"), v, 5).count() == topk.search(v, v.where("false"), 5).count() == 0


def test_topk_of_large_numbers_is_exact(frame):
    r = random.Random(5)
    rows = [(i, [r.randrange(-(2**30), 2**30) for _ in range(3)]) for i in range(60)] + [(60, []), (100, [])]
    v = frame(rows, "id long, v array<long>")
    got = topk.search(v.where("id % 50 = 0"), v, 4, block=16).collect()
    want = []
    for q, a in rows:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q and len(a) == len(b))[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_holds_scores_to_longs(frame):
    """Finite vectors of any size: components and scores past 64 bits count as the nearest long, and tie there."""
    v = topk.quantised(frame([(0, [3e38]), (1, [3e38]), (2, [1e300]), (3, [-3e38]), (4, [1.0]), (5, [float("inf")])], "vec_id long, embedding array<double>"))
    most = 2**63 - 1
    got = topk.search(v.where("id % 50 = 0"), v, 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, most), (0, 2, 2, most), (0, 3, 4, most), (0, 4, 3, -(2**63))]


def test_quality_is_right_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op5(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_quality_edges(frame):
    docs = frame([(i, "good plain words here and there" if i % 2 else "### $$$ %%% *** &&&") for i in range(40)] + [(40, None), (41, ""), (42, " "), (42, "good plain words"), (None, "x " * 20000)])
    labels = frame([(i, i % 2) for i in range(40)] + [(None, 1), (41, None)], "doc_id long, quality int")
    scored = quality.score(docs.selectExpr("*", "1 as score"), quality.fit(docs, labels)).collect()
    assert len(scored) == 45 and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score > 0.5 if r.doc_id % 2 else r.score < 0.5 for r in scored if r.doc_id is not None and r.doc_id < 40)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert quality.score(docs.where("false"), quality.fit(docs, labels)).count() == 0


def test_quality_is_brute_force(frame):
    """Scores by plain loops over the sample's latent vectors."""
    r = random.Random(6)
    words = ["plain", "words", "and", "sense", "###", "$$$", "GO", "GO", "7 7"]
    texts = [" ".join(r.choice(words[:5] if i % 2 else words[3:]) for _ in range(30)) for i in range(120)]
    model = quality.fit(frame(list(enumerate(texts))), frame([(i, i % 2) for i in range(90)], "doc_id long, quality int"), k=7)
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(90))

    def plain(text):
        v = quality.terms(text) * model.weights
        v = v / np.linalg.norm(v) - model.mean
        v = v @ model.axes
        v = v / np.linalg.norm(v)
        near = sorted(((float(v @ x), y) for x, y in zip(model.vectors, model.labels)), reverse=True)[:7]
        w = [max(c, 0) for c, _ in near]
        return (sum(c * y for c, (_, y) in zip(w, near)) + model.prior * model.rate) / (sum(w) + model.prior)

    assert np.allclose(model.score(texts, block=16), [plain(t) for t in texts], atol=1e-4)
    scored = quality.score(frame([(1, texts[0], 9.0)], "doc_id long, text string, score double"), model, score="s", predicted="p").first()
    assert scored.score == 9.0 and abs(scored.s - plain(texts[0])) < 1e-4
