"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collocations, decontaminate, html_text, jaccard_join, near_dedup, pii, quality, secrets, sentencepiece_bpe, sharding, topk, url_filter, vector_codes

QUERIES = {
    "op1_sentencepiece": sentencepiece_bpe.op1,
    "op2_topk": topk.op2,
    "op3_pii": pii.op3,
    "op4_secrets": secrets.op4,
    "op5_quality": quality.op5,
    "op6_html_text": html_text.op6,
    "op7_near_dedup": near_dedup.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_sharding": sharding.op9,
    "op10_url_filter": url_filter.op10,
    "op11_ngram_join": jaccard_join.op11,
    "op12_collocations": collocations.op12,
    "op13_vector_codes": vector_codes.op13,
}
SQL = {
    "op2_topk": topk.OP2_SQL,
    "op3_pii": pii.OP3_SQL,
    "op4_secrets": secrets.OP4_SQL,
    "op7_near_dedup": near_dedup.OP7_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_ngram_join": jaccard_join.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
