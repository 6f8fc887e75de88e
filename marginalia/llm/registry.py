"""The queries of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, embedding_dedup, hamerly, html_extract, jaccard_join, max_score, quality, sentencepiece, sharding, toxicity, url_filter, vector_codes, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_url_filters": url_filter.query,
    "op2_sharding": sharding.query,
    "op3_warc": warc.query,
    "op4_decontaminate": decontaminate.query,
    "op5_quality": quality.query,
    "op6_sentencepiece": sentencepiece.query,
    "op7_jaccard_join": jaccard_join.query,
    "op8_html_extract": html_extract.query,
    "op9_toxicity": toxicity.query,
    "op10_embedding_dedup": embedding_dedup.query,
    "op11_max_score": max_score.query,
    "op12_vector_codes": vector_codes.query,
    "op13_hamerly": hamerly.query,
}
ORACLE_SQL = {
    "op3_warc": warc.SQL,
    "op10_embedding_dedup": embedding_dedup.SQL,
    "op11_max_score": max_score.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_hamerly": hamerly.SQL,
    "op1_url_filters": url_filter.SQL,
    "op7_jaccard_join": jaccard_join.SQL,
}
