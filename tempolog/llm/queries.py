"""All queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import query_fingerprints, query_joins, query_mixing, query_pages, query_quality, query_texts, query_urls

QUERIES = {
    "op1_url_filters": query_urls.op1_url_filters,
    "op2_quality_rules": query_quality.op2_quality_rules,
    "op3_secret_scans": query_texts.op3_secret_scans,
    "op4_ngram_jaccard_join": query_joins.op4_ngram_jaccard_join,
    "op5_document_fingerprints": query_fingerprints.op5_document_fingerprints,
    "op6_html_extraction": query_pages.op6_html_extraction,
    "op7_byte_bpe": query_texts.op7_byte_bpe,
    "op8_quality_classifier": query_quality.op8_quality_classifier,
    "op9_toxicity": query_quality.op9_toxicity,
    "op10_source_mixing": query_mixing.op10_source_mixing,
}

SQL = {"op1_url_filters": query_urls.SQL, "op10_source_mixing": query_mixing.SQL}
