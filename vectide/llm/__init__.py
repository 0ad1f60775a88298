"""Operators for large-scale training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, html_extract, language_id, lm_score, ngram_join, quality_classifier, quality_rules, token_counts

_QUERIES = [
    token_counts.op1_token_counts,
    html_extract.op2_html_extraction,
    chat_format.op3_chat_format,
    language_id.op4_language_id,
    quality_rules.op5_quality_rules,
    bpe.op6_bpe,
    lm_score.op7_lm_score,
    ngram_join.op8_ngram_jaccard_join,
    decontaminate.op9_benchmark_decontamination,
    quality_classifier.op10_quality_classifier,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    """SQL for the operators that SQL can express; the others are tested against brute force."""
    return {"op3_chat_format": chat_format.ORACLE, "op7_lm_score": lm_score.ORACLE, "op8_ngram_jaccard_join": ngram_join.ORACLE}
