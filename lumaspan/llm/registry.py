"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from lumaspan.llm import decontamination, divergence, html, jaccard, language, lines, mixing, quality, resampling, sharding, suffixes, topk, urls

QUERIES = {
    "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
    "op2_suffix_array_dedup": suffixes.op2_suffix_array_dedup,
    "op3_url_filters": urls.op3_url_filters,
    "op4_html_extraction": html.op4_html_extraction,
    "op5_sharding": sharding.op5_sharding,
    "op6_language_id": language.op6_language_id,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_target_resampling": resampling.op11_target_resampling,
    "op12_exact_topk": topk.op12_exact_topk,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL = {
    "op3_url_filters": urls.SQL,
    "op8_quality_rules": quality.SQL,
    "op10_line_dedup": lines.SQL,
    "op11_target_resampling": resampling.SQL,
    "op12_exact_topk": topk.SQL,
    "op13_source_divergence": divergence.SQL,
}
