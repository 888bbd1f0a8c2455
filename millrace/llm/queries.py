"""The training-data queries and, where SQL can say them, their DuckDB equivalents."""

from __future__ import annotations

from millrace.llm import chat_format, cover_tree, decontaminate, language_id, line_dedup, near_dedup, packing, quality, substring_dedup, suffix_dedup, url_rules, vector_codes, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_chat_format": chat_format.query,
    "op3_cover_tree_top_k": cover_tree.query,
    "op4_packing": packing.query,
    "op5_near_dedup": near_dedup.query,
    "op6_quality": quality.query,
    "op7_suffix_array_dedup": suffix_dedup.query,
    "op8_decontaminate": decontaminate.query,
    "op9_language_id": language_id.query,
    "op9_language_id_pages": language_id.query_pages,
    "op10_url_filters": url_rules.query,
    "op11_whitening": whitening.query,
    "op12_vector_codes": vector_codes.query,
    "op13_substring_dedup": substring_dedup.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op3_cover_tree_top_k": cover_tree.ORACLE,
    "op10_url_filters": url_rules.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_substring_dedup": substring_dedup.ORACLE,
}
