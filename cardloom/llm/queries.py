"""Queries of this package and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from cardloom.llm import best_fit, bpe, chat_format, exact_dedup, filter_audit, html_extract, language_id, periodic_runs, quality_rules, sharding, simhash, token_counts, token_matrix

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_token_matrix": token_matrix.op5_token_matrix,
    "op6_bpe": bpe.op6_bpe,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_best_fit": best_fit.op9_best_fit,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_language_id": language_id.op11_language_id,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_sharding": sharding.ORACLE,
    "op4_chat_format": chat_format.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
