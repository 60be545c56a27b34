"""All queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from shutterlake.llm import op01_quality, op02_mixing, op03_lines, op04_language, op05_substrings, op06_token_counts, op07_tokens, op08_decontaminate, op09_pii, op10_simhash

QUERIES = {
    "op1_quality_rules": op01_quality.op1_quality_rules,
    "op2_mixing_sources": op02_mixing.op2_mixing_sources,
    "op3_line_dedup": op03_lines.op3_line_dedup,
    "op4_language_id": op04_language.op4_language_id,
    "op5_substring_dedup": op05_substrings.op5_substring_dedup,
    "op6_token_counts": op06_token_counts.op6_token_counts,
    "op7_token_files": op07_tokens.op7_token_files,
    "op8_benchmark_decontamination": op08_decontaminate.op8_benchmark_decontamination,
    "op9_personal_data": op09_pii.op9_personal_data,
    "op10_simhash_near_dedup": op10_simhash.op10_simhash_near_dedup,
}

ORACLE_SQL = {
    "op1_quality_rules": op01_quality.SQL,
    "op8_benchmark_decontamination": op08_decontaminate.SQL,
}
