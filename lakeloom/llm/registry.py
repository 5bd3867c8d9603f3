"""Queries of this package and, where SQL expresses them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import decontaminate, hard_negatives, license_scan, line_dedup, lm_score, minhash_dedup, quality, source_mix, token_alignment, token_count, toxicity, url_filter, vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": minhash_dedup.op1_minhash_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_count": token_count.op3_token_count,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_vector_search": vector_search.op5_vector_search,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_source_mix": source_mix.op8_source_mix,
    "op9_quality": quality.op9_quality,
    "op10_lm_score": lm_score.op10_lm_score,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_license_scan": license_scan.op12_license_scan,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": minhash_dedup.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op8_source_mix": source_mix.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_license_scan": license_scan.ORACLE_SQL,
}
