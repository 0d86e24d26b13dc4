"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import bpe, decontaminate, hard_negatives, langid, language_model, near_dup, quality, secrets, substring_dedup, token_counts, token_files, vector_codes, warc

QUERIES = {
    "op5_warc_index": warc.query,
    "op8_language_model": language_model.query,
    "op1_substring_dedup": substring_dedup.query,
    "op2_quality_rules": quality.query,
    "op3_language_id": langid.query,
    "op7_token_counts": token_counts.query,
    "op4_near_dup": near_dup.query,
    "op6_secret_scan": secrets.query,
    "op9_bpe_round_trip": bpe.query,
    "op10_decontaminate": decontaminate.query,
    "op11_vector_codes": vector_codes.query,
    "op12_token_files": token_files.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc_index": warc.ORACLE_SQL,
    "op2_quality_rules": quality.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
