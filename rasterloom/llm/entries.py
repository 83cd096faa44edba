"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontamination, html_extract, license_scan, line_dedup, ngram_join, quality_rules, sharding, suffix_dedup, super_kmers, token_counts, vector_codes, whitening


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op7_short_runs": line_dedup.op7_short_runs,
        "op8_sharding": sharding.op8_sharding,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_html_extract": html_extract.op10_html_extract,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_substring_dedup": super_kmers.op12_substring_dedup,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.OP1_SQL,
        "op3_decontamination": decontamination.OP3_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op7_short_runs": line_dedup.OP7_SHORT_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_substring_dedup": super_kmers.OP12_SQL,
    }
