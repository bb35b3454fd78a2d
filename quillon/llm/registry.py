"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quillon.llm import byte_bpe, centroids, chat_format, decontaminate, fingerprint_index, jaccard_join, license_scan, line_dedup, mixing, quality_rules, resampling, suffix_dedup, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_fingerprint_index": fingerprint_index.op10_fingerprint_index,
    "op11_centroids": centroids.op11_centroids,
    "op12_resampling": resampling.op12_resampling,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}
SQL: dict[str, str] = {
    "op1_chat_format": chat_format.SQL,
    "op3_license_scan": license_scan.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_mixing": mixing.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op11_centroids": centroids.SQL,
    "op12_resampling": resampling.SQL,
}
