"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, langid, line_dedup, packing, quality, secret_scan, sharding, simhash, token_count, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_best_fit_packing": packing.query,
    "op3_sharding": sharding.query,
    "op4_quality_rules": quality.query,
    "op5_url_filters": url_filter.query,
    "op6_secret_scans": secret_scan.query,
    "op7_language_id": langid.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_benchmark_decontamination": decontam.query,
    "op10_token_counts": token_count.query,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_quality_rules": quality.SQL,
    "op5_url_filters": url_filter.SQL,
    "op9_benchmark_decontamination": decontam.SQL,
}
