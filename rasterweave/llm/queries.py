"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, licences, packing, quality, secrets, simhash, tokens, warc, wrappers

QUERIES = {
    "op1_license_scans": licences.op1_license_scans,
    "op2_packing": packing.op2_packing,
    "op3_html_extraction": wrappers.op3_html_extraction,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_secret_scans": secrets.op7_secret_scans,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_warc_derivatives": warc.op10_warc_derivatives,
}
ORACLES = {
    "op5_quality_rules": quality.SQL,
    "op6_chat_formatting": chat.SQL,
    "op7_secret_scans": secrets.SQL,
    "op8_benchmark_decontamination": decontaminate.SQL,
}
