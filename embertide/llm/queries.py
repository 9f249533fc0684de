"""Queries of the operators in this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from embertide.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    html_extract,
    license_scan,
    mixing,
    near_dedup,
    pii,
    substring_dedup,
    toxicity,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_pii": pii.op8_pii,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op5_chat_format": chat_format.OP5_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
