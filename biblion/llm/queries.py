"""Registry of the corpus queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from biblion.llm import bpe, ctw, decontaminate, exact_dedup, license_scan, near_dedup, pii, quality, token_files, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_pii": pii.op2_pii,
    "op3_token_files": token_files.op3_token_files,
    "op4_quality": quality.op4_quality,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_ctw": ctw.op7_ctw,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_bpe": bpe.op9_bpe,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_license_scan": license_scan.OP6_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
}
