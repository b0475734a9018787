"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import ann, chat, exact_dedup, html_extract, invariants, mixing, near_dup, packing, pii, suffix_dedup, toxicity

QUERIES = {
    "op1_html": html_extract.query,
    "op2_pii": pii.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_ann": ann.query,
    "op5_mixing": mixing.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_near_dup": near_dup.query,
    "op8_packing": packing.query,
    "op9_chat": chat.query,
    "op10_toxicity": toxicity.query,
    **invariants.QUERIES,
}
ORACLE_SQL = {
    "op1_html": html_extract.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_suffix_dedup": suffix_dedup.ORACLE,
    "op7_near_dup": near_dup.ORACLE,
    "op9_chat": chat.ORACLE,
    **invariants.SQL,
}
