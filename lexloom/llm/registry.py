"""Queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Query -> (module, name of its SQL or None).
QUERIES = {
    "op1_suffix_dedup": ("suffix_dedup", None),
    "op2_licenses": ("licenses", None),
    "op3_bpe": ("bpe", None),
    "op4_topk": ("topk", "OP4_SQL"),
    "op5_pii": ("pii", None),
    "op6_near_dedup": ("near_dedup", "OP6_SQL"),
    "op7_line_dedup": ("line_dedup", "OP7_SQL"),
    "op8_decontaminate": ("decontaminate", None),
    "op9_langid": ("langid", None),
    "op10_quality": ("quality", None),
    "op11_runs": ("runs", None),
    "op12_exact_dedup": ("exact_dedup", "OP12_SQL"),
    "op13_filter_audit": ("filter_audit", "OP13_SQL"),
}


def queries() -> dict:
    return {q: getattr(import_module(f"lexloom.llm.{m}"), q) for q, (m, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(import_module(f"lexloom.llm.{m}"), s) for q, (m, s) in QUERIES.items() if s}
