"""Every query of the engine with its SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["queries_text", "queries_search", "queries_structure", "queries_metadata", "queries_eval"]


def _modules():
    return [import_module(f"lexloom.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
