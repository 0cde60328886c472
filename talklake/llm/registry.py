"""Queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from importlib import import_module

MODULES = ["p1_turns", "p2_splitting", "p4_lookalike", "p5_nearest", "p6_packing", "p7_leakage", "p8_sentences"]


def queries() -> dict:
    """Name to callable (spark, sf_dir) -> DataFrame."""
    return {k: f for m in MODULES for k, f in import_module(f"talklake.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to the statement that DuckDB runs on the same tables."""
    return {k: s for m in MODULES for k, s in import_module(f"talklake.llm.{m}").ORACLE.items()}
