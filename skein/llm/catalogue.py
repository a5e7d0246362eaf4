"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["decontaminate", "chat_format", "inner_product", "substring_dup", "language_id", "sentencepiece", "pii", "lm_score", "toxicity", "near_dup"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"skein.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"skein.llm.{m}").ORACLE_SQL.items()}
