"""Queries and oracle SQL of all modules of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("licenses", "dedup", "quality", "warc", "packing", "media", "pieces", "ann", "pii", "langid")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLE_SQL.items()}
