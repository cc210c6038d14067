"""Loads every module of this subpackage and gives its queries and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("lines", "exact", "mixing", "secrets", "substrings", "bpe", "near", "ann", "langid", "quality", "variants", "divergence", "licenses")


def load():
    """(queries, SQL) of all modules."""
    for module in MODULES:
        import_module(f"framewright.llm.{module}")
    from framewright.llm.base import QUERIES, SQL

    return QUERIES, SQL
