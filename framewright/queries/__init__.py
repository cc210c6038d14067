"""The registered queries over the driver's tables, each with its SQL statement where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scores", "rasters", "sets", "reports", "files", "pairing", "inputs", "containers", "snapshots", "deep", "blobs")


def load():
    """(queries, SQL) of all modules."""
    for module in MODULES:
        import_module(f"framewright.queries.{module}")
    from framewright.queries.base import QUERIES, SQL

    return QUERIES, SQL
