"""All queries over the account-ledger views: importing the operator modules registers them."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE_SQL, QUERIES

MODULES = [
    "operators.scalars",
    "operators.brackets",
    "operators.creditors",
    "operators.filters",
    "operators.lookup",
    "operators.joins",
    "operators.aggregates",
    "operators.windows",
    "operators.resolution",
    "operators.validation",
    "operators.bureaus",
    "operators.extraction",
    "operators.grids",
    "operators.parsers",
    "operators.entries",
    "operators.meant",
    "operators.letters",
    "operators.access",
    "operators.inverted",
    "operators.vectors",
    "sources.evaluation",
    "sources.ingest",
    "sources.stores",
    "streaming.feeds",
    "streaming.sessions",
    "streaming.timers",
]
for module in MODULES:
    import_module(f"ledgerloom.{module}")

__all__ = ["ORACLE_SQL", "QUERIES"]
