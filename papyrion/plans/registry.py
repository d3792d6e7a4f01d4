"""All queries of the core and their SQL, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("relational", "ranking", "graphs", "structure", "checks", "editing", "layout", "storing", "decks", "exchanging", "shaped")


def _all(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"papyrion.plans.{m}"), attr))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
