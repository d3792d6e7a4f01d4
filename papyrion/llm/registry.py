"""All queries of the subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("queries", "training")


def _all(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"papyrion.llm.{m}"), attr))
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
