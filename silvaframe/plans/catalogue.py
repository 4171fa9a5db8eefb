"""The query catalogue: every module of this package that has QUERIES and SQL."""

from __future__ import annotations

import importlib

_MODULES: tuple[str, ...] = ("features", "records", "scalars", "distances", "evaluations", "processes")


def _all(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f".{m}", __package__), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
