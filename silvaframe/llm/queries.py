"""All queries of this subpackage with their SQL twins, where SQL can express them."""

from __future__ import annotations

import importlib

_MODULES = ("q_pairs", "q_overlap", "q_sampling", "q_packing", "q_mixing", "q_language")


def _all(what: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f".{m}", __package__)
        out |= getattr(mod, what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
