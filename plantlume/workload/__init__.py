"""The plans bound to the driver's tables: table roles, registered queries and their SQL checks."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("plant_queries", "score_queries", "decision_queries", "governance_queries", "serving_queries", "staging_queries")


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def all_queries() -> dict:
    from .catalog import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from .catalog import ORACLES

    _load()
    return dict(ORACLES)
