"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from tallymark.plans.registry import ORACLES, QUERIES, Query

_FAMILIES = ("compare", "quality", "etl", "history", "hierarchy", "corpus", "event", "stream", "source")


def _load() -> None:
    for family in _FAMILIES:
        import_module(f"tallymark.plans.{family}_queries")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
