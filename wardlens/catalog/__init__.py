"""Registered queries over the test tables, each with an equivalent SQL statement where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from .registry import REGISTRY, Query

MODULES = (
    "readings", "formulas", "dashboards", "keyed_tables", "risk_jobs", "statistics", "geography", "histories",
    "citizen", "streams", "round_trips",
)


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return dict(REGISTRY)
