"""Registered queries over the given tables, each with its oracle SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``; ``sql`` is its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    from tidemark.plans import composites, families, forecasts, labels, landing, lookups, mechanisms, panels, rebuild, screens, suites  # noqa: F401
