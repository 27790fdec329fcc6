"""Every query of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from tracemill.plans.registry import QUERIES, SQL

_MODULES = ("traces", "scoring", "pairing", "rewarding", "batching", "asking", "benchmarks", "loading")
for _name in _MODULES:
    import_module(f"tracemill.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
