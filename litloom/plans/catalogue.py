"""The queries of the reference operators, and the SQL to check them by."""

from __future__ import annotations

from importlib import import_module

MODULES: list[str] = ["corpus", "structure", "tables", "records", "papers"]


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"litloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in MODULES:
        found |= import_module(f"litloom.plans.{name}").SQL
    return found
