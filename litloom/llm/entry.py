"""The operators' queries and SQL, for the driver's entry.  All modules are loaded at once, so what is missing shows at import."""

from __future__ import annotations

from importlib import import_module

NAMES = ["fingerprints", "packing", "embedding_dedup", "mixing", "quality", "toxicity", "html_extract", "minhash", "suffix_dedup", "language_id"]
MODULES = [import_module(f"litloom.llm.{name}") for name in NAMES]


def queries() -> dict:
    found = {}
    for m in MODULES:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for m in MODULES:
        found |= getattr(m, "SQL", {})
    return found
