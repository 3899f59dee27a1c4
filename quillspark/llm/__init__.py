"""Operators for training text. Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "substring", "tokenfile", "pii", "quality", "secrets", "decontam", "lines", "neardup", "html", "toxicity", "divergence", "spelling")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLE.items()}
