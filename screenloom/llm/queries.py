"""Queries and SQL of the problems of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ["plainform_queries", "neardup_queries", "history_queries", "leakage_queries", "mixing_queries", "reading_queries"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _m = import_module(f"screenloom.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
