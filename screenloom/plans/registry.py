"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ["integrity_queries", "hierarchy_queries", "instant_queries", "relational_queries", "text_queries", "structure_queries", "detail_queries", "stream_queries"]


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"screenloom.plans.{name}"), what)
    return out


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
