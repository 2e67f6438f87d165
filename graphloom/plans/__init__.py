"""Registered queries."""

from __future__ import annotations

import importlib
import pkgutil

from graphloom.plans.registry import Query, collect


def all_queries() -> dict[str, Query]:
    """The queries of every module of this package, by name."""
    names = sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "registry")
    return collect(*(importlib.import_module(f"{__name__}.{n}").QUERIES for n in names))
