"""How queries are written down: a callable and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


def collect(*groups: dict[str, Query]) -> dict[str, Query]:
    """All groups in one, refusing a name that occurs twice."""
    out: dict[str, Query] = {}
    for group in groups:
        for name, query in group.items():
            if name in out:
                raise ValueError(f"query {name} is defined twice")
            out[name] = query
    return out
