"""Newest states of nodes and edges.

The row of an id (of a key) is the one with the greatest (hlc, site_id).  States
are reduced before they move, and only the columns asked for take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ("src", "type", "dst")


def _newest(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    rest = [c for c in columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("hlc", "site_id")).alias("_r"))
    return top.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def current_nodes(nodes: DataFrame, *columns: str, deleted: bool = False) -> DataFrame:
    """The newest row of each id with ``columns``; live ones only unless ``deleted``."""
    out = _newest(nodes.where("id is not null"), ("id",), ("deleted_at", *columns))
    return out if deleted else out.where("deleted_at is null").drop("deleted_at")


def current_edges(edges: DataFrame, *columns: str, types: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each live (src, type, dst); ``types`` reaches the scan."""
    rows = edges.where(F.col("type").isin(*types)) if types else edges
    return _newest(rows, EDGE_KEY, ("deleted_at", *columns)).where("deleted_at is null").drop("deleted_at")


def attribute(key: str, attrs: str = "attrs") -> Column:
    """An attribute as text; null where absent or null."""
    return F.get_json_object(attrs, f"$.{key}")
