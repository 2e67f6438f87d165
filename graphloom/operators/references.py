"""References to records that do not exist.

The picture is kept per key and maintained from change deltas.  Of each edge and
each node id the state that holds is stored with its clock; a batch of changes is
reduced to one state per key and merged by clock, and where that turns a live
state into a removed one or the other way round, a signed change of -1 or +1
comes out.  These changes add up to the references and the existence of each
referenced key.  A key with references and no existence is an orphan.  As states
merge by the greatest clock, batches may come in any order, cut anywhere, and
repeat.  Counts of zero are kept, as they tell a deleted record from one that
never was.

Defined results: a null end is a missing reference; repeated rows of one state
count once, as they change nothing; of rows with an equal clock the one with
the greater deleted_at (null lowest), then created_at counts; an edge without
created_at is never late and has a null period; columns other than the named
ones are ignored; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import canonical_id, utc_month

EDGE = ("src", "type", "dst")


@dataclass(frozen=True)
class Picture:
    """Edge and node states that hold, and signed counts per referenced key: what earlier batches left."""

    edges: DataFrame
    nodes: DataFrame
    counts: DataFrame


def _live(state: Column) -> Column:
    """1 for a state that isn't removed, else 0; 0 without a state."""
    return F.when(state.isNotNull() & state["deleted_at"].isNull(), 1).otherwise(0)


def advanced(stored: DataFrame | None, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, state, delta) of every known key after a batch of ``rows``.

    ``stored`` has the keys and their state before.  Rows are reduced before they
    move; only the greatest state of a key meets the stored one.
    """
    state = F.struct("hlc", "site_id", "deleted_at", "created_at")
    fresh = rows.groupBy(*keys).agg(F.max(state).alias("state"))
    if stored is None:
        return fresh.withColumn("delta", _live(F.col("state")))
    both = fresh.withColumn("was", F.lit(None).cast(fresh.schema["state"].dataType)).unionByName(stored.select(*keys, "state", F.col("state").alias("was")))
    merged = both.groupBy(*keys).agg(F.max("state").alias("state"), F.max("was").alias("was"))
    return merged.withColumn("delta", _live(F.col("state")) - _live(F.col("was"))).drop("was")


def edge_ends(edges: DataFrame) -> DataFrame:
    """A row per end of an edge, with the key under which its node is looked up."""
    ends = edges.select("*", F.explode(F.array(F.lit("src"), F.lit("dst"))).alias("side"))
    return ends.withColumn("key", canonical_id(F.when(F.col("side") == "src", F.col("src")).otherwise(F.col("dst"))))


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE, "hlc", "site_id", "deleted_at", "created_at")


def _node_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select(canonical_id(F.col("id")).alias("key"), "hlc", "site_id", "deleted_at", "created_at").where("key is not null")


def folded(before: Picture | None, edges: DataFrame, nodes: DataFrame) -> Picture:
    """The picture after a batch of edge and node rows."""
    e = advanced(before and before.edges, _edge_rows(edges), EDGE)
    n = advanced(before and before.nodes, _node_rows(nodes), ("key",))
    refs = edge_ends(e.where("delta <> 0").select(*EDGE, "delta")).select("key", F.col("delta").alias("refs"), F.lit(None).cast("int").alias("exists"))
    changes = refs.unionByName(n.select("key", F.lit(0).alias("refs"), F.col("delta").alias("exists")))
    counts = changes if before is None else changes.unionByName(before.counts.select("key", F.col("refs").cast("int"), F.col("exists").cast("int")))
    return Picture(e, n, counts.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists")))


def orphan_keys(picture: Picture) -> DataFrame:
    """(key, refs, reason): keys with positive references and zero existence."""
    reason = F.when(F.col("exists").isNull(), "missing").otherwise("deleted")
    return picture.counts.where("refs > 0 and coalesce(exists, 0) <= 0").select("key", "refs", reason.alias("reason"))


def orphans(picture: Picture) -> DataFrame:
    """One row per live edge end that names no usable node.

    Columns src, type, dst, side, reason, period.  Hub ends: the edges side of
    the join is the one that is skewed, the node side has one row per key, so
    that adaptive execution can split a hot key's edges over tasks.
    """
    live = picture.edges.where("state.deleted_at is null").select(*EDGE, F.col("state.created_at").alias("created_at"))
    known = picture.nodes.select("key", _live(F.col("state")).alias("exists"), F.col("state.created_at").alias("born"))
    found = edge_ends(live).join(known, "key", "left")
    reason = (
        F.when(F.col("exists").isNull(), "missing")
        .when(F.col("exists") <= 0, "deleted")
        .when(F.col("born") > F.col("created_at"), "late")
    )
    return found.select("src", "type", "dst", "side", reason.alias("reason"), utc_month(F.col("created_at")).alias("period")).where(
        "reason is not null"
    )


def orphan_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """:func:`orphans` of whole tables, which are one batch after nothing."""
    return orphans(folded(None, edges, nodes))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per table, end, reason and month."""
    return orphans.groupBy(F.lit("edges").alias("table_name"), "side", "reason", "period").agg(F.count("*").alias("n"))
