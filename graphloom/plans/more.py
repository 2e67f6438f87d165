"""Queries of ranking details and source-text streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import code, fusion
from graphloom.operators import workqueue as wq
from graphloom.operators.current import current_edges, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table
from graphloom.tools import Store


def _weights(s: SparkSession, d: str) -> DataFrame:
    """Every record with links to records in any state, states read as those of anchors."""
    n = current_nodes(table(s, d, "nodes"), "status", "confidence")
    state = F.when(F.col("status").isin("superseded", "retracted"), "lost").when(F.col("status") == "closed", "stale").when(F.col("status") == "blocked", "drifted").otherwise("fresh")
    e = current_edges(table(s, d, "edges"), "weight", types=("touches", "mentions")).select("src", "dst")
    return fusion.anchor_weight(e, n.select("id", state.alias("status"), F.col("confidence").alias("drift"))).withColumn("anchor_weight", F.round("anchor_weight", 6))


def _freshness(s: SparkSession, d: str) -> DataFrame:
    n = current_nodes(table(s, d, "nodes"), "attrs", "created_at", "updated_at")
    synced = F.when(F.length("id") % 2 == 0, F.format_string('{"external_updated_at": %d, "external_synced_at": %d}', "created_at", F.col("created_at") + 10_000)).otherwise(F.col("attrs"))
    return n.withColumn("attrs", synced).select("id", wq.freshness_clock().alias("clock"))


def _streams(s: SparkSession, d: str) -> DataFrame:
    return code.fingerprints(table(s, d, "documents").where("text is not null").select("doc_id", "text"), "doc_id", "text").select("doc_id", F.size("fp").alias("n"), F.array_min("fp").alias("least"))


QUERIES = {
    "ret23_freshness_clock": Query(
        _freshness,
        q.with_(q.N) + "SELECT id, CASE WHEN length(id) % 2 = 1 THEN updated_at WHEN updated_at > created_at + 70000 THEN updated_at ELSE least(created_at, updated_at) END AS clock FROM n",
    ),
    "ret24_anchor_weight": Query(
        _weights,
        q.with_(q.N, q.E) + "SELECT e.src AS id, round(max(CASE WHEN status IN ('superseded', 'retracted') THEN 0.2::DOUBLE WHEN status = 'closed' THEN 0.5::DOUBLE WHEN status = 'blocked' THEN least(1, greatest(0, confidence)) ELSE 1.0::DOUBLE END), 6) AS anchor_weight FROM e JOIN n ON n.id = e.dst WHERE e.type IN ('touches', 'mentions') GROUP BY 1",
    ),
    "ret44_recall": Query(lambda s, d: Store(s, d).recall("drift digest").select("id", F.round("score", 9).alias("score"), "rank")),
    "snk15_ready_tool": Query(lambda s, d: Store(s, d).ready(limit=10).select("id", "score")),
    "cod15_prints": Query(_streams),
}
