"""Queries of predicates and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.constants import NOW_MS
from graphloom.operators import visibility as vis
from graphloom.operators.current import attribute, current_edges, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table

VIEWER = vis.Viewer("u-007", "team-harbor", "agent-19")
SESSION, REPO = "ses-487701", "kiln/parser"


def nodes(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes"), *columns)


def _grants(n: DataFrame) -> DataFrame:
    """Restricted records are granted to their owner and team."""
    closed = n.where("acl = 'restricted'")
    return closed.select(F.col("id").alias("node_id"), F.concat(F.lit("user:"), "owner_id").alias("principal")).unionByName(
        closed.select(F.col("id").alias("node_id"), F.concat(F.lit("team:"), "team_id").alias("principal"))
    )


def _access(s: SparkSession, d: str, rule) -> DataFrame:
    n = nodes(s, d, "acl", "owner_id", "team_id", "agent_id")
    return vis.granted(n, _grants(n), VIEWER).where(rule(VIEWER)).select("id", "acl")


_GRANTED = "(acl = 'restricted' AND (owner_id = 'u-007' OR team_id = 'team-harbor'))"
_CORE = f"(acl = 'team' AND (team_id = 'team-harbor' OR team_id = '')) OR (acl = 'private' AND owner_id = 'u-007') OR (acl = 'agent' AND agent_id = 'agent-19') OR {_GRANTED}"
_RETR = f"(acl = 'team' AND team_id = 'team-harbor') OR (acl = 'private' AND owner_id = 'u-007') OR (acl = 'agent' AND agent_id = 'agent-19') OR {_GRANTED}"
_REACH = f"""(CASE coalesce({q.attr('reach')}, '') WHEN 'project' THEN true WHEN 'session' THEN coalesce({q.attr('session_id')}, '') = '{SESSION}'
  ELSE coalesce({q.attr('episode_id')}, '') = '' OR 'episode:' || {q.attr('episode_id')} = '{SESSION}' END)"""
_REPO = f"({q.attr('repo')} IS NULL OR {q.attr('repo')} IN ('', '{REPO}'))"


def _pick(s: SparkSession, d: str, condition, *columns: str) -> DataFrame:
    return nodes(s, d, *columns).where(condition).select("id")


def _tags():
    return F.coalesce(F.from_json(attribute("tags"), "array<string>"), F.array())


def _list(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "kind", "status", "priority", "attrs", "assignee", "acl", "updated_at")
    kept = n.where(F.col("kind").isin("task", "note") & F.col("status").isin("open", "active") & F.col("priority").isin(0, 1, 2))
    kept = kept.where(F.array_contains(_tags(), "crdt") & (F.coalesce("assignee", F.lit("")) == "") & (F.col("acl") == "team"))
    return kept.where(F.col("updated_at").between(NOW_MS - 1000 * 86_400_000, NOW_MS)).orderBy("priority", F.desc("updated_at"), "id").select("id", "priority", "updated_at")


_TAGS = "CASE WHEN json_type(attrs, '$.tags') = 'ARRAY' THEN CAST(json_extract(attrs, '$.tags') AS VARCHAR[]) ELSE [] END"


def _drops(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "kind", "updated_at", "attrs", "acl", "owner_id")
    failed = {
        "kind": ~F.col("kind").isin("task", "note"),
        "since": F.col("updated_at") < NOW_MS - 600 * 86_400_000,
        "tag": ~F.array_contains(_tags(), "crdt"),
        "acl": F.col("acl") != "team",
        "reach": ~vis.in_reach(SESSION),
        "repo": ~vis.in_repo(REPO),
    }
    return n.select("id", vis.drop_mask(failed).alias("mask"))


_MASK = f"""dm AS (SELECT id, CAST(kind NOT IN ('task', 'note') AS INT) + CAST(updated_at < {NOW_MS - 600 * 86_400_000} AS INT) * 2 + CAST(NOT list_contains({_TAGS}, 'crdt') AS INT) * 8
 + CAST(acl <> 'team' AS INT) * 16 + CAST(NOT {_REACH} AS INT) * 128 + CAST(NOT {_REPO} AS INT) * 512 AS mask FROM n)"""
_REASON = "CASE WHEN bit_count(mask) > 1 THEN 'several' WHEN mask = 1 THEN 'kind' WHEN mask = 2 THEN 'since' WHEN mask = 8 THEN 'tag' WHEN mask = 16 THEN 'acl' WHEN mask = 128 THEN 'reach' WHEN mask = 512 THEN 'repo' END"


def _lost(s: SparkSession, d: str) -> DataFrame:
    touches = current_edges(table(s, d, "edges"), "weight", types=("touches", "mentions")).select("src", "dst")
    states = nodes(s, d, "status").select("id", F.when(F.col("status").isin("superseded", "retracted"), "lost").otherwise(F.col("status")).alias("status"))
    return vis.lost_owners(touches, states)


_LOST = "SELECT e.src AS id FROM e JOIN n a ON a.id = e.dst WHERE e.type IN ('touches', 'mentions') GROUP BY 1 HAVING min(CASE WHEN a.status IN ('superseded', 'retracted') THEN 1 ELSE 0 END) = 1"


def _simple(condition: str) -> str:
    return q.with_(q.N) + f"SELECT id FROM n WHERE {condition}"


def _visible_rows(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "acl", "owner_id", "team_id", "agent_id")
    return vis.granted(n, _grants(n), VIEWER).select("id", F.coalesce(vis.access_core(VIEWER), F.lit(False)).alias("visible"))


QUERIES = {
    "flt1_live": Query(lambda s, d: nodes(s, d).select("id"), _simple("true")),
    "flt2_heads": Query(lambda s, d: _pick(s, d, vis.history(False), "head_id"), _simple("head_id IS NULL")),
    "flt2_full_history": Query(lambda s, d: _pick(s, d, vis.history(True), "head_id"), _simple("true")),
    "flt3_live_status": Query(lambda s, d: _pick(s, d, vis.live_status(), "status"), _simple(f"status NOT IN {q.HIDDEN}")),
    "flt4_not_pending": Query(lambda s, d: _pick(s, d, vis.not_pending(), "attrs"), _simple(f"{q.attr('state')} IS DISTINCT FROM 'pending_review'")),
    # drafts stand for records under review, of which the tables have none
    "flt5_awaiting_review": Query(
        lambda s, d: nodes(s, d, "attrs", "status").withColumn("attrs", F.replace("attrs", F.lit('"state": "draft"'), F.lit('"state": "pending_review"'))).where(vis.awaiting_review()).select("id"),
        _simple(f"{q.attr('state')} IN ('draft', 'pending_review') AND status NOT IN {q.HIDDEN}"),
    ),
    "flt6_access_core": Query(lambda s, d: _access(s, d, vis.access_core), q.with_(q.N) + f"SELECT id, acl FROM n WHERE {_CORE}"),
    "flt7_access_retrieval": Query(lambda s, d: _access(s, d, vis.access_retrieval), q.with_(q.N) + f"SELECT id, acl FROM n WHERE {_RETR}"),
    "flt8_visible_to": Query(_visible_rows, q.with_(q.N) + f"SELECT id, coalesce({_CORE}, false) AS visible FROM n"),
    "flt9_repo": Query(lambda s, d: _pick(s, d, vis.in_repo(REPO), "attrs"), _simple(_REPO)),
    "flt9_repo_wildcard": Query(lambda s, d: _pick(s, d, vis.in_repo(REPO, wildcard=True), "attrs"), _simple(f"{_REPO} OR {q.attr('repo')} = 'all'")),
    "flt10_reach": Query(lambda s, d: _pick(s, d, vis.in_reach(SESSION), "attrs"), _simple(_REACH)),
    "flt11_unknown_reach": Query(lambda s, d: _pick(s, d, vis.unknown_reach(), "attrs"), _simple(f"coalesce({q.attr('reach')}, '') NOT IN ('session', 'project') AND coalesce({q.attr('episode_id')}, '') = ''")),
    "flt12_anchors_lost": Query(_lost, q.with_(q.N, q.E) + _LOST),
    "flt12_anchors_alive": Query(lambda s, d: nodes(s, d).select("id").join(_lost(s, d), "id", "left_anti"), q.with_(q.N, q.E) + f"SELECT id FROM n WHERE id NOT IN ({_LOST})"),
    "flt13_not_epic": Query(lambda s, d: _pick(s, d, vis.not_epic(), "attrs"), _simple(f"coalesce({q.attr('type')}, '') <> 'epic'")),
    "flt14_optional": Query(
        lambda s, d: (lambda n, kind, scope: n.where(F.col("kind") == kind if kind else F.lit(True)).where(F.col("scope") == scope if scope else F.lit(True)).select("id"))(nodes(s, d, "kind", "scope"), "note", ""),
        _simple("kind = 'note'"),
    ),
    "flt15_list": Query(
        _list,
        q.with_(q.N)
        + f"SELECT id, priority, updated_at FROM n WHERE kind IN ('task', 'note') AND status IN ('open', 'active') AND priority IN (0, 1, 2) AND list_contains({_TAGS}, 'crdt') AND coalesce(assignee, '') = '' AND acl = 'team' AND updated_at BETWEEN {NOW_MS - 1000 * 86_400_000} AND {NOW_MS}",
    ),
    "flt16_drop_reasons": Query(
        lambda s, d: _drops(s, d).where("mask <> 0").groupBy(vis.drop_reason(F.col("mask")).alias("reason")).agg(F.count("*").alias("n")), q.with_(q.N, _MASK) + f"SELECT {_REASON} AS reason, count(*) AS n FROM dm WHERE mask <> 0 GROUP BY 1"
    ),
    "flt16_drop_masks": Query(_drops, q.with_(q.N, _MASK) + "SELECT id, mask FROM dm"),
    "flt17_drop_advice": Query(
        lambda s, d: _drops(s, d).where("bit_count(mask) = 1").groupBy("mask").agg(F.count("*").alias("n")).agg(F.max_by("mask", F.struct("n", "mask")).alias("mask")).select(vis.drop_reason(F.col("mask")).alias("reason")),
        q.with_(q.N, _MASK) + f"SELECT {_REASON} AS reason FROM (SELECT mask FROM dm WHERE bit_count(mask) = 1 GROUP BY 1 ORDER BY count(*) DESC, mask DESC LIMIT 1)",
    ),
    "flt18_layers": Query(lambda s, d: (lambda low, high: _pick(s, d, F.col("layer").between(low, high), "layer"))(*sorted(int(x[1:]) for x in "L1..L2".split(".."))), _simple("layer BETWEEN 1 AND 2")),
    "flt19_focus": Query(
        lambda s, d: _pick(s, d, F.lower("title").contains("digest") | F.lower(F.coalesce("excerpt", F.lit(""))).contains("digest"), "title", "excerpt"), _simple("contains(lower(title), 'digest') OR contains(lower(coalesce(excerpt, '')), 'digest')")
    ),
    "flt20_projection": Query(lambda s, d: nodes(s, d, "kind", "scope", "status", "priority", "updated_at"), q.with_(q.N) + "SELECT id, kind, scope, status, priority, updated_at FROM n"),
}
