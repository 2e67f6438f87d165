"""Predicates that decide which records a viewer gets.

All are boolean columns over node columns, so that they reach the scan or the
stage that has the columns.  Two access rules exist: :func:`access_core` shows
team records without a team to all and never matches an empty viewer field,
:func:`access_retrieval` compares plainly, so that empty equals empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.constants import HIDDEN, PENDING
from graphloom.operators.current import attribute


@dataclass(frozen=True)
class Viewer:
    owner: str = ""
    team: str = ""
    agent: str = ""

    def principals(self) -> list[str]:
        pairs = (("user", self.owner), ("team", self.team), ("agent", self.agent))
        return [f"{kind}:{name}" for kind, name in pairs if name]


def granted(nodes: DataFrame, grants: DataFrame, viewer: Viewer) -> DataFrame:
    """``nodes`` with ``granted``: whether a grant names one of the viewer's principals."""
    mine = grants.where(F.col("principal").isin(viewer.principals())).select(F.col("node_id").alias("id")).distinct()
    return nodes.join(mine.withColumn("granted", F.lit(True)), "id", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def access_core(viewer: Viewer) -> Column:
    """Core rule; needs acl, team_id, owner_id, agent_id and granted."""
    acl = F.col("acl")

    def same(column: str, value: str) -> Column:
        return F.lit(bool(value)) & (F.col(column) == value)

    return (
        ((acl == "team") & (same("team_id", viewer.team) | (F.col("team_id") == "")))
        | ((acl == "private") & same("owner_id", viewer.owner))
        | ((acl == "agent") & same("agent_id", viewer.agent))
        | ((acl == "restricted") & F.col("granted"))
    )


def access_retrieval(viewer: Viewer) -> Column:
    """Retrieval rule: plain equality, empty texts included."""
    acl = F.col("acl")
    return (
        ((acl == "team") & (F.col("team_id") == viewer.team))
        | ((acl == "private") & (F.col("owner_id") == viewer.owner))
        | ((acl == "agent") & (F.col("agent_id") == viewer.agent))
        | ((acl == "restricted") & F.col("granted"))
    )


def live_status() -> Column:
    return ~F.col("status").isin(*HIDDEN)


def not_pending() -> Column:
    return ~attribute("state").eqNullSafe(F.lit(PENDING))


def awaiting_review() -> Column:
    return attribute("state").eqNullSafe(F.lit(PENDING)) & live_status()


def in_repo(repo: str, wildcard: bool = False) -> Column:
    """Records of ``repo`` and those without one; ``all`` matches too with ``wildcard``."""
    if not repo:
        return F.lit(True)
    own = attribute("repo")
    shown = own.isNull() | (own == "") | (own == repo)
    return shown | (own == "all") if wildcard else shown


def in_reach(session: str) -> Column:
    """Project records always, session records in their session, episodes in theirs."""
    reach, own, episode = (F.coalesce(attribute(k), F.lit("")) for k in ("reach", "session_id", "episode_id"))
    current = F.lit(bool(session))
    return (
        F.when(reach == "project", True)
        .when(reach == "session", current & (own == session))
        .when(episode != "", current & (F.concat(F.lit("episode:"), episode) == session))
        .otherwise(True)
    )


def unknown_reach() -> Column:
    return ~F.coalesce(attribute("reach"), F.lit("")).isin("session", "project") & (F.coalesce(attribute("episode_id"), F.lit("")) == "")


def not_epic() -> Column:
    return F.coalesce(attribute("type"), F.lit("")) != "epic"


def history(full: bool) -> Column:
    """Heads only, or every version."""
    return F.lit(True) if full else F.col("head_id").isNull()


def lost_owners(touches: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id) of records all of whose anchors are lost.

    ``touches`` are live (src, dst), ``anchors`` (id, status).
    """
    states = touches.join(anchors.select(F.col("id").alias("dst"), "status"), "dst")
    return states.groupBy(F.col("src").alias("id")).agg(F.min(F.when(F.col("status") == "lost", 1).otherwise(0)).alias("all_lost")).where("all_lost = 1").select("id")


DROP_BITS = ("kind", "since", "until", "tag", "acl", "author", "anchor", "reach", "session", "repo")


def drop_mask(failed: dict[str, Column]) -> Column:
    """One bit per failed filter, in the order of ``DROP_BITS``."""
    mask = F.lit(0)
    for bit, name in enumerate(DROP_BITS):
        if name in failed:
            mask = mask.bitwiseOR(F.when(failed[name], F.lit(1 << bit)).otherwise(F.lit(0)))
    return mask


def drop_reason(mask: Column) -> Column:
    """The only failed filter, ``several`` for more, null for none."""
    out = F.when(F.bit_count(mask) > 1, "several")
    for bit, name in enumerate(DROP_BITS):
        out = out.when(mask == 1 << bit, name)
    return out
