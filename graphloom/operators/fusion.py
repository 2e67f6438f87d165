"""Fusing ranked lists, boosting, graph expansion and budgeted answers."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.constants import DAY_MS

# Weights of ranking.
LAYER_WEIGHTS = {"prime": (0.9, 1.0, 1.1, 1.2), "deep": (1.15, 1.15, 1.0, 0.9), "balanced": (1.0, 1.0, 1.0, 1.0)}
ANCHOR_WEIGHTS = {"stale": 0.5, "lost": 0.2}
WEAK_TYPES = ("mentions", "touches")


@dataclass(frozen=True)
class Settings:
    k: float = 60.0
    missing: float = 1000.0
    w_text: float = 1.0
    w_vector: float = 1.0
    seeds: int = 15
    hops: int = 2
    decay: tuple[float, ...] = (0.5, 0.5)
    least_weight: float = 0.3
    fan_out: int = 64
    hop2_seeds: int = 12
    profile: str = "balanced"
    amplitude: float = 0.25
    tau: float = 90.0


def rrf(text_rank: Column, vector_rank: Column, s: Settings = Settings()) -> Column:
    """Reciprocal ranks added up; a list that lacks the record counts with a penalty rank."""
    return F.lit(s.w_text) / (s.k + F.coalesce(text_rank, F.lit(s.missing))) + F.lit(s.w_vector) / (s.k + F.coalesce(vector_rank, F.lit(s.missing)))


def boost(now_ms: int, s: Settings = Settings()) -> Column:
    """Priority times freshness times layer; needs priority, updated_at in ms and layer."""
    p = F.col("priority")
    priority = F.when(p == 0, 1.3).when(p == 1, 1.15).when(p == 3, 0.9).otherwise(1.0).cast("double")
    days = F.greatest(F.lit(0), F.floor((F.lit(now_ms) - F.col("updated_at")) / DAY_MS))
    freshness = 1 + F.lit(s.amplitude) * F.exp(-days / F.lit(s.tau))
    weights = LAYER_WEIGHTS[s.profile]
    layer = F.greatest(F.lit(0), F.least(F.lit(3), F.col("layer")))
    return priority * freshness * F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (layer + 1).cast("int"))


def anchor_weight(touches: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, anchor_weight) of records with anchors: the greatest weight among their states."""
    drift = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("drift")))
    state = F.when(F.col("status") == "stale", ANCHOR_WEIGHTS["stale"]).when(F.col("status") == "lost", ANCHOR_WEIGHTS["lost"])
    weight = state.when(F.col("status") == "drifted", F.coalesce(drift, F.lit(1.0))).otherwise(1.0)
    return touches.join(anchors.select(F.col("id").alias("dst"), "status", "drift"), "dst").groupBy(F.col("src").alias("id")).agg(F.max(weight).alias("anchor_weight"))


def hop(seeds: DataFrame, edges: DataFrame, known: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Neighbours of ranked seeds in both directions, the best way to each, at most ``fan_out``.

    ``seeds`` (id, rank) are few by their limits and so are sent to the edges;
    hub neighbours aren't gathered but numbered after a top cut per node.
    """
    few = F.broadcast(seeds.select(F.col("id").alias("via"), F.col("rank").alias("via_rank")))
    strong = edges.where(F.col("weight") >= s.least_weight)
    out = strong.select(F.col("src").alias("via"), F.col("dst").alias("id"), "type", "weight").join(few, "via")
    back = strong.select(F.col("dst").alias("via"), F.col("src").alias("id"), "type", "weight").join(few, "via")
    ways = out.unionByName(back).join(F.broadcast(known.select("id")), "id", "left_anti")
    best = F.struct("via_rank", (-F.col("weight")).alias("w"), "via", "type")
    each = ways.groupBy("id").agg(F.min(best).alias("b"))
    rows = each.select("id", F.col("b.via").alias("via"), F.col("b.type").alias("type"), (-F.col("b.w")).alias("weight"), F.col("b.via_rank").alias("via_rank"))
    return rows.orderBy("via_rank", F.desc("weight"), "id").limit(s.fan_out)


def graph_score(rows: DataFrame, via_scores: DataFrame, depth: int, s: Settings = Settings()) -> DataFrame:
    """Scores of expanded records: of the record they came by, decayed; others are dropped."""
    kind = F.when(F.col("type").isin(*WEAK_TYPES), 0.5).otherwise(1.0)
    joined = rows.join(F.broadcast(via_scores.select(F.col("id").alias("via"), F.col("score").alias("via_score"))), "via")
    return joined.withColumn("score", F.col("via_score") * s.decay[depth - 1] * F.col("weight") * kind * F.coalesce("anchor_weight", F.lit(1.0))).withColumn("depth", F.lit(depth))


def federated(lists: list[tuple[DataFrame, float]], k: float = 60.0, missing: float = 1000.0, cap: int = 8) -> DataFrame:
    """(id, score) over ranked lists (id, rank) with weights; absent records count with the penalty rank."""
    lists = lists[:cap]
    tagged = [df.select("id", "rank", F.lit(i).alias("list")) for i, (df, _) in enumerate(lists)]
    every = tagged[0]
    for x in tagged[1:]:
        every = every.unionByName(x)
    parts = [F.lit(w) / (k + F.coalesce(F.min(F.when(F.col("list") == i, F.col("rank"))), F.lit(missing))) for i, (_, w) in enumerate(lists)]
    return every.groupBy("id").agg(sum(parts[1:], parts[0]).alias("score"))


def crux(text: str | None, most: int = 300) -> str:
    """A text cut at a sentence's end, else at a blank, with an ellipsis if cut."""
    if text is None or most < 1:
        return ""
    flat = " ".join(text.split())
    if len(flat) <= most:
        return flat
    head, low = flat[: most + 1], math.floor(most * 0.6)
    cut = next((i + 1 for i in range(len(head) - 1, low - 1, -1) if head[i] in ".!?" and (i + 1 >= len(head) or head[i + 1] == " ")), -1)
    if cut < 0:
        blank = head.rfind(" ")
        cut = blank if blank >= low else most - 1
    out = head[:cut].rstrip()
    return out if out[-1:] in (".", "!", "?", "…") else out + "…"


def pack(texts: list[tuple[str | None, str | None]], budget: int, reserve: float = 0.1, most: int = 300) -> list[tuple[str, int] | None]:
    """What of each (excerpt, content) fits: ("full" | "crux", cost), or None.

    First each in order as its crux, skipping those that don't fit; then in order
    whole contents in place of cruxes while they fit.
    """
    usable = max(0, math.floor(max(0, budget) * (1 - min(max(reserve, 0.0), 0.9))))
    used, out, shorts = 0, [], []
    for excerpt, content in texts:
        short = crux(excerpt or content or "", most)
        whole = content is not None and short in (content.strip(), " ".join(content.split()))
        text = content.strip() if whole and content is not None else short
        cost = len(text) + 1
        if used + cost <= usable:
            used += cost
            out.append(("full" if whole else "crux", cost))
        else:
            out.append(None)
        shorts.append(content)
    for i, entry in enumerate(out):
        content = shorts[i]
        if entry is None or entry[0] == "full" or not content or not content.strip():
            continue
        cost = len(content.strip()) + 1
        if used - entry[1] + cost <= usable:
            used += cost - entry[1]
            out[i] = ("full", cost)
    return out


def assembled(answers: DataFrame, budget: int, reserve: float = 0.1) -> DataFrame:
    """(answer, rank, id, kind, cost) of what fits each answer's budget.

    ``answers`` has answer, rank, id, excerpt and content; an answer is at most a
    pool of hits, so a group is small.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "id"])
        clean = [tuple(None if pd.isna(x) else x for x in row) for row in group[["excerpt", "content"]].itertuples(index=False)]
        got = pack(clean, budget, reserve)
        group = group.assign(kind=[g[0] if g else "omitted" for g in got], cost=[g[1] if g else 0 for g in got])
        return group[["answer", "rank", "id", "kind", "cost"]]

    return answers.select("answer", "rank", "id", "excerpt", "content").groupBy("answer").applyInPandas(run, "answer string, rank int, id string, kind string, cost int")


def prefix_filled(rows: DataFrame, group: str, order: str, cost: Column, budget: int, least: int = 48) -> DataFrame:
    """Blocks up to the first that overflows, which is clipped if enough is left; all after it are dropped."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    kept = F.least(cost, left)
    return rows.withColumns({"kept": kept, "clipped": kept < cost}).where((F.col("kept") > 0) & (~F.col("clipped") | (F.col("kept") >= least)))


def page(ranked: DataFrame, limit: int, after: tuple[float, str] | None = None) -> DataFrame:
    """The next ``limit`` rows of (id, rank), after a cursor: the rank and id of the last row of the page before."""
    rows = ranked if after is None else ranked.where((F.col("rank") > after[0]) | ((F.col("rank") == after[0]) & (F.col("id") > after[1])))
    return rows.orderBy("rank", "id").limit(limit)


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


