"""Trees, dependency graphs and version chains.

Closures come from hierarchies found by components and walks; bounded searches
are frontier joins with a set number of rounds.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.constants import CLOSED
from graphloom.operators import hierarchy
from graphloom.operators.components import connected_components
from graphloom.staging import stage

MOST_DEPTH = 32


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) over the kept parent links; loops have no ancestors."""
    found = hierarchy.hierarchies(hierarchy.parent_links(edges)).where("state = 'tree'")
    return hierarchy.descendants(found).select("ancestor", F.col("id").alias("descendant"), F.col("distance").alias("depth"))


def closure_added(tree: DataFrame, child: str, parent: str) -> DataFrame:
    """Rows that a new link adds: the parent and its ancestors times the child and its descendants.

    The product is the operator's result; which side is sent is left to the planner,
    which knows their sizes.
    """
    spark = tree.sparkSession
    own = spark.createDataFrame([(parent, 0)], "ancestor string, a int")
    ups = tree.where(F.col("descendant") == parent).select("ancestor", F.col("depth").alias("a")).unionByName(own)
    mine = spark.createDataFrame([(child, 0)], "descendant string, b int")
    downs = tree.where(F.col("ancestor") == child).select("descendant", F.col("depth").alias("b")).unionByName(mine)
    return downs.crossJoin(ups).select("ancestor", "descendant", (F.col("a") + F.col("b") + 1).alias("depth"))


def closure_removed(tree: DataFrame, child: str) -> DataFrame:
    """The closure without what hangs on the link from ``child`` to its parent."""
    below = tree.where(F.col("ancestor") == child).select("descendant").union(tree.sparkSession.createDataFrame([(child,)], "descendant string"))
    above = tree.where(F.col("descendant") == child).select("ancestor")
    gone = below.crossJoin(above).select("ancestor", "descendant")
    return tree.join(gone, ["ancestor", "descendant"], "left_anti")


def move_verdict(tree: DataFrame, child: str, parent: str) -> str:
    """ok, or why ``child`` can't move under ``parent``: cycle or depth."""
    if child == parent or tree.where((F.col("ancestor") == child) & (F.col("descendant") == parent)).limit(1).count():
        return "cycle"
    up = tree.where(F.col("descendant") == parent).agg(F.max("depth")).first()[0] or 0
    down = tree.where(F.col("ancestor") == child).agg(F.max("depth")).first()[0] or 0
    return "depth" if up + 1 + down > MOST_DEPTH else "ok"


def blocker_counts(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, open_blockers): unfinished records that block each record."""
    source = nodes.where(~F.col("status").isin(*CLOSED)).select(F.col("id").alias("src"))
    return blocks.join(source, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("open_blockers"))


def ancestor_blocker_counts(tree: DataFrame, blockers: DataFrame) -> DataFrame:
    """(id, anc_blockers): blocked ancestors of each record."""
    blocked = blockers.where("open_blockers > 0").select(F.col("id").alias("ancestor"))
    return tree.join(blocked, "ancestor").groupBy(F.col("descendant").alias("id")).agg(F.count("*").alias("anc_blockers"))


def reach(edges: DataFrame, starts: DataFrame, depth: int, down: bool = True) -> DataFrame:
    """(start, id, depth) of all ids within ``depth`` steps, at their least depth.

    ``edges`` (src, dst), ``starts`` (start).  Each round joins the newly found
    ids only and is staged, so that lineage doesn't grow.
    """
    a, b = ("src", "dst") if down else ("dst", "src")
    seen = stage(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct(), "reach")
    fresh, old = seen, [seen]
    for k in range(1, depth + 1):
        nxt = fresh.join(edges.select(F.col(a).alias("id"), F.col(b).alias("to")), "id").select("start", F.col("to").alias("id")).distinct()
        fresh = stage(nxt.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(k)), "reach")
        if not fresh.limit(1).count():
            break
        old.append(fresh)
        seen = seen.unionByName(fresh)
    return seen


def acyclicity(edges: DataFrame, candidates: DataFrame, depth: int = 64, most: int = 512) -> DataFrame:
    """(src, dst, verdict, path) of new edges: cycle if src can be reached from dst, else depth, reach or clear.

    The search from a dst stops when it has met its src, after ``depth`` steps, or
    once it has reached ``most`` ids; what cut it is named in the verdict.  ``path`` is
    a shortest way from dst to src, the least of equal length, null without a cycle.
    """
    asked = candidates.select("src", "dst").distinct()
    seen = stage(asked.select("src", "dst", F.col("dst").alias("id"), F.array("dst").alias("path"), F.lit(0).alias("depth")), "search")
    tables, fresh = [seen], seen
    ways = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct()

    def every() -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    for k in range(1, depth + 1):
        ended = every().groupBy("src", "dst").agg(F.count("*").alias("n"), F.max(F.col("id") == F.col("src")).alias("hit")).where((F.col("n") >= most) | F.col("hit")).select("src", "dst")
        going = fresh.join(ended, ["src", "dst"], "left_anti").join(ways, "id").groupBy("src", "dst", F.col("to").alias("id")).agg(F.min(F.concat("path", F.array("to"))).alias("path"))
        fresh = stage(going.join(every().select("src", "dst", "id"), ["src", "dst", "id"], "left_anti").withColumn("depth", F.lit(k)), "search")
        if not fresh.limit(1).count():
            break
        tables.append(fresh)
    per = every().groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.min(F.when(F.col("id") == F.col("src"), F.col("path"))).alias("path"))
    verdict = F.when(F.col("path").isNotNull(), "cycle").when(F.col("n") >= most, "reach").when(F.col("deepest") >= depth, "depth").otherwise("clear")
    return per.select("src", "dst", verdict.alias("verdict"), "path")


def dependency_rows(blocks: DataFrame, roots: DataFrame, nodes: DataFrame, depth: int = 4, down: bool = True) -> DataFrame:
    """(root, id, depth, path) of every way through unfinished records, each occurrence a row.

    An id that is on its own path already is shown once more as a leaf.
    """
    a, b = ("src", "dst") if down else ("dst", "src")
    shown = nodes.where(~F.col("status").isin(*CLOSED)).select(F.col("id").alias("to"))
    ways = blocks.select(F.col(a).alias("id"), F.col(b).alias("to")).join(shown, "to")
    at = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit(False).alias("leaf"))
    out = at
    for k in range(1, depth + 1):
        step = at.where("not leaf").join(ways, "id").select("root", F.col("to").alias("id"), F.lit(k).alias("depth"), F.concat("path", F.array("to")).alias("path"), F.array_contains("path", F.col("to")).alias("leaf"))
        at = stage(step, "ways")
        if not at.limit(1).count():
            break
        out = out.unionByName(at)
    return out.drop("leaf")


def _kahn(n: int, older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    """Places of versions 0 to n - 1, numbered by clock, in Kahn's order; what lies on loops follows by clock."""
    links = np.unique(np.stack([older, newer], 1).astype(np.int64), axis=0)
    ends = np.searchsorted(links[:, 0], np.arange(n + 1))
    waits = np.bincount(links[:, 1], minlength=n)
    place = np.full(n, -1, np.int64)
    ready, k = np.flatnonzero(waits == 0).tolist(), 0
    while ready:
        i = heapq.heappop(ready)
        place[i], k = k, k + 1
        for j in links[ends[i] : ends[i + 1], 1].tolist():
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, j)
    place[place < 0] = np.arange(k, n)
    return place


def _ordered(group: pd.DataFrame) -> pd.DataFrame:
    """Kahn's order of one chain whose task has the ids."""
    number = dict(zip(group["id"], group["at"], strict=True))
    links = [(number[o], k) for k, olds in zip(group["at"], group["older"], strict=True) for o in olds if o in number]
    place = _kahn(len(group), *np.array(links, np.int64).reshape(-1, 2).T)
    return pd.DataFrame({"chain": group["chain"], "id": group["id"], "place": place[group["at"]]})


def _ordered_numbers(group: pd.DataFrame) -> pd.DataFrame:
    """Kahn's order of one chain by the numbers of its versions alone."""
    n = int(group["n"].iloc[0])
    return pd.DataFrame({"c": group["c"].iloc[0], "at": np.arange(n), "place": _kahn(n, group["before"].to_numpy(), group["at"].to_numpy())})


def version_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(newer, older) by supersession edges and head pointers, both ends known records."""
    s = edges.where("type = 'supersedes' and src <> dst").select(F.col("src").alias("newer"), F.col("dst").alias("older"))
    every = s.unionByName(nodes.where("head_id is not null and head_id <> '' and head_id <> id").select(F.col("head_id").alias("newer"), F.col("id").alias("older"))).distinct()
    known = nodes.select("id")
    return every.join(known.withColumnRenamed("id", "newer"), "newer", "left_semi").join(known.withColumnRenamed("id", "older"), "older", "left_semi")


def version_chains(edges: DataFrame, nodes: DataFrame, largest: int = 10_000) -> DataFrame:
    """(chain, id, place): versions of a record from oldest to newest.

    The order is Kahn's by supersession, ties by clock, at any size.  The task
    of a chain of more than ``largest`` versions gets only their numbers by
    clock and the links between these, not ids.
    """
    links = stage(version_links(edges, nodes), "versions")
    comp = stage(connected_components(links).withColumnRenamed("comp", "chain"), "chains")
    sizes = stage(comp.groupBy("chain").agg(F.count("*").cast("int").alias("n")).withColumn("c", F.monotonically_increasing_id()), "sizes")
    clock = Window.partitionBy("c").orderBy(F.asc_nulls_last("hlc"), F.asc_nulls_last("site_id"), "id")
    known = comp.join(sizes, "chain").join(nodes.select("id", "hlc", "site_id"), "id", "left")
    sized = stage(known.select("chain", "c", "n", "id", (F.row_number().over(clock) - 1).alias("at")), "sized")
    few = sized.where(F.col("n") <= largest).select("chain", "id", "at")
    older = links.withColumnRenamed("newer", "id").join(few.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_set("older").alias("older"))
    rows = few.join(older, "id", "left").withColumn("older", F.coalesce("older", F.array().cast("array<string>")))
    small = rows.groupBy("chain").applyInPandas(_ordered, "chain string, id string, place int")
    many = sized.where(F.col("n") > largest)
    pairs = links.select(F.col("newer").alias("id"), "older").join(many, "id").select("c", "n", "at", F.col("older").alias("id")).join(many.select("id", F.col("at").alias("before")), "id")
    placed = pairs.select("c", "n", "at", "before").groupBy("c").applyInPandas(_ordered_numbers, "c long, at int, place int")
    return small.unionByName(many.join(placed, ["c", "at"]).select("chain", "id", "place"))


def version_heads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chain, id, votes, place): versions that none supersedes, by votes and clock; more than one is a fork.

    Votes are head pointers of other members.  A chain in which all are superseded
    (a loop) has all its members as heads.
    """
    links = stage(version_links(edges, nodes), "versions")
    comp = connected_components(links).withColumnRenamed("comp", "chain")
    votes = nodes.where("head_id is not null and head_id <> id").groupBy(F.col("head_id").alias("id")).agg(F.count("*").alias("votes"))
    older = links.select(F.col("older").alias("id"), F.lit(True).alias("old")).distinct()
    marked = comp.join(older, "id", "left").withColumn("free", F.col("old").isNull())
    some = F.max("free").over(Window.partitionBy("chain"))
    heads = marked.withColumn("some", some).where("free or not some").join(nodes.select("id", "hlc", "site_id"), "id").join(votes, "id", "left").fillna(0, ["votes"])
    w = Window.partitionBy("chain").orderBy(F.desc("votes"), F.desc("hlc"), F.desc("site_id"), F.desc("id"))
    return heads.select("chain", "id", "votes", F.row_number().over(w).alias("place"))


def move_set(starts: DataFrame, edges: DataFrame, nodes: DataFrame, follow_blocks: bool = True) -> DataFrame:
    """(id) that moves with ``starts``: all versions of each, and what they block, to a fixed point.

    Links are followed both ways, so the fixed point is every component that
    holds a start, however long its chains are.
    """
    links = version_links(edges, nodes).select(F.col("newer").alias("a"), F.col("older").alias("b"))
    if follow_blocks:
        links = links.unionByName(edges.where("type = 'blocks'").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    comp = stage(connected_components(links), "moves")
    own = starts.select("id").distinct()
    held = comp.join(own, "id", "left_semi").select("comp").distinct()
    return own.unionByName(comp.join(held, "comp", "left_semi").select("id")).distinct()


def crossing(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with exactly one end inside ``moved``."""
    m = moved.select("id", F.lit(True).alias("in"))
    both = edges.join(m.select(F.col("id").alias("src"), F.col("in").alias("s")), "src", "left").join(m.select(F.col("id").alias("dst"), F.col("in").alias("t")), "dst", "left")
    return both.where(F.coalesce("s", F.lit(False)) != F.coalesce("t", F.lit(False))).select("src", "type", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end, counted on both sides."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def payload(edges: DataFrame, nodes: DataFrame, most: int = 25_000) -> DataFrame:
    """Edges among the ``most`` records of greatest degree."""
    top = nodes.select("id").join(degrees(edges), "id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "id").limit(most).select("id")
    return edges.join(top.withColumnRenamed("id", "src"), "src", "left_semi").join(top.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst")


def marked_cycles(links: DataFrame) -> DataFrame:
    """Parent links (id, parent, ts, ctr, site_id) after a merge, with the last link of each loop marked.

    Each child keeps its link of the greatest clock.  Where the kept links form a
    loop, the one that came last by clock is what closed it: it is kept and
    marked, so that trees leave it out and no replica fails.
    """
    clock = F.struct("ts", "ctr", "site_id")
    kept = stage(links.groupBy("id").agg(F.max_by("parent", F.struct("ts", "ctr", "site_id", "parent")).alias("parent"), F.max(clock).alias("clock")), "kept")
    found = hierarchy.hierarchies(kept.select(F.lit("parent").alias("link"), "id", "parent"))
    on_loop = kept.join(found.where("state = 'cycle'").select("id", "root"), "id")
    last = on_loop.groupBy("root").agg(F.max_by("id", F.struct("clock", "id")).alias("id")).select("id", F.lit(True).alias("cycle"))
    return kept.join(last, "id", "left").select("id", "parent", F.coalesce("cycle", F.lit(False)).alias("cycle"))
