"""Parent-child links to full hierarchies.

Connected components are found by pointer jumping (each child has one parent,
so a component's name is the root or, where there is a loop, the smallest id of
the loop), each component is brought to one task, and an iterative depth-first
walk with node colouring gives depth, path and loops.  A component beyond
``largest`` nodes isn't brought to one task: its paths are put together by
joining path pieces of doubling length, with the same result.

Defined results: a link without child or parent is ignored; of several links of
a child the first of ``order`` counts; a child that is its own parent is a loop
of one; repeated rows change nothing; empty tables give no rows; columns other
than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.staging import release, stage

RESULT = "link string, id string, root string, depth int, ids array<string>, state string"


def parent_links(edges: DataFrame) -> DataFrame:
    """(link, id, parent) of the live ``parent`` edges, one parent per child."""
    newest = (
        edges.where("type = 'parent' and src is not null and dst is not null")
        .groupBy("src", "dst")
        .agg(F.max(F.struct("hlc", "site_id", "deleted_at", "attrs")).alias("r"))
        .where("r.deleted_at is null")
    )
    mark = F.lower(F.coalesce(F.get_json_object("r.attrs", "$.cycle"), F.lit("")))
    kept = newest.where(mark.isin("", "0", "0.0", "false", "null"))
    return kept.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("r.hlc", "r.site_id", "dst"))["dst"].alias("parent")).select(
        F.lit("parent").alias("link"), "id", "parent"
    )


def head_links(nodes: DataFrame) -> DataFrame:
    """(link, id, parent) of the head pointers of each node's newest row."""
    newest = nodes.where("id is not null").groupBy("id").agg(F.max(F.struct("hlc", "site_id", "head_id"))["head_id"].alias("parent"))
    return newest.where("parent is not null and parent <> ''").select(F.lit("head").alias("link"), "id", "parent")


def _members(links: DataFrame) -> DataFrame:
    """Every id at an end of a link, with its parent or null."""
    ends = links.select("link", F.explode(F.array(F.struct("id", "parent"), F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent")))).alias("e"))
    return ends.groupBy("link", "e.id").agg(F.max("e.parent").alias("parent"))


def components(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(link, id, parent, comp) of all ids, and the (link, id) that lie on loops.

    Round k knows the ancestor 2^k links up.  Ids that have found their root are
    left out of further rounds, so that the rows of a hub under a root are
    joined once.  As depths in a tree have no gaps, a round in which no id finds
    its root shows that all that are left lead into loops.
    """
    at = stage(
        members.select("link", "id", "parent", F.coalesce("parent", "id").alias("ptr"), F.expr("case when parent is null then id end").alias("root")),
        "links",
    )
    finished = [at.where("root is not null")]
    left, known = at.where("root is null"), at
    n_left = left.count()
    while n_left:
        up = known.select("link", F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("root").alias("found"))
        step = stage(
            left.join(up, ["link", "ptr"], "left").select("link", "id", "parent", F.coalesce("next", "ptr").alias("ptr"), F.col("found").alias("root")),
            "jump",
        )
        rest = step.where("root is null")
        n_rest = rest.count()
        if n_rest == n_left:
            break
        finished.append(step.where("root is not null"))
        left, n_left = rest, n_rest
        known = _union([*finished, rest])
    named = _union(finished).select("link", "id", "parent", F.col("root").alias("comp"))
    if not n_left:
        return named, at.where("false").select("link", "id")
    loops = _name_loops(left.select("link", "id", "parent"))
    on_loop = loops.where("on_loop").select("link", "id")
    return named.unionByName(loops.select("link", "id", "parent", "comp")), on_loop


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _name_loops(rows: DataFrame) -> DataFrame:
    """(link, id, parent, comp, on_loop) of ids whose chain never ends.

    After 2^k steps every chain has come to its loop once the set of places
    reached no longer shrinks: the step then permutes that set.  ``low`` is the
    smallest id of the next 2^k places; when no ``low`` changes any more, it
    covers whole loops.
    """
    at = stage(rows.select("link", "id", "parent", F.col("parent").alias("ptr"), F.least("id", "parent").alias("low")), "loops")
    places, settled = at.select("link", "ptr").distinct().count(), False
    while not settled:
        up = at.select("link", F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("far"))
        step = stage(
            at.join(up, ["link", "ptr"]).select("link", "id", "parent", F.col("next").alias("ptr"), F.least("low", "far").alias("low"), (F.col("far") < F.col("low")).alias("moved")),
            "loops",
        )
        now, moved = step.select(F.count_distinct("link", "ptr"), F.count_if("moved")).first()
        settled = now == places and not moved
        release(at)
        at, places = step.drop("moved"), now
        at._staged_at = step._staged_at
    ends = at.select("link", F.col("ptr").alias("place")).distinct()
    low = at.select("link", F.col("id").alias("place"), F.col("low").alias("comp"))
    named = at.withColumnRenamed("ptr", "place").join(low, ["link", "place"])
    seen = ends.select("link", F.col("place").alias("id"), F.lit(True).alias("hit"))
    return stage(named.join(seen, ["link", "id"], "left").select("link", "id", "parent", "comp", F.coalesce("hit", F.lit(False)).alias("on_loop")), "loop-names")


def walk_component(ids: list[str], parents: list[str | None]) -> list[tuple[str, str, int, tuple[str, ...], str]]:
    """(id, root, depth, ids of the path, state) of each id of whole components.

    White ids haven't been seen, grey ones lie on the present walk, black ones
    are done.  A walk goes up until it ends or meets a black id; meeting a grey
    one is a back edge that closes a loop.
    """
    parent = dict(zip(ids, parents, strict=True))
    done: dict[str, tuple[str, int, tuple[str, ...], str]] = {}
    for start in ids:
        stack, grey, at = [], set(), start
        while at not in done:
            if at in grey:
                loop = stack[stack.index(at) :]
                root = min(loop)
                done.update((x, (root, 0, (x,), "cycle")) for x in loop)
                break
            stack.append(at)
            grey.add(at)
            up = parent.get(at)
            if up is None:
                done[at] = (at, 0, (at,), "tree")
                break
            at = up
        while stack:
            x = stack.pop()
            if x not in done:
                root, depth, path, state = done[parent[x]]
                done[x] = (root, depth + 1, (*path, x), "tree" if state == "tree" else "below")
    return [(x, *done[x]) for x in ids]


def _walk_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components arrive one after the other; the last may go on in the next batch."""
    held: list[pd.DataFrame] = []

    def out(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for link, part in rows.groupby("link", sort=False):
            walked = walk_component(part["id"].tolist(), [None if x is None or x != x else x for x in part["parent"]])
            found += [(link, *x) for x in walked]
        return pd.DataFrame(found, columns=["link", "id", "root", "depth", "ids", "state"])

    for batch in batches:
        if not len(batch):
            continue
        last = (batch["link"] == batch["link"].iloc[-1]) & (batch["comp"] == batch["comp"].iloc[-1])
        if last.all() and held and (held[-1]["comp"].iloc[-1] == batch["comp"].iloc[0]):
            held.append(batch)
            continue
        ready = pd.concat([*held, batch[~last]]) if held or not last.all() else batch[~last]
        if len(ready) and held and last.all():
            yield out(pd.concat(held))
            held = [batch]
            continue
        if len(ready):
            yield out(ready)
        held = [batch[last]]
    if held:
        yield out(pd.concat(held))


def _paths_by_doubling(rows: DataFrame, on_loop: DataFrame) -> DataFrame:
    """The same result for large components, without bringing them together.

    Loops are cut at all their ids, which makes every chain end; a row holds the
    piece of path below ``ptr`` and takes over the piece above it in each round.
    """
    cut = rows.join(on_loop.withColumn("looped", F.lit(True)), ["link", "id"], "left")
    top = F.col("parent").isNull() | F.col("looped").isNotNull()
    at = stage(
        cut.select(
            "link", "id", "comp", top.alias("done"), F.coalesce("looped", F.lit(False)).alias("looped"),
            F.when(top, F.col("id")).otherwise(F.col("parent")).alias("ptr"), F.when(top, 0).otherwise(1).alias("depth"),
            F.when(top, F.array().cast("array<string>")).otherwise(F.array("id")).alias("piece"),
        ),
        "pieces",
    )
    while at.where("not done").limit(1).count():
        up = at.select("link", F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("depth").alias("more"), F.col("piece").alias("above"), F.col("done").alias("ends"))
        moving = at.where("not done").join(up, ["link", "ptr"])
        step = stage(
            at.where("done").unionByName(
                moving.select("link", "id", "comp", ((F.col("ends")) | (F.col("next") == F.col("ptr"))).alias("done"), "looped", F.col("next").alias("ptr"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("above", "piece").alias("piece"))
            ),
            "pieces",
        )
        release(at)
        at = step
    tops = at.where("looped").select("link", F.col("id").alias("ptr"), F.lit(True).alias("loop_top"))
    named = at.join(tops, ["link", "ptr"], "left")
    state = F.when(F.col("looped"), "cycle").when(F.col("loop_top"), "below").otherwise("tree")
    return named.select("link", "id", F.col("comp").alias("root"), F.col("depth").cast("int").alias("depth"), F.concat(F.array("ptr"), "piece").alias("ids"), state.alias("state"))


def hierarchies(links: DataFrame, largest: int = 100_000) -> DataFrame:
    """link, id, root, depth, ids (the path as an array), state of every id at an end of ``links``.

    ``largest`` is the greatest number of nodes that one task gets at once.
    """
    named, on_loop = components(_members(links))
    sizes = named.groupBy("link", "comp").agg(F.count("*").alias("n")).where(F.col("n") > largest)
    big = stage(sizes.select("link", "comp"), "large")
    some_big = big.limit(1).count() > 0
    small = named.join(big, ["link", "comp"], "left_anti") if some_big else named
    walked = (
        small.repartition("link", "comp").sortWithinPartitions("link", "comp").select("link", "comp", "id", "parent").mapInPandas(_walk_partition, RESULT)
    )
    if not some_big:
        return walked
    return walked.unionByName(_paths_by_doubling(named.join(big, ["link", "comp"], "left_semi"), on_loop))


def with_paths(found: DataFrame) -> DataFrame:
    """The path as one text, its ids joined with ``/``."""
    return found.select("link", "id", "root", "depth", F.array_join("ids", "/").alias("path"), "state")


def descendants(found: DataFrame) -> DataFrame:
    """(link, ancestor, id, distance) of each id and every id above it."""
    ups = found.where("depth > 0").select("link", "id", "depth", F.posexplode("ids").alias("at", "ancestor"))
    return ups.where("at < depth").select("link", "ancestor", "id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def loops(found: DataFrame) -> DataFrame:
    """Per loop its smallest id and its number of members."""
    return found.where("state = 'cycle'").groupBy("link", "root").agg(F.count("*").alias("members"), F.max("id").alias("greatest"))
