from __future__ import annotations

import random

import pytest

from graphloom.operators import hierarchy as h
from graphloom.operators.components import connected_components

LINK = "link string, id string, parent string"


def brute(parents: dict[str, str]) -> dict[str, tuple]:
    out = {}
    for x in {*parents, *parents.values()}:
        chain = [x]
        while chain[-1] in parents and parents[chain[-1]] not in chain:
            chain.append(parents[chain[-1]])
        if chain[-1] not in parents:
            out[x] = (chain[-1], len(chain) - 1, "/".join(reversed(chain)), "tree")
            continue
        at = chain.index(parents[chain[-1]])
        root = min(chain[at:])
        out[x] = (root, 0, x, "cycle") if at == 0 else (root, at, "/".join(reversed(chain[: at + 1])), "below")
    return out


def run(spark, parents: dict[str, str], largest: int) -> dict[str, tuple]:
    df = spark.createDataFrame([("parent", *x) for x in parents.items()], LINK)
    rows = h.with_paths(h.hierarchies(df, largest)).collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: (r["root"], r["depth"], r["path"], r["state"]) for r in rows}


@pytest.mark.parametrize("largest", [100_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed, largest):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(140)]
    parents = {x: rng.choice(ids[: max(1, i)] if rng.random() < 0.9 else ids) for i, x in enumerate(ids) if rng.random() < 0.9}
    assert run(spark, parents, largest) == brute(parents)


@pytest.mark.parametrize("largest", [100_000, 10])
def test_long_chain_hub_and_loops(spark, largest):
    parents = {f"c{i:04d}": f"c{i + 1:04d}" for i in range(150)} | {f"h{i:03d}": "hub" for i in range(200)} | {"self": "self", "x": "y", "y": "z", "z": "x", "t": "x"}
    assert run(spark, parents, largest) == brute(parents)


def test_components_split_over_batches():
    import pandas as pd

    rows = [("parent", f"k{c}", f"k{c}-{i}", None if i == 0 else f"k{c}-{i - 1}") for c in range(5) for i in range(7)]
    df = pd.DataFrame(rows, columns=["link", "comp", "id", "parent"])
    for size in (1, 2, 3, 7, 8, 35):
        got = pd.concat(list(h._walk_partition(df.iloc[a : a + size] for a in range(0, len(df), size))))
        assert dict(zip(got["id"], got["depth"], strict=True)) == {f"k{c}-{i}": i for c in range(5) for i in range(7)}


def test_links_of_tables(spark):
    edges = spark.createDataFrame(
        [("a", "parent", "b", 1, "s", None, "{}"), ("a", "parent", "c", 2, "s", None, None), ("d", "parent", "e", 1, "s", None, '{"cycle": 1}'), ("f", "parent", "g", 1, "s", None, "{}"), ("f", "parent", "g", 2, "s", 5, "{}"), (None, "parent", "x", 1, "s", None, "{}"), ("q", "blocks", "r", 1, "s", None, "{}")] * 2,
        "src string, type string, dst string, hlc long, site_id string, deleted_at long, attrs string",
    )
    assert [tuple(r) for r in h.parent_links(edges).collect()] == [("parent", "a", "c")]
    nodes = spark.createDataFrame([("a", 1, "s", "b", 1), ("a", 2, "s", None, None), ("c", 1, "s", "", None), ("d", 1, "s", "e", 3), (None, 1, "s", "e", None)], "id string, hlc long, site_id string, head_id string, deleted_at long")
    assert [tuple(r) for r in h.head_links(nodes).collect()] == [("head", "d", "e")]
    assert h.hierarchies(h.parent_links(edges.where("false"))).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["comp"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for p in pairs if p[0] is not None for x in p}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("largest", [100_000, 2])
def test_ids_with_slashes_keep_their_ancestors(spark, largest):
    df = spark.createDataFrame([("parent", "x", "a/b"), ("parent", "a/b", "top/"), ("parent", "y", "a")], LINK)
    got = {(r["ancestor"], r["id"], r["distance"]) for r in h.descendants(h.hierarchies(df, largest)).collect()}
    assert got == {("a/b", "x", 1), ("top/", "x", 2), ("top/", "a/b", 1), ("a", "y", 1)}


def test_component_beyond_the_bound_of_one_task(spark):
    """More than 100 000 nodes in one tree: paths by doubling, depths as counted."""
    n = 120_000
    df = spark.range(1, n).selectExpr("'parent' as link", "cast(id as string) as id", "cast(id div 7 as string) as parent")
    out = h.hierarchies(df).selectExpr("count(*) as n", "max(depth) as deep", "min(root) as low", "max(root) as high", "count_if(size(ids) = depth + 1 and element_at(ids, -1) = id) as whole").first()
    assert (out["n"], out["deep"], out["low"], out["high"], out["whole"]) == (n, 7, "0", "0", n)
