from __future__ import annotations

import random

from graphloom.functions.ids import prefix_range
from graphloom.operators import references as r

EDGE = "src string, type string, dst string, hlc long, site_id string, deleted_at long, created_at long, delta string, key string"
NODE = "id string, hlc long, site_id string, deleted_at long, created_at long, exists int"
A, B, C, D = (f"kiln-{x * 12}" for x in "abcd")


def found(spark, edges, nodes):
    e = spark.createDataFrame([(*x, "clash", "clash") for x in edges], EDGE)
    n = spark.createDataFrame([(*x, 9) for x in nodes], NODE)
    return sorted(tuple(x) for x in r.orphan_references(e, n).collect())


def test_reasons_and_spellings(spark):
    nodes = [(A, 1, "s", None, 5), (B, 1, "s", 7, 5), (C, 1, "s", None, 90), ("kiln-110011111111", 1, "s", None, 1)]
    edges = [
        (A, "t", B, 1, "s", None, 50),
        (A.upper(), "t", C, 1, "s", None, 50),
        (f" {A}\t", "t", "kiln-IL0O11111111", 1, "s", None, 50),
        (A, "t", D, 1, "s", None, 50),
        (A, "t", "no id", 1, "s", None, None),
    ]
    want = {(A, "t", B, "dst", "deleted", "1970-01"), (A.upper(), "t", C, "dst", "late", "1970-01"), (A, "t", D, "dst", "missing", "1970-01"), (A, "t", "no id", "dst", "missing", None)}
    e, n = spark.createDataFrame([(*x, "clash", "clash") for x in edges], EDGE), spark.createDataFrame([(*x, 9) for x in nodes], NODE)
    assert {tuple(x) for x in r.orphan_references(e, n).collect()} == want


def test_newest_state_counts_and_repeats_do_not(spark):
    nodes = [(A, 1, "s", None, 0), (A, 2, "s", 9, 0), (A, 3, "s", None, 0)] * 2
    edges = [(A, "t", D, 1, "s", None, 1), (A, "t", D, 2, "s", 8, 1), (A, "u", D, 2, "a", 8, 1), (A, "u", D, 2, "b", None, 1)] * 3
    assert found(spark, edges, nodes) == [(A, "u", D, "dst", "missing", "1970-01")]


def test_nulls_and_empty_tables(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [(None, None, None, None, None)]) == []
    got = found(spark, [(None, None, None, None, None, None, None)], [(None, None, None, None, None)])
    assert [x[3:5] for x in got] == [("dst", "missing"), ("src", "missing")]


def counts(spark, batches):
    """(refs, exists) of each key after batches of (edge rows, node rows), each folded by itself."""
    picture = None
    for edges, nodes in batches:
        e = spark.createDataFrame([(*x, "clash", "clash") for x in edges], EDGE)
        n = spark.createDataFrame([(*x, 9) for x in nodes], NODE)
        picture = r.folded(picture, e, n)
    return {x["key"]: (x["refs"], x["exists"]) for x in picture.counts.collect()}, picture


def test_batches_change_counts_by_what_they_turn(spark):
    live, gone = (A, "t", D, 1, "s", None, 1), (A, "t", D, 2, "s", 8, 1)
    node, dead = (A, 1, "s", None, 0), (A, 2, "s", 9, 0)
    assert counts(spark, [([live], [node]), ([live], [node])])[0] == {A: (1, 1), D: (1, None)}
    assert counts(spark, [([live], [node]), ([gone], [dead])])[0] == {A: (0, 0), D: (0, None)}
    assert counts(spark, [([gone], [dead]), ([live], [node])])[0] == {A: (0, 0)}
    assert counts(spark, [([], [dead]), ([live], [])])[0] == {A: (1, 0), D: (1, None)}


def test_folding_equals_the_whole(spark):
    rng = random.Random(3)
    ids = [f"kiln-{c * 12}" for c in "abcdefgh"]
    edges = [(rng.choice(ids), "t", rng.choice(ids), rng.randrange(20), rng.choice("st"), rng.choice([None, None, 1]), 5) for _ in range(120)]
    nodes = [(rng.choice(ids[:6]), rng.randrange(20), rng.choice("st"), rng.choice([None, None, 1]), rng.choice([0, 9])) for _ in range(40)]
    whole = counts(spark, [(edges, nodes)])
    for seed in (1, 2):
        order = random.Random(seed)
        parts = [([], []) for _ in range(4)]
        for x in edges:
            parts[order.randrange(4)][0].append(x)
        for x in nodes:
            parts[order.randrange(4)][1].append(x)
        got = counts(spark, [*parts, (edges[:5], nodes[:5])])
        assert got[0] == whole[0]
        assert {tuple(x) for x in r.orphans(got[1]).collect()} == {tuple(x) for x in r.orphan_references(*(spark.createDataFrame(y, k) for y, k in (([(*x, "", "") for x in edges], EDGE), ([(*x, 9) for x in nodes], NODE)))).collect()}
        keys = {x["key"]: (x["refs"], x["reason"]) for x in r.orphan_keys(got[1]).collect()}
        assert keys == {k: (n, "missing" if e is None else "deleted") for k, (n, e) in whole[0].items() if n > 0 and not e}


def test_prefix_range():
    for prefix, inside, outside in (("kiln-a", "kiln-azz", "kiln-b"), ("kiln-z", "kiln-zz", "kilo"), ("kiln-az", "kiln-azz", "kiln-b")):
        low, high = prefix_range(prefix)
        assert low <= inside < high and not low <= outside < high
