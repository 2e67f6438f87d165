from __future__ import annotations

import random

import pytest

from graphloom.operators import intervals, oplog


@pytest.mark.parametrize("cells", [1, 4, 64])
@pytest.mark.parametrize("fallback", [False, True])
def test_as_of_against_brute_force(spark, cells, fallback):
    rng = random.Random(cells)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c"])
    prices = {(key(), rng.randrange(200)): round(rng.random(), 3) for _ in range(60)}
    asks = [(i, key(), rng.randrange(-20, 260)) for i in range(150)] + [(900, "none", 5)]
    left = spark.createDataFrame(asks, "i int, k string, t long")
    right = spark.createDataFrame([(k, t, p) for (k, t), p in prices.items()], "k string, vt long, p double")
    got = {r["i"]: r["asof_p"] for r in intervals.as_of(left, right, "k", "t", "vt", ["p"], fallback, cells).collect()}
    for i, k, t in asks:
        mine = sorted((vt, p) for (kk, vt), p in prices.items() if kk == k)
        past = [p for vt, p in mine if vt <= t]
        assert got[i] == (past[-1] if past else mine[0][1] if fallback and mine else None), (i, k, t)
    assert intervals.as_of(left, right.where("false"), "k", "t", "vt", ["p"]).where("asof_p is not null").count() == 0
    assert intervals.as_of(left.where("false"), right, "k", "t", "vt", ["p"]).count() == 0


def test_spans_against_brute_force(spark):
    rng = random.Random(2)
    spans = [(i, rng.choice("ab"), a, a + rng.randrange(0, 90)) for i, a in enumerate(rng.randrange(300) for _ in range(80))]
    points = [(i, rng.choice("ab"), rng.randrange(400)) for i in range(80)]
    s = spark.createDataFrame(spans, "sid int, k string, a long, b long")
    p = spark.createDataFrame(points, "pid int, k string, x long")
    pairs = {(r["sid"], r["o_sid"]) for r in intervals.overlapping(s, s, "k", "a", "b", 16).collect()}
    assert pairs == {(i, j) for i, k, a, b in spans for j, kk, c, d in spans if k == kk and a <= d and c <= b}
    assert intervals.overlapping(s, s, "k", "a", "b", 16).count() == len(pairs)
    inside = {(r["pid"], r["sid"]) for r in intervals.containing(p, s, "k", "x", "a", "b", 16).collect()}
    assert inside == {(i, j) for i, k, x in points for j, kk, a, b in spans if k == kk and a <= x <= b}
    least = {r["pid"]: r["sid"] for r in intervals.smallest_containing(p, s, "k", "x", "a", "b", 16).collect()}
    for i, k, x in points:
        here = [(b - a, -a, j) for j, kk, a, b in spans if k == kk and a <= x <= b]
        assert (i in least) == bool(here) and (not here or any(least[i] == j and (n, m) == min(here)[:2] for n, m, j in here))


def test_ticks_are_the_sequence(spark):
    rng = random.Random(8)
    walls = [rng.randrange(1, 50) for _ in range(120)]
    rows = [("s", w, f"{i:03d}") for i, w in enumerate(walls)]
    df = spark.createDataFrame(rows, "site string, wall long, op string")
    got = [(r["ts"], r["ctr"]) for r in oplog.ticks(df, "site", "wall", "op").orderBy("wall", "op").collect()]
    assert got == oplog.ticked([(w, None) for w in sorted(walls)])
