from __future__ import annotations

import random

import numpy as np
import pytest

from graphloom.llm import near_duplicates as nd

REC = "key string, text string, hlc long, site_id string, rid string, bucket string"


def texts(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzжшщ") for _ in range(rng.randrange(3, 10))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(25, 90))) for _ in range(n)]
    out = list(base)
    for b in base[: n // 2]:
        for _ in range(rng.randrange(1, 4)):
            w = b.split(" ")
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(w))
                w[at] = rng.choice([w[at].upper(), rng.choice(words), w[at] + "x", ""])
            if rng.random() < 0.3:
                cut = rng.randrange(len(w))
                w = w[cut:] + w[:cut]
            out.append(" ".join(w) + rng.choice(["", "...", " ! "]))
    return out


def brute(rows):
    norm = [(k, nd.normalised(t)) for k, t in rows]
    return {tuple(sorted((a, b))) for i, (a, x) in enumerate(norm) for b, y in norm[:i] if nd.similarity(x, y) >= 0.7}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{i:04d}", t) for i, t in enumerate(texts(rng, 160))]
    df = spark.createDataFrame([(k, t, 1, "s", "clash", "clash") for k, t in rows * 2], REC)
    got = [tuple(r) for r in nd.similar_pairs(df).collect()]
    want = brute(rows)
    clear = {p for p in want if nd.similarity(*(nd.normalised(dict(rows)[k]) for k in p)) >= 0.76}
    assert len(got) == len(set(got)) and set(got) <= want and clear <= set(got)
    groups = {r["key"]: r["group_key"] for r in nd.similar_groups(df).collect()}
    assert set(groups) == {k for k, _ in rows} and all(groups[a] == groups[b] for a, b in got)


def test_hot_copies_short_long_and_empty(spark):
    long = " ".join(f"word{i}" for i in range(20_000))
    rows = [(f"c{i:02d}", "the same text in many rows, with care") for i in range(30)] + [("e1", ""), ("e2", " . "), ("s1", "ab"), ("s2", "AB!"), ("l1", long), ("l2", long + " tail")]
    df = spark.createDataFrame([(k, t, 1, "s", "", "") for k, t in rows], REC)
    got = {tuple(r) for r in nd.similar_pairs(df).collect()}
    assert got == {(f"c{a:02d}", f"c{b:02d}") for b in range(30) for a in range(b)} | {("s1", "s2"), ("l1", "l2")}
    assert nd.similar_pairs(df.where("false")).count() == 0


def test_newest_text_counts(spark):
    a, b = "a text that is told in one way only", "something else entirely, of other words"
    df = spark.createDataFrame([("x", a, 1, "s", "", ""), ("x", b, 2, "s", "", ""), ("y", a, 1, "s", "", ""), ("z", b, 1, "s", "", "")], REC)
    assert {tuple(r) for r in nd.similar_pairs(df).collect()} == {("x", "z")}


def test_records_of_tables(spark):
    nodes = spark.createDataFrame([("n1", None, "b", None, None), ("n2", "t", None, 1, "s"), (None, "t", "b", 1, "s")], "id string, title string, body string, hlc long, site_id string")
    assert [tuple(r) for r in nd.node_records(nodes).collect()] == [("n1", "\nb", 0, "")]
    pairs = spark.createDataFrame([(1, '{"node": "x"}'), (2, '{"other": 1}'), (3, None), (None, "t"), (4, "text")], "pair_id long, new string")
    assert [r["key"] for r in nd.pair_records(pairs).orderBy("key").collect()] == ["pair:2", "pair:4"]


def test_allocation_is_least_cost():
    """Against all ways to set the thresholds."""
    from itertools import product

    rng = np.random.default_rng(0)
    gains, seen = np.array([0.14, 0.64]), set()
    for _ in range(20):
        costs = rng.integers(1, 100, (6, 2)).astype(float)
        need = 1.5
        t = nd.allocate(costs, gains, need)
        parts = np.floor(gains / need * 1000)

        def value(ways, costs=costs, parts=parts):
            return sum(costs[i, x] for i, x in enumerate(ways) if x >= 0), sum(parts[x] for x in ways if x >= 0)

        best = min(value(w)[0] for w in product((-1, 0, 1), repeat=6) if value(w)[1] >= 1000)
        assert value(t)[0] == best and value(t)[1] >= 1000
        seen |= set(t.tolist())
    assert seen == {-1, 0, 1}
    with pytest.raises(ValueError):
        nd.allocate(np.ones((2, 2)), gains, 5.0)


def test_grouping_follows_association():
    a = np.full((6, 6), 0.01)
    for i, j in ((0, 4), (1, 3), (2, 5)):
        a[i, j] = a[j, i] = 0.9
    assert sorted(nd.grouped(a, 2).tolist()) == [[0, 4], [1, 3], [2, 5]]


def test_association_and_estimates(spark):
    """The measured association is that of the codes, and estimated candidates are near the true number."""
    rng = np.random.default_rng(3)
    layout = nd.Layout(4, 12)
    codes = rng.integers(0, 2**16, (3000, layout.coordinates)).astype(np.uint16)
    codes[:, 7] = codes[:, 2]
    codes[:900, 20:24] = codes[0, 20:24]
    single = spark.createDataFrame([(i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "rid long, code binary")
    a = nd.association(single, layout.coordinates)
    assert a[2, 7] > 0.99 and a[2, 8] < 0.01
    plan = nd.make_plan(single, layout, miss=0.05)
    assert any({2, 7} <= set(g) for g in plan.groups.tolist())
    for i, g in enumerate(plan.groups):
        _, n = np.unique(codes[:, g], axis=0, return_counts=True)
        true = (n * (n - 1) // 2).sum()
        assert abs(plan.estimated[i, 0] - true) <= 0.15 * true + 3000, (i, true, plan.estimated[i])


@pytest.mark.parametrize("layout", [nd.Layout(4, 18), nd.Layout(5, 26), nd.Layout(6, 36)])
def test_every_width_finds_the_pairs(spark, layout, monkeypatch):
    rng = random.Random(5)
    rows = [(f"k{i:04d}", t) for i, t in enumerate(texts(rng, 120))]
    df = spark.createDataFrame([(k, t, 1, "s", "", "") for k, t in rows], REC)
    forms = list(dict.fromkeys(nd.normalised(t) for _, t in rows))
    clear = {tuple(sorted((nd._rid(x), nd._rid(y)))) for i, x in enumerate(forms) for y in forms[:i] if nd.similarity(x, y) >= 0.76}
    by = {nd._rid(x): x for x in forms}
    got = {(r["a"], r["b"]) for r in nd.similar_texts(df, layout=layout)[0].collect()}
    assert all(nd.similarity(by[a], by[b]) >= 0.7 for a, b in got) and len(clear) > 50 and len(clear - got) <= 0.01 * len(clear)


def test_hot_cells_lose_no_pair(spark, monkeypatch):
    """With every cell taken as hot, pairs are found by the extended keys."""
    rng = random.Random(8)
    rows = [(f"k{i:04d}", t) for i, t in enumerate(texts(rng, 60))]
    df = spark.createDataFrame([(k, t, 1, "s", "", "") for k, t in rows], REC)
    want = {tuple(r) for r in nd.similar_pairs(df).collect()}
    monkeypatch.setattr(nd, "_HOT", 0)
    monkeypatch.setattr(nd, "_TIMES", 0)
    assert {tuple(r) for r in nd.similar_pairs(df).collect()} == want


def test_normal_form():
    assert nd.normalised("  Тот　же﻿ФАКТ.… ") == " тот же факт "
    assert nd.normalised("ﬁ ４２") == " fi 42 "
    x, y = " the quick 🚧 brown ж ", " the quick 🚧 browm ж "
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (x, y)]
    assert nd.similarity(x, y) == len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert nd.similarity(" abc ", " abc ") == 1 and nd.similarity("  ", "  ") == 0
