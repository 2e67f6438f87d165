"""Cases larger than a bound that once cut the result."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import code, graph, lexical
from graphloom.plans import all_queries

NO_NODES = "id string, head_id string, hlc long, site_id string"


def test_turns_beyond_one_transcripts_bound(spark, tmp_path):
    """Two transcripts of 4,000 lines and 6,000 errors of three users: more than 5,000 turns in all, none in one file."""
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("\n".join(f"line {i}" for i in range(4000))).alias("text"), F.lit(" Transcript").alias("source"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    events = spark.range(6000).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.lit("error").alias("event_type"), F.lit('{"a": 1}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in all_queries()["src12_transcript_turns"].run(spark, str(tmp_path)).collect()] == [(True, 6000)]


def test_move_set_follows_long_chains(spark):
    """A chain of 40 blocks, then one supersession."""
    edges = spark.createDataFrame([(f"t{i:02}", "blocks", f"t{i + 1:02}") for i in range(40)] + [("new", "supersedes", "t40"), ("x", "blocks", "y")], "src string, type string, dst string")
    moved = graph.move_set(spark.createDataFrame([("t00",), ("alone",)], "id string"), edges, spark.createDataFrame([("t40", None, 1, "s"), ("new", None, 2, "s")], NO_NODES))
    got = [r["id"] for r in moved.collect()]
    assert sorted(got) == sorted({f"t{i:02}" for i in range(41)} | {"new", "alone"})
    assert graph.crossing(edges, moved).count() == 0


def first_ready(clock, links):
    """Versions in Kahn's order, the least clock of the ready ones first; what is left follows by clock."""
    left, order = sorted(clock, key=clock.get), []
    while left:
        ready = next((i for i in left if all(o in order for n, o in links if n == i)), None)
        if ready is None:
            return order + left
        order.append(ready)
        left.remove(ready)
    return order


@pytest.mark.parametrize("largest", [10_000, 3])
def test_version_chains_of_any_size_follow_supersession(spark, largest):
    """Late clocks, a fork, a loop with versions after it, and a link to a version without a node, which counts for nothing."""
    clock = {f"v{i}": c for i, c in enumerate([50, 10, 90, 20, 30, 5, 60])} | {"p": 3, "q": 1, "r": 2, "s": 0, "a": 9, "b": 1}
    links = [("v1", "v0"), ("v2", "v1"), ("v3", "v2"), ("v4", "v1"), ("v5", "v4"), ("v6", "v0"), ("p", "q"), ("q", "r"), ("r", "q"), ("s", "p"), ("b", "a"), ("v6", "gone")]
    edges = spark.createDataFrame([(n, "supersedes", o) for n, o in links], "src string, type string, dst string")
    nodes = spark.createDataFrame([(i, None, c, "s") for i, c in clock.items()], NO_NODES)
    got: dict[str, list] = {}
    for r in graph.version_chains(edges, nodes, largest).orderBy("place").collect():
        got.setdefault(r["chain"], []).append((r["place"], r["id"]))
    known = [x for x in links if x[1] in clock]
    for chain, rows in got.items():
        ids = [i for _, i in rows]
        assert [p for p, _ in rows] == list(range(len(rows))), chain
        assert ids == first_ready({i: clock[i] for i in ids}, known), chain
    assert sorted(len(v) for v in got.values()) == [2, 4, 7]


def test_shared_prints_of_all_pairs(spark, tmp_path):
    """Equal texts behind an unrelated first document, and pairs whose least hashes differ."""
    words = [f"name_{i * 7919 % 1000} = call_{i * 31 % 97}(value);" for i in range(60)]
    texts = [" ".join(words[a : a + 3]) for a in (0, 20, 1, 20, 40, 41, 2, 20)] + [None, ""]
    spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, created_at long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["first_id"]): r["share"] for r in all_queries()["cod16_shared_prints"].run(spark, str(tmp_path)).collect()}
    prints = {i: code.fingerprint(code.stream(t)) for i, t in enumerate(texts) if t}
    want = {(3, 1): 1.0, (7, 1): 1.0}
    for a, b in itertools.combinations([i for i in prints if i not in (3, 7)], 2):
        share = code.fingerprint_similarity(prints[a], prints[b])
        if share > 0:
            want[b, a] = round(share, 4)
    assert got == pytest.approx(want, abs=1.1e-4) and len({prints[i][0] for i in (0, 2, 6)}) > 1


@pytest.mark.parametrize("block", [16_384, 7])
def test_most_shared_keeps_every_records_chance(spark, block):
    """Small blocks of records and questions give the rows of comparing all, ties by id, where nearly all records share a term; a key in two rows, terms without records."""
    draw = random.Random(5)
    terms = {f"r{i * 37 % 400:03}": {"all"} | {f"t{int(40 * draw.random() ** 2)}" for _ in range(9)} for i in range(400)}
    asked = {k: {"all", "absent"} | {f"t{draw.randrange(45)}" for _ in range(8)} for k in range(60)} | {None: {"all"}, 99: {"absent"}, 100: {"t1", "t2"}}
    pairs = [(k, t) for k, ts in asked.items() for t in ts] + [(100, "t1")]
    got = lexical.most_shared(spark.createDataFrame(pairs, "key long, term string"), spark.createDataFrame([(i, sorted(t)) for i, t in terms.items()], "id string, terms array<string>"), "key", 24, block, size=64, dense=8)
    want = {(k, i, n, place) for k, ts in asked.items() for place, (n, i) in enumerate(sorted((-len(ts & t), i) for i, t in terms.items() if ts & t)[:24], 1)}
    assert {(r["key"], r["id"], -r["n"], r["place"]) for r in got.collect()} == want
    assert "CartesianProduct" in got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_rebinding_compares_as_one_pair_at_a_time(spark):
    """Spans of several heights, one without words, a copied file, long and short files: each place as by best_window; the best ones are those of all candidates, in one block or more."""
    draw = random.Random(11)

    def source(name, rows):
        return "\n".join([f"def {name}(rows, ledger):", *(f"    {draw.choice(['total', 'weight', 'ledger'])} = rows[{draw.randrange(5)}].{draw.choice(['weight', 'total', 'clock'])}" for _ in range(rows))])

    texts = [(f"f{i:02}", source(f"name{i % 17}", draw.choice([0, 1, 3, 4, 9]))) for i in range(40)] + [("none", None), ("empty", ""), ("few", "x = 1")]
    texts += [("copy", texts[3][1]), ("joined", texts[4][1] + "\n\n" + texts[8][1])]
    gone = [(f"{p}:{h}", p, t.split("(")[0][4:], t, 1, h) for p, t in texts[:9] for h in (1, 4)] + [("few:1", "few", "x", "x = 1", 1, 1)]
    files = spark.createDataFrame(texts, "path string, text string")
    anchors = spark.createDataFrame(gone, "node_id string, own string, name string, before string, span_start int, span_end int")
    defs = code.definitions(files, "path", "text")
    cand = code.rebind_candidates(anchors, files, defs, "path", "text")
    got, known = {(r["node_id"], r["path"]): (r["rank"], r["similarity"]) for r in cand.collect()}, dict(texts)
    assert len(got) > 200 and {r for r, _ in got.values()} == {0, 1, 4} and got["f03:4", "copy"] == (0, 1.0)
    for (node, path), (rank, share) in got.items():
        part = "\n".join(known[node.split(":")[0]].split("\n")[: int(node.split(":")[1])])
        assert share == (1.0 if rank == 0 else code.best_window(known[path], code.fingerprint(code.stream(part)), part.count("\n") + 1)[2]), (node, path)
    want = {tuple(r) for r in code.rebound(anchors.select("node_id"), cand).collect()}
    for block in (20_000, 4):
        best = code.rebind_candidates(anchors, files, defs, "path", "text", best=True, block=block)
        assert {tuple(r) for r in code.rebound(anchors.select("node_id"), best).collect()} == want


def test_sweep_checks_its_anchors_once(spark, small, monkeypatch):
    calls, states = [], code.anchor_states
    monkeypatch.setattr(code, "anchor_states", lambda anchors: calls.append(1) or states(anchors))
    counts = {r["state"]: r["n"] for r in all_queries()["cod25_swept"].run(spark, small).collect()}
    assert calls == [1] and counts == {r["state"]: r["count"] for r in all_queries()["cod18_anchor_states"].run(spark, small).groupBy("state").count().collect()}


@pytest.mark.parametrize("later", [2048, 3])
def test_shared_prints_in_small_blocks(spark, later):
    """Short and full fingerprints over blocks of eight, each pair by comparing two, with no shuffle of pairs."""
    draw = random.Random(3)
    prints = {f"d{i:02}": sorted(draw.sample(range(90), draw.choice([1, 5, 31, 32, 32]))) for i in range(45)} | {"none": []}
    prints |= {"d03": [1 << 31, (1 << 32) - 1], "d04": [7, (1 << 32) - 1], "e-copy": prints["d07"]}
    df = code.shared_prints(spark.createDataFrame(list(prints.items()), "id string, fp array<long>"), "id", digits=4, later=later, local=3)
    want = {("e-copy", "d07"): 1.0}
    for a, b in itertools.combinations([i for i in sorted(prints) if i not in ("none", "e-copy")], 2):
        if (share := code.fingerprint_similarity(np.array(prints[a]), np.array(prints[b]))) > 0:
            want[b, a] = share
    got = {(r["id"], r["first_id"]): r["share"] for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.5001e-4 for k in want) and df.count() == len(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Distinct" not in plan


def test_shared_prints_fill_little_disk(spark, tmp_path):
    """All pairs of texts that share some of 40 hashes, each once, in an order that a file holds in less than 1.6 bytes a row."""
    draw = np.random.default_rng(9)
    has = np.stack([np.isin(np.arange(40), draw.integers(0, 40, 6)) for _ in range(1600)])
    prints = [(7919 * i, [*np.flatnonzero(x).tolist(), *range(1000 + 32 * i, 1032 + 32 * i - int(x.sum()))]) for i, x in enumerate(has)]
    code.shared_prints(spark.createDataFrame(prints, "id long, fp array<long>"), "id", digits=4).write.parquet(str(tmp_path / "pairs"))
    size, got = sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")), spark.read.parquet(str(tmp_path / "pairs"))
    want = (np.triu(has.astype(int) @ has.T, 1) > 0).sum()
    assert got.count() == want == got.select("id", "first_id").distinct().count() and size < 1.6 * want
