"""Golden cases of operators whose result is set by the data's owners, written down apart from the SQL."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.operators import attribution, code, graph, oplog, texts, vectors, workqueue
from graphloom.operators.numbering import numbered
from graphloom.sinks import writes
from graphloom.sources import files


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_tracker_statuses(spark, tmp_path):
    said = ["open", "in_progress", "blocked", "closed", "cancelled", "deferred", "pinned", "done"]
    (tmp_path / "i.jsonl").write_text("".join(f'{{"id": "x-{s}", "title": "T", "status": "{s}"}}\n' for s in said) + '{"id": "x-none", "title": "T"}\n')
    got = {r["id"][2:]: r["status"] for r in files.tracker_issues(spark, str(tmp_path / "i.jsonl")).collect()}
    assert got == {s: s for s in said[:5]} | {s: "blocked" for s in (*said[5:], "none")}


def test_quality_of_caveats(spark):
    df = spark.createDataFrame([(1, "accepted", ["coordinator_fixed", "coordinator_fixed"]), (2, "accepted", ["odd"]), (3, "rework", ["report_inaccurate"]), (4, "accepted", ["tests_weak", "scope_missed", "report_inaccurate"]), (5, "rejected", []), (6, "accepted", None)], "id int, v string, c array<string>")
    got = {r["id"]: round(r["q"], 6) for r in df.select("id", attribution.quality(F.col("v"), F.col("c")).alias("q")).collect()}
    assert got == {1: 0.65, 2: 1.0, 3: 0.25, 4: 0.1, 5: 0.0, 6: 1.0}


def test_decisions(spark):
    arms = [
        ("few", "m", "e", 2, 1.0, 0.1, 0.9, 1.0), ("one", "m", "e", 5, 0.9, 0.5, 0.95, 1.0), ("one", "n", "e", 1, 1.0, 0.2, 0.99, 0.1),
        ("two", "a", "e", 9, 0.9, 0.8, 0.95, 3.0), ("two", "b", "e", 9, 0.7, 0.6, 0.85, 1.0), ("two", "c", "e", 9, 0.2, 0.1, 0.3, 0.1),
        ("free", "a", "e", 9, 0.9, 0.8, 0.95, None), ("free", "b", "e", 9, 0.9, 0.8, 0.95, None), ("clear", "a", "e", 9, 0.9, 0.8, 0.95, 1.0), ("clear", "b", "e", 9, 0.1, 0.0, 0.2, 0.5),
    ]
    df = spark.createDataFrame(arms, "task_class string, model_id string, effort string, n int, mean double, low double, high double, mean_cost double")
    got = {r["task_class"]: tuple(r)[1:] for r in attribution.decisions(df).collect()}
    assert got == {
        "few": ("insufficient_attempts", None, 1, 0, 0, None, False), "one": ("single_arm", "m", 2, 1, 1, None, False), "two": ("ok", "a", 3, 3, 2, "b", True),
        "free": ("no_cost_data", "a", 2, 2, 2, None, False), "clear": ("ok", "a", 2, 2, 1, "a", False),
    }


def test_attempt_states(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, None), (3, None, True), (4, 5, True), (5, None, False), (6, 5, False)], "id int, finished_at long, alive boolean")
    assert {r["id"]: r["state"] for r in workqueue.live_state(df).collect()} == {1: "unknown", 2: "unknown", 3: "working", 4: "orphan", 5: "lost", 6: "done"}


def test_mark_verdicts(spark):
    marks = spark.createDataFrame([("idle", None), ("never", None), ("ok", 100), ("late", 100), ("frozen", 100), ("quiet", 100)], "site_id string, stamp long")
    w = spark.createDataFrame([("never", 1), ("ok", 119), ("ok", 120), ("late", 121), ("late", 130), ("frozen", 121), ("frozen", 131)], "site_id string, ts long")
    got = {r["site_id"]: (r["late"], r["verdict"]) for r in workqueue.mark_verdicts(marks, w, 10).collect()}
    assert got == {"idle": (0, "idle"), "never": (1, "never"), "ok": (0, "ok"), "late": (2, "ok"), "frozen": (2, "frozen"), "quiet": (0, "ok")}


def test_job_stats_count_ready_as_waiting(spark):
    df = spark.createDataFrame([("k", 5, 0, 0), ("k", 0, 200, 0), ("k", 0, 0, 50), ("k", 0, 0, 150)], "kind string, attempts int, lease_expires long, run_after long")
    assert rows(workqueue.job_stats(df, "kind", 100)) == {("k", 4, 1, 1, 2, 1)}


def test_batches_stay_within_bounds(spark):
    schema = "op_id string, site_id string, hlc struct<ts: long, ctr: int>, n int"
    df = spark.createDataFrame([(f"o{i}", "s", (i, 0), n) for i, n in enumerate((40, 50, 20, 5))], schema)
    assert [tuple(r) for r in oplog.next_batch(df, F.col("n"), 10, 100).orderBy("place").collect()] == [("o0", 1, 40, True), ("o1", 2, 90, True)]
    assert [r["op_id"] for r in oplog.next_batch(df, F.col("n"), 3, 1000).collect()] == ["o0", "o1", "o2"]
    assert [tuple(r) for r in oplog.next_batch(df, F.col("n"), 10, 10).collect()] == [("o0", 1, 40, True)]
    assert not any(r["more"] for r in oplog.next_batch(df, F.col("n"), 10, 1000).collect())
    assert oplog.next_batch(df.where("false"), F.col("n")).count() == 0


def test_compactable(spark):
    n = spark.createDataFrame([("a", "task", "closed", 1, None), ("b", "task", "closed", 1, 5), ("c", "note", "superseded", 1, None), ("d", "task", "closed", 1, None), ("e", "task", "closed", 1, None), ("f", "task", "closed", 99, None), ("open", "task", "open", None, None)], "id string, kind string, status string, closed_at long, compacted_at long")
    e = spark.createDataFrame([("open", "blocks", "d"), ("a", "blocks", "e"), ("open", "mentions", "a")], "src string, type string, dst string")
    assert {r["id"] for r in writes.compactable(n, e, 50).collect()} == {"a", "e"}


def test_versions_skip_unknown_ids_and_own_votes(spark):
    schema = "id string, hlc long, site_id string, head_id string"
    n = spark.createDataFrame([("a", 1, "s", "b"), ("b", 2, "s", "b"), ("x", 3, "s", "gone"), ("p", 1, "s", "q"), ("q", 2, "s", "p"), ("m", 1, "s", None), ("n", 1, "s", None), ("o", 0, "s", None)], schema)
    e = spark.createDataFrame([("ghost", "supersedes", "a"), ("b", "supersedes", "lost"), ("m", "supersedes", "o"), ("n", "supersedes", "o")], "src string, type string, dst string")
    assert rows(graph.version_heads(e, n)) == {("a", "b", 1, 1), ("p", "q", 1, 1), ("p", "p", 1, 2), ("m", "n", 0, 1), ("m", "m", 0, 2)}
    assert {(r["id"], r["place"]) for r in graph.version_chains(e, n).collect() if r["chain"] in "am"} == {("a", 0), ("b", 1), ("m", 1), ("n", 2), ("o", 0)}


def test_long_chain_moves_whole(spark):
    e = spark.createDataFrame([(f"n{i:04d}", "blocks", f"n{i + 1:04d}") for i in range(1000)], "src string, type string, dst string")
    n = spark.createDataFrame([("n0000", None)], "id string, head_id string")
    assert graph.move_set(n.select("id"), e, n).count() == 1001


def test_tree_shows_repeats_as_leaves(spark):
    b = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    n = spark.createDataFrame([(x, "open") for x in "abc"], "id string, status string")
    got = {"/".join(r["path"]) for r in graph.dependency_rows(b, spark.createDataFrame([("a",)], "id string"), n).collect()}
    assert got == {"a", "a/b", "a/b/a", "a/b/c"}


def test_search_ends_at_its_bound(spark):
    e = spark.createDataFrame([("hub", f"x{i:03d}") for i in range(40)] + [("x000", "end")], "src string, dst string")
    c = spark.createDataFrame([("end", "hub"), ("other", "hub")], "src string, dst string")
    assert {(r["src"], r["verdict"]) for r in graph.acyclicity(e, c, most=20).collect()} == {("end", "reach"), ("other", "reach")}
    assert {(r["src"], r["verdict"]) for r in graph.acyclicity(e, c, most=500).collect()} == {("end", "cycle"), ("other", "clear")}
    assert {r["verdict"] for r in graph.acyclicity(e, c, depth=1).collect()} == {"depth"}


def test_crux_terms(spark):
    df = spark.createDataFrame([("Return readLedger, readLedger; value of Kürzel and LedgerStore x1",)], "t string")
    assert df.select(code.crux_terms(F.col("t")).alias("c")).first()["c"] == ["LedgerStore", "readLedger", "rzel", "and"]


def test_active_task_and_intent(spark):
    n = spark.createDataFrame([("a", "s", "task", "T", "open", 0, "", 9), ("b", "s", "task", "T", "blocked", 3, "", 1), ("c", "s", "task", "T", "closed", 0, "", 9), ("d", "s", "task", "T", "blocked", 3, "bo", 2)], "id string, scope string, kind string, title string, status string, priority int, assignee string, updated_at long")
    assert [(r["id"], r["line"]) for r in texts.active_tasks(n, 2).orderBy("place").collect()] == [("d", "d P3 T @bo [blocked]"), ("b", "b P3 T [blocked]")]
    t = spark.createDataFrame([("1", "xyzzy", None, ["src/a_test.go"], None), ("2", "xyzzy", None, ["README.md"], None), ("3", "xyzzy", None, ["a.yaml", "Makefile"], None), ("4", "xyzzy", None, ["a.yaml", "a.go"], None), ("5", "fix it", None, [], "docs"), ("6", "xyzzy", "bug", [], "no such"), ("7", "xyzzy", None, [], None)], "id string, t string, k string, p array<string>, d string")
    got = {r["id"]: r["i"] for r in t.select("id", texts.task_intent(F.col("t"), F.col("k"), F.col("p"), F.col("d")).alias("i")).collect()}
    assert got == {"1": "test", "2": "docs", "3": "config", "4": "feature", "5": "docs", "6": "fix", "7": "feature"}


def test_rescue_packet_fills_by_worth(spark):
    items = [("p", "FILES", 1, "x" * 10), ("p", "ACTIVE", 1, "y" * 60), ("p", "ACTIVE", 2, "z" * 5), ("p", "DECIDED", 1, "d" * 20), ("p", "NEXT", 0, "n" * 30)]
    df = spark.createDataFrame(items, "k string, section string, place int, item string")
    got = {(r["section"], r["place"]): r["kept"] for r in texts.rescue_packets(df, "k", 70).collect()}
    assert got == {("DECIDED", 1): True, ("ACTIVE", 1): False, ("ACTIVE", 2): True, ("NEXT", 0): False, ("FILES", 1): True}


def test_transcript_signals(spark):
    text = "Decision: keep k=60\n$ run tests now\nopen question: who?\ndecision:  keep K=60\nsee src/a/b.ts and src/a/b.ts and ./lib/c.py here"
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    got = {(r["kind"], r["place"], r["norm"]) for r in texts.transcript_signals(df, "id", "text", "(?i)decision:", "(?i)open question:").collect()}
    assert got == {("decision", 1, "decision: keep k=60"), ("tool", 1, "$ run tests now"), ("open", 1, "open question: who?"), ("file", 1, "src/a/b.ts"), ("file", 2, "lib/c.py")}


def test_numbering(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as x", "id").repartition(7)
    got = numbered(df, "x").orderBy("x").toPandas()
    assert got["n"].tolist() == list(range(1, 1001)) and numbered(df.where("false"), "x").count() == 0


@pytest.fixture(scope="module")
def vecs(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((300, 8))
    pdf = pd.DataFrame({"vec_id": np.arange(300), "label": [f"l{i % 4}" for i in range(300)], "embedding": [x.tolist() for x in v], "scope": [f"s{i % 3}" for i in range(300)], "layer": np.arange(300) % 4})
    return spark.createDataFrame(pdf, "vec_id long, label string, embedding array<double>, scope string, layer int"), v


def codes(v):
    return np.floor(v / np.abs(v).max(1, keepdims=True) * 127 + 0.5).clip(-127, 127)


def test_neighbours_in_blocks(spark, vecs):
    df, v = vecs
    q = codes(v)
    d = 1 - (q @ q.T) / np.sqrt((q * q).sum(1)[:, None] * (q * q).sum(1)[None])
    want = {(i, j) for i in range(300) for j in sorted(range(300), key=lambda j, i=i: (round(d[i, j], 12), j))[:3]}
    for block in (4096, 70):
        assert {(r["query"], r["id"]) for r in vectors.nearest(df, df, k=3, block=block).collect()} == want
    assert vectors.nearest(df, df.where("false")).count() == 0


def test_scoped_neighbours(spark, vecs):
    df, _ = vecs
    asked = df.where("vec_id < 5")
    got = vectors.nearest_in(df, asked, ["s0", "s2"], (1, 2), k=10).select("id").distinct().collect()
    assert got and all(r["id"] % 3 in (0, 2) and r["id"] % 4 in (1, 2) for r in got)
    for scopes, layers in (([], (0, 1)), (["s0"], (2, 1))):
        with pytest.raises(ValueError):
            vectors.nearest_in(df, asked, scopes, layers)


def test_separation_against_all_pairs(spark, vecs):
    df, v = vecs
    q = codes(v)
    cos = (q @ q.T) / np.sqrt((q * q).sum(1)[:, None] * (q * q).sum(1)[None])
    for block in (4096, 40):
        got = {r["query"]: r for r in vectors.separation(df, df.where("vec_id < 90"), block=block).collect()}
        assert len(got) == 90
        for i in random.Random(1).sample(range(90), 20):
            near = [cos[i, j] for j in range(300) if j % 4 == i % 4 and j != i]
            far = [cos[i, j] for j in range(300) if j % 4 != i % 4]
            assert got[i]["best"] == pytest.approx(max(near)) and got[i]["near"] == pytest.approx(np.mean(near)) and got[i]["far"] == pytest.approx(np.mean(far))
            assert got[i]["better"] == sum(x > max(near) for x in far)


SOURCE = """// Keeps the digest of a ledger.
// One per scope.
import { x } from "y";

/** Sweeps old entries. */
export function sweepLedger(a, b) {
  return a;
}
# counts rows
def countRows(x):
    return x
class Plain {}"""


def test_units_of_a_file():
    assert code.units_of(SOURCE) == [
        (0, "file", "", "sweepLedger countRows Plain", "Keeps the digest of a ledger. One per scope."),
        (6, "function", "sweepLedger", "export function sweepLedger(a, b) { return a; }", "Sweeps old entries."),
        (10, "def", "countRows", "def countRows(x): return x", "counts rows"),
        (12, "class", "Plain", "class Plain {}", ""),
    ]
    assert code.units_of("") == [(0, "file", "", "", "")]


def test_search_folds_units_to_files(spark):
    files = spark.createDataFrame([("a.ts", SOURCE), ("b.ts", "// sweep of the ledger\nconst x = 1"), ("c.ts", "nothing"), ("d.ts", None)], "path string, text string")
    units = code.search_units(files, "path", "text").withColumn("place", F.lit("src"))
    got = {r["path"]: r for r in code.search(units, "path", "sweep-ledger").collect()}
    assert set(got) == {"a.ts", "b.ts"} and got["b.ts"]["units"] == 0 and got["b.ts"]["score"] == got["b.ts"]["header_score"] > 0
    assert got["a.ts"]["units"] == 1 and got["a.ts"]["score"] > got["b.ts"]["score"] and code.search(units, "path", "...").count() == 0


def test_cluster_map_resolves_unique_names(spark):
    files = spark.createDataFrame([(p,) for p in ("a/x/1.ts", "a/x/2.ts", "b/y/3.ts", "top.ts")], "path string")
    defs = spark.createDataFrame([("a/x/1.ts", "one"), ("a/x/2.ts", "both"), ("b/y/3.ts", "both"), ("b/y/3.ts", "three")], "path string, name string")
    refs = spark.createDataFrame([("b/y/3.ts", "one", "import"), ("b/y/3.ts", "one", "import"), ("a/x/2.ts", "one", "import"), ("a/x/1.ts", "one", "import"), ("top.ts", "both", "import"), ("top.ts", "three", "import"), ("top.ts", "three", "call"), ("top.ts", "none", "import")], "path string, name string, kind string")
    assert {(r["state"], r["n"]) for r in code.import_edges(defs, refs).groupBy("state").agg(F.sum("n").alias("n")).collect()} == {("edge", 4), ("own", 1), ("ambiguous", 1)}
    assert rows(code.cluster_map(files, defs, refs)) == {("a/x", 2, 2, "one=3", "b/y=2"), ("b/y", 1, 2, "three=1", ".=1"), (".", 1, 0, "", "")}


def test_rebinding_verifies_its_candidates(spark):
    body = "def compactLedger(rows):\n    total = sum(r.weight for r in rows)\n    return total / len(rows)"
    files = spark.createDataFrame([("old.py", None), ("new.py", "import os\n" + body), ("twin.py", body), ("fake.py", "def compactLedger(other):\n    pass")], "path string, text string")
    gone = spark.createDataFrame([("n", "old.py", "compactLedger", body, 1, 3)], "node_id string, own string, name string, before string, span_start int, span_end int")
    cand = code.rebind_candidates(gone, files, code.definitions(files, "path", "text"), "path", "text")
    got = {r["path"]: (r["rank"], r["similarity"]) for r in cand.collect()}
    assert got["twin.py"] == (0, 1.0) and got["new.py"][0] == 1 and got["new.py"][1] > 0.9 and got["fake.py"][1] < 0.5
    best = code.rebound(gone.select("node_id"), cand.where("path <> 'twin.py'")).collect()
    assert [r["path"] for r in best] == ["new.py"]


def test_jobs_fail_complete_and_join(spark):
    j = spark.createDataFrame([("a", "k", "e", 1, 0, "me", 500, None), ("b", "k", "f", 0, 0, "me", 50, None), ("c", "k", None, 0, 0, "", 0, None)], "id string, kind string, entity_id string, attempts int, run_after long, lease_holder string, lease_expires long, last_error string")
    f = spark.createDataFrame([("a", "me", "boom"), ("b", "other", "x"), ("c", "", "x")], "id string, holder string, error string")
    assert {r["id"]: (r["attempts"], r["run_after"], r["lease_holder"], r["last_error"]) for r in workqueue.failed(j, f, 100).collect()} == {"a": (2, 2100, "", "boom"), "b": (0, 0, "me", None), "c": (0, 0, "", None)}
    assert {r["id"]: (r["attempts"], r["lease_holder"]) for r in workqueue.swept_jobs(j, 100).collect()} == {"a": (1, "me"), "b": (1, ""), "c": (0, "")}
    assert {r["id"] for r in workqueue.completed(j, f).collect()} == {"b", "c"}
    new = spark.createDataFrame([("x", "k", "e"), ("y", "k", "g"), ("z", "k", "g"), ("w", "k", None)], "id string, kind string, entity_id string")
    assert {r["id"] for r in workqueue.enqueued(j.select("id", "kind", "entity_id"), new).collect()} == {"a", "b", "c", "y", "w"}


def test_callers_parser_and_versions(spark):
    from graphloom.functions.versions import release_order
    from graphloom.tools import CodeIndex

    files = spark.createDataFrame([("a.go", "x"), ("b", None)], "path string, text string")
    assert rows(CodeIndex(files, lambda text, lang: [(1, f"{text}-{lang}", "def")]).defs) == {("a.go", 1, "x-go", "def")}
    v = spark.createDataFrame([(x,) for x in ("v1.10.0", "1.9.3+b", "1.9", "v2", "x")], "v string")
    assert [r["v"] for r in v.orderBy(release_order(F.col("v")).asc_nulls_first()).collect()] == ["x", "1.9", "1.9.3+b", "v1.10.0", "v2"]
