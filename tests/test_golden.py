"""Small cases with known results."""

from __future__ import annotations

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.versions import compare
from graphloom.operators import attribution as at
from graphloom.operators import code, fusion, graph, intervals, lexical, oplog, texts, vectors
from graphloom.operators import workqueue as wq
from graphloom.sinks import writes
from graphloom.sources import files
from graphloom.streaming import timers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_reciprocal_ranks_and_boost(spark):
    assert one(spark, fusion.rrf(F.lit(1), F.lit(1))) == pytest.approx(2 / 61)
    assert one(spark, fusion.rrf(F.lit(1), F.lit(None))) == pytest.approx(1 / 61 + 1 / 1060)
    row = spark.createDataFrame([(0, 1000, 1)], "priority int, updated_at long, layer int")
    assert row.select(fusion.boost(1000)).first()[0] == pytest.approx(1.625)


def test_quality_and_bounds(spark):
    q = lambda v, c: one(spark, at.quality(F.lit(v), F.array(*map(F.lit, c)).cast("array<string>")))
    assert q("accepted", ["tests_weak"]) == pytest.approx(0.6)
    assert q("rework", ["tests_weak", "tests_weak"]) == pytest.approx(0.1)
    assert q("rejected", []) == 0 and q("odd", []) is None
    assert at.beta_quantile(np.array([4.0]), np.array([1.0]), 0.05)[0] == pytest.approx(0.05**0.25, abs=1e-9)
    assert at.beta_quantile(np.array([4.0]), np.array([1.0]), 0.95)[0] == pytest.approx(0.95**0.25, abs=1e-9)
    assert at.beta_share(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] == pytest.approx(0.5248, abs=1e-4)


def test_ready_score(spark):
    row = spark.createDataFrame([(1, None, 10**12, None, '{"type": "bug"}')], "priority int, unblocks long, updated_at long, anchor double, attrs string")
    assert row.select(wq.ready_score(10**12)).first()[0] == pytest.approx(0.55)


@pytest.mark.parametrize(("n", "ms"), [(0, 1000), (3, 8000), (9, 300_000), (50, 300_000)])
def test_backoff(spark, n, ms):
    assert one(spark, wq.job_backoff(F.lit(n))) == ms == timers.backoff_ms(n)


def test_query_terms():
    terms = lexical.parse('"exact phrase" prefix* Überprüfung of')
    assert [(t.words, t.prefix) for t in terms] == [(("exact", "phrase"), False), (("prefix",), True), (("uberprufung",), False), (("of",), False)]
    assert terms[2].stem() == lexical.Term(("uberpruf",), True) and terms[3].stem() == terms[3]
    assert [lexical.is_anchor_token(t) for t in ("E1042", "a_b", "camelCase", "ENOENT", "abcdefghijkl", "plain")] == [True] * 5 + [False]
    assert lexical.trigger(0, None, "one two") == ["few_results", "short_query_no_anchor"]


def test_quantised(spark):
    v = F.array(F.lit(1.0), F.lit(-0.5), F.lit(0.0039371))
    assert one(spark, vectors.quantised(v)) == [127, -63, 1]
    assert one(spark, vectors.quantised(F.array(F.lit(float("nan"))))) is None
    assert one(spark, vectors.cosine(v, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, vectors.cosine(v, F.array(F.lit(1.0)))) is None


def test_crux_and_packing():
    assert fusion.crux("One. " + "two " * 100, 40).endswith("…") and len(fusion.crux("x" * 500)) <= 300
    assert fusion.crux("A first sentence ends. Then more follows here", 30) == "A first sentence ends."
    assert fusion.crux(None) == ""
    short, long = ("ab", None), ("c" * 50, "c" * 50)
    assert fusion.pack([short, ("d" * 400, "d" * 400), long], 100, 0.0) == [("crux", 3), None, ("full", 51)]
    assert fusion.pack([("x", "x" * 9)], 0) == [None]


def test_texts():
    assert texts.level("  Тот же факт.…") == "тот же факт"
    s = texts.signals("the cache is enabled with 3 rows", "the cache is disabled with 4 rows")
    assert s["flip"] and s["drift"] and not s["update"]
    assert texts.signals("a b", "now a b")["update"] and texts.signals("now a", "now a")["update"] is False
    assert texts.signals("работает", "не работает")["flip"]
    assert texts.jaccard(texts.trigrams("abc"), texts.trigrams("abc")) == 1
    parts = texts.fragments("intro\n# Plan\n- one\n- two\n# Notes\ntext")
    assert [(k, t) for k, _, _, t in parts] == [("section", "intro"), ("plan_item", "one"), ("plan_item", "two"), ("section", "Notes")]
    assert texts.fragments("") == [] and texts.fragments("  \n ") == []
    assert texts.command_parts("a 'x;y' && b | c; ") == ["a 'x;y'", "b", "c"]


def test_intent_and_scope(spark):
    assert one(spark, texts.task_intent(F.lit("Fix the build"))) == "fix"
    assert one(spark, texts.task_intent(F.lit("Обновить зависимости"))) == "config"
    assert one(spark, texts.task_intent(F.lit("zzz"))) == "feature"
    paths = lambda *p: one(spark, texts.task_scope(F.array(*map(F.lit, p)).cast("array<string>")))
    assert [paths(), paths("a/b"), paths("a/b", "a/c"), paths("a/b", "c/d")] == ["unknown", "local", "module", "cross"]
    assert one(spark, texts.paths_in(F.lit("see ./src/a.ts:3 and pkg/b.py, not http://x/y.html"))) == ["pkg/b.py", "src/a.ts"]


def naive_winnow(text):
    h = code.gram_hashes(text).tolist()
    out, w = [], min(4, len(h))
    for s in range(len(h) - w + 1):
        m = max((i for i in range(s, s + w) if h[i] == min(h[s : s + w])), default=s)
        if not out or out[-1] != m:
            out.append(m)
    return out


def test_fingerprints(spark):
    text = "const value = compute(a, b); return value + 1;" * 3
    assert code.winnowed(text)[1].tolist() == naive_winnow(text)
    x = 0x811C9DC5
    for ch in "abcde":
        x = ((x ^ ord(ch)) * 0x01000193) & 0xFFFFFFFF
    x = ((x ^ x >> 16) * 0x85EBCA6B) & 0xFFFFFFFF
    x = ((x ^ x >> 13) * 0xC2B2AE35) & 0xFFFFFFFF
    assert code.gram_hashes("abcde").tolist() == [x ^ x >> 16]
    a, b = code.fingerprint(text), code.fingerprint(text + "more text here")
    assert 0 < code.fingerprint_similarity(a, b) <= 1 and code.fingerprint_similarity(a, a) == 1 and code.fingerprint_similarity(a, a[:0]) == 0
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    assert row.select(code.fingerprint_share(F.col("a"), F.col("b"))).first()[0] == pytest.approx(code.fingerprint_similarity(a, b))


def test_code_streams_and_anchors():
    src = 'x = "a // b"; // note\n/* gone */ call(a, b,\n);'
    assert code.stream(src) == 'x = ""; call(a, b);'
    body = "\n".join(f"line {i} does something with value_{i * 7}" for i in range(30))
    fp = code.fingerprint(code.stream("\n".join(body.split("\n")[9:14])))
    part = "\n".join(body.split("\n")[9:14])
    check = lambda now: code.check_anchor((10, 14), code.hash_text(body), code.hash_text(part), code.stream(part.split("\n")[0]), fp, now)[:3]
    assert check(body) == ("fresh", 10, 14)
    assert check("new first line\n" + body) == ("fresh", 11, 15)
    assert check(None)[0] == "lost"
    assert check("\n".join(["q"] * 40))[0] == "stale"
    assert check("zz\n" + body.replace("line 11 does", "line 11 did"))[0] == "drifted"
    assert code.python_definitions("@d\ndef f():\n  pass\n") == [("f", "def", 1, 3)] and code.python_definitions("def (") == []
    assert code.skeleton("class A {\n  run(a = {b: 1}) {\n  }\n}", [("A", "class", 1, 4), ("run", "def", 2, 3)]) == [(0, "class A"), (1, "run(a = {b: 1})")]


def test_closure_and_paths(spark):
    tree = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", 2)], "ancestor string, descendant string, depth int")
    assert {tuple(r) for r in graph.closure_added(tree, "a", "z").collect()} == {("z", "a", 1), ("z", "b", 2), ("z", "c", 3)}
    assert {tuple(r) for r in graph.closure_removed(tree, "b").collect()} == {("b", "c", 1)}
    assert graph.move_verdict(tree, "a", "c") == "cycle" and graph.move_verdict(tree, "c", "a") == "ok"
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    c = spark.createDataFrame([("c", "a"), ("a", "c")], "src string, dst string")
    assert {(r["src"], r["dst"], r["verdict"], tuple(r["path"] or ())) for r in graph.acyclicity(e, c).collect()} == {("c", "a", "cycle", ("a", "b", "c")), ("a", "c", "clear", ())}


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 5)], "k string, t long")
    right = spark.createDataFrame([("k", 2, 1.0), ("k", 5, 2.0), ("k", 9, 3.0)], "k string, vt long, p double")
    got = {(r["k"], r["t"]): r["asof_p"] for r in intervals.as_of(left, right, "k", "t", "vt", ["p"]).collect()}
    assert got == {("k", 5): 2.0, ("k", 1): None, ("z", 5): None}
    assert {(r["k"], r["t"]): r["asof_p"] for r in intervals.as_of(left, right, "k", "t", "vt", ["p"], fallback=True).collect()} == {("k", 5): 2.0, ("k", 1): 1.0, ("z", 5): None}


def test_versions():
    assert [compare(a, b) for a, b in (("1.2.3", "1.2.10"), ("2.0.0", "2.0.0-rc.1"), ("1.0.0-a.2", "1.0.0-a.10"), ("1.0.0+x", "1.0.0"))] == [-1, 1, -1, 0]


def test_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"role": "user", "text": "hi"}\n\nnot json\n{"type": "assistant", "message": {"role": "assistant", "content": "yes"}}\n')
    rows = files.transcript_turns(spark, str(tmp_path / "t.jsonl")).orderBy("at").collect()
    assert [(r["role"], r["text"], r["json"]) for r in rows] == [("user", "hi", True), ("plain", "not json", False), ("assistant", "yes", True)]
    (tmp_path / "i.jsonl").write_text('{"id": "x-1", "title": "T", "status": "done", "priority": 9, "labels": ["a"], "odd": 1}\n{"title": "no id"}\n')
    r = files.tracker_issues(spark, str(tmp_path / "i.jsonl")).collect()
    assert [(x["id"], x["status"], x["priority"], x["unknown"]) for x in r] == [("x-1", "blocked", 3, ["odd"])]
    (tmp_path / "u.jsonl").write_text('{"message": {"id": "m", "usage": {"input_tokens": 3}}}\n{"message": {"id": "m", "usage": {"input_tokens": 7, "output_tokens": 2}}}\n{bad\n')
    u = at.usage(files.transcript_usage(spark, str(tmp_path / "u.jsonl")), "message_id", ("input_tokens", "output_tokens")).first()
    assert (u["messages"], u["input_tokens"], u["output_tokens"]) == (1, 7, 2)
    repo = tmp_path / "repo"
    for p in ("a/x.py", "node_modules/y.py", "b/.env", "id_rsa"):
        (repo / p).parent.mkdir(parents=True, exist_ok=True)
        (repo / p).write_text("def f(): pass")
    assert [r["path"].rsplit("/", 1)[1] for r in files.repository(spark, str(repo)).collect()] == ["x.py"]


def test_plans_push_down(spark, small):
    plan = spark.read.parquet(f"{small}/edges.parquet").where("type = 'parent'").select("src")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(type), EqualTo(type,parent)]" in plan and "ReadSchema: struct<src:string,type:string>" in plan
    from graphloom.plans import all_queries

    ready = all_queries()["que1_ready"].run(spark, small)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in ready


def test_lease_timers(spark, tmp_path):
    rows = [("t", "a", "claim", 0, 10_000), ("t", "b", "claim", 5_000, 10_000), ("t", "a", "renew", 6_000, 10_000), ("u", "c", "claim", 7_000, 500), ("zz", "c", "claim", 90_000, 500)]
    for i, r in enumerate(rows):
        df = spark.createDataFrame([(*r[:3], 100_000 + r[3], r[4])], "task string, holder string, action string, at long, lease long").withColumn("ts", F.timestamp_millis("at"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        for f in (tmp_path / f"in/{i}").iterdir():
            os.utime(f, (time.time() - 1000 + 10 * i,) * 2)
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*")).withWatermark("ts", "0 seconds")
    q = timers.leases(stream).writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("leases").collect()}
    assert {("t", "a", "claimed"), ("t", "b", "refused"), ("u", "c", "claimed"), ("t", "a", "expired")} <= got


def test_merged_parents_mark_the_closing_link(spark):
    links = spark.createDataFrame([("a", "b", 1, 0, "s"), ("b", "c", 2, 0, "s"), ("c", "a", 3, 0, "s"), ("d", "a", 9, 0, "s"), ("d", "x", 8, 0, "s")], "id string, parent string, ts long, ctr int, site_id string")
    got = {tuple(r) for r in graph.marked_cycles(links).collect()}
    assert got == {("a", "b", False), ("b", "c", False), ("c", "a", True), ("d", "a", False)}


def test_births(spark):
    rows = spark.createDataFrame([("n-1", "task", "T", "odd", None), ("n-2", "note", "U", "active", "b")], "id string, kind string, title string, status string, body string")
    got = {(r["entity_id"], r["field"]): r["value"] for r in writes.birth_ops(rows, "s", 5, "u", "human").collect()}
    assert got["n-1", "status"] == '"open"' and got["n-2", "owner_id"] == '"u"' and ("n-1", "body") not in got and len(got) == 11


def test_log_files_round_trip(spark, small, tmp_path):
    ops = oplog.unique(spark.read.parquet(f"{small}/oplog.parquet"))
    writes.export_log(ops, str(tmp_path / "x"))
    again = files.oplog_lines(spark, str(tmp_path / "x/*/*"))
    cols = ["op_id", "seq", "entity_id", "op", "field", "value"]
    assert {tuple(r) for r in again.select(cols).collect()} == {tuple(r) for r in ops.select(cols).collect()}


def test_rebinding_and_sweep(spark):
    stale = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    cand = spark.createDataFrame([("a", "y.ts", 1, 0.9), ("a", "x.ts", 1, 0.9), ("a", "best.ts", 4, 1.0), ("b", "text.ts", 4, 0.6), ("b", "weak.ts", 2, 0.4)], "node_id string, path string, rank int, similarity double")
    assert [(r["node_id"], r["path"]) for r in code.rebound(stale, cand).collect()] == [("a", "x.ts")]
    checked = spark.createDataFrame([("a", "stale", True), ("b", "stale", True), ("c", "stale", False), ("d", "fresh", True)], "node_id string, state string, seen boolean")
    found = spark.createDataFrame([("a", "x.ts")], "node_id string, found_path string")
    assert {r["node_id"]: r["state"] for r in code.swept(checked, found).collect()} == {"a": "drifted", "b": "lost", "c": "stale", "d": "fresh"}
