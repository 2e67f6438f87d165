"""Queries of scans and round trips through files, functions, and the rest of ranking and code."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.constants import NOW_MS
from graphloom.operators import attribution, code, fusion, graph, lexical, oplog, texts, vectors
from graphloom.operators.current import attribute, current_edges, current_nodes
from graphloom.plans import retrieval as ret
from graphloom.plans import sqltext as q
from graphloom.plans.code import _DEFS, _LINES, _anchors, defs, docs
from graphloom.plans.log import _O
from graphloom.plans.registry import Query
from graphloom.functions.versions import release_order
from graphloom.sinks import writes
from graphloom.sources import files
from graphloom.sources.tables import table
from graphloom.staging import discard_at_exit, shared_root, stage


def nodes(s: SparkSession, d: str, *c: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes"), *c)


def _folder(s: SparkSession) -> str:
    path = f"{shared_root(s)}/graphloom-{s.sparkContext.applicationId}/files-{uuid.uuid4().hex}"
    discard_at_exit(s, path)
    return path


def _exchange(s: SparkSession, d: str) -> DataFrame:
    """The log written as files per site and bucket, and read again."""
    path = _folder(s)
    writes.export_log(oplog.unique(table(s, d, "oplog")), path)
    return files.oplog_lines(s, f"{path}/*/*").groupBy("op").agg(F.count("*").alias("n"), F.max("hlc.ts").alias("last"))


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Transcripts and errors as files, one per document and one per user, so that the format's bound holds for each transcript."""
    path = _folder(s)
    whole = table(s, d, "documents").where("lower(trim(source)) = 'transcript' and text is not null").select((2 * F.col("doc_id")).alias("of"), F.lit(0).cast("long").alias("at"), F.col("text").alias("value"))
    errors = table(s, d, "events").where("event_type = 'error'").select((2 * F.col("user_id") + 1).alias("of"), F.col("event_id").alias("at"), F.to_json(F.struct(F.lit("user").alias("role"), F.col("props").alias("text"))).alias("value"))
    both = whole.unionByName(errors).repartition("of").sortWithinPartitions("of", "at")
    both.select("of", "value").write.partitionBy("of").text(path)
    return files.transcript_turns(s, path).groupBy("json").agg(F.count("*").alias("n")).where("json")


def _usage(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    e = table(s, d, "events").select(F.struct(F.concat(F.lit("m"), F.floor(F.col("event_id") / 3)).alias("id"), F.struct(F.floor("value").cast("long").alias("input_tokens"), F.col("user_id").alias("output_tokens")).alias("usage")).alias("message"))
    e.write.json(path)
    return attribution.usage(files.transcript_usage(s, path), "message_id", ("input_tokens", "output_tokens"))


def _tracker(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    n = nodes(s, d, "kind", "title", "status", "priority").where("kind = 'task'")
    said = F.when(F.length("title") % 5 == 0, "deferred").when(F.length("title") % 5 == 1, "pinned").otherwise(F.col("status"))
    n.select("id", "title", said.alias("status"), (F.col("priority") * 2).alias("priority"), F.lit("task").alias("issue_type")).write.json(path)
    return files.tracker_issues(s, path).groupBy("status", "priority").agg(F.count("*").alias("n"))


def _postings_join(s: SparkSession, d: str) -> DataFrame:
    """Many one-word questions at once: postings joined by term."""
    p = lexical.postings(ret.corpus(s, d).select("id", "title", "body", "tags"))
    terms = s.createDataFrame([(t,) for t in ("digest", "ledger", "snapshot", "quota")], "term string")
    return p.join(F.broadcast(terms), "term").groupBy("term").agg(F.count_distinct("id").alias("records"), F.sum("tf").alias("hits"))


def _cosines(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    first = v.where("vec_id = 0").select(F.col("embedding").alias("e0"))
    return v.crossJoin(F.broadcast(first)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("e0")), 6).alias("cos"))


def _graph_scores(s: SparkSession, d: str) -> DataFrame:
    c, fused, pool = ret._fused(s, d)
    h1, _ = ret._hops(s, d, pool)
    new = h1.join(c.select("id"), "id", "left_semi").join(fused.select("id"), "id", "left_anti").withColumn("anchor_weight", F.lit(1.0))
    return fusion.graph_score(new, fused, 1).select("id", "via", F.round("score", 9).alias("score"))


_GRAPH = (
    q.with_(q.N, q.E, ret._CORPUS, *ret._bm25(), ret._POOL, *ret._VEC, *ret._HOPS)
    + f"SELECT h.id, h.via, round(f.score * 0.5::DOUBLE * h.weight * {ret._TYPE_W}, 9) AS score FROM h1 h JOIN fu f ON f.id = h.via WHERE h.id IN (SELECT id FROM c) AND h.id NOT IN (SELECT id FROM fu)"
)


def _vector_only(s: SparkSession, d: str) -> DataFrame:
    return ret._vector_ranks(s, d, ret.corpus(s, d).select("id"))


def _mapped(df: DataFrame, column: str, out: str, fn) -> DataFrame:
    """The first column and a text column made from another in Arrow batches."""
    key = df.columns[0]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], out: [fn(t) if isinstance(t, str) else None for t in b[column]]})

    return df.mapInPandas(run, f"`{key}` {kind}, {out} string")


def _ticks(s: SparkSession, d: str) -> DataFrame:
    """Each site's last clock and greatest counter if it ticked at the arrivals of its own operations."""
    o = oplog.unique(table(s, d, "oplog")).select("site_id", F.unix_millis(F.col("arrived_at").cast("timestamp")).alias("wall"), "op_id")
    return oplog.ticks(o, "site_id", "wall", "op_id").groupBy("site_id").agg(F.max("ts").alias("last"), F.max("ctr").alias("top"))


def _merge_parents(s: SparkSession, d: str) -> DataFrame:
    """Added relates edges taken for parent links, as the feed has no loop of parents."""
    o = table(s, d, "oplog").where("op = 'edge_add' and field = 'relates'")
    links = o.select(F.substring_index("entity_id", "|", 1).alias("id"), F.substring_index("entity_id", "|", -1).alias("parent"), F.col("hlc.ts").alias("ts"), F.col("hlc.ctr").alias("ctr"), "site_id")
    return graph.marked_cycles(links)


_PARENTS = """WITH RECURSIVE o AS (SELECT split_part(entity_id, '|', 1) AS id, split_part(entity_id, '|', 3) AS parent, hlc.ts AS ts, hlc.ctr AS ctr, site_id FROM oplog WHERE op = 'edge_add' AND field = 'relates'),
k AS (SELECT id, parent, (ts, ctr, site_id) AS clock FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, ctr DESC, site_id DESC, parent DESC) rn FROM o) WHERE rn = 1),
w AS (SELECT id AS start, parent AS place, [id] AS seen FROM k UNION ALL SELECT w.start, k.parent, list_append(w.seen, k.id) FROM w JOIN k ON k.id = w.place WHERE NOT list_contains(w.seen, w.place)),
c AS (SELECT start AS id, list_min(seen) AS loop FROM w WHERE place = start),
l AS (SELECT id FROM (SELECT c.id, row_number() OVER (PARTITION BY loop ORDER BY k.clock DESC, c.id DESC) rn FROM c JOIN k ON k.id = c.id) WHERE rn = 1)
SELECT id, parent, id IN (SELECT id FROM l) AS cycle FROM k"""


def _births(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "kind", "scope", "title", "body", "status", "priority").where("kind in ('note', 'skill')")
    return writes.birth_ops(n.withColumn("status", F.when(F.length("title") % 2 == 0, "odd").otherwise(F.col("status"))), "local", NOW_MS, "u-007", "human").groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("value") == '"active"').alias("active"))


_BIRTHS = q.with_(q.N) + """, b AS (SELECT *, CASE WHEN length(title) % 2 = 0 OR status NOT IN ('active', 'superseded', 'retracted') THEN 'active' ELSE status END AS st FROM n WHERE kind IN ('note', 'skill'))
SELECT field, count(*) AS n, count(*) FILTER (value = 'active') AS active FROM (
 SELECT unnest(['kind', 'scope', 'title', 'body', 'status', 'priority', 'owner_id', 'actor']) AS field, unnest([kind, scope, title, body, st, CAST(priority AS VARCHAR), 'u-007', 'human']) AS value FROM b) WHERE value IS NOT NULL GROUP BY 1"""


def _candidates(s: SparkSession, d: str) -> DataFrame:
    """Per incoming text up to 24 records that share most of its twelve longest words."""
    new = table(s, d, "absorb_pairs").where("new is not null and new not like '{%'")
    words = F.array_sort(F.transform(F.array_distinct(lexical.tokens(F.col("new"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    asked = new.select("pair_id", F.explode(F.slice(words, 1, 12)).alias("x")).select("pair_id", F.col("x.w").alias("term"))
    records = nodes(s, d, "title", "body").select("id", F.array_distinct(F.concat(lexical.tokens(F.col("title")), lexical.tokens(F.col("body")))).alias("terms"))
    return lexical.most_shared(asked, records, "pair_id")


_CAND = q.with_(q.N) + f""", a AS (SELECT DISTINCT pair_id, unnest(list_transform(list_sort(list_transform(list_distinct({ret._tok('new')}), lambda w: {{'n': -length(w), 'w': w}}))[1:12], lambda x: x.w)) AS term FROM absorb_pairs WHERE new IS NOT NULL AND new NOT LIKE '{{%'),
p AS (SELECT DISTINCT id, unnest({ret._tok('title')} || {ret._tok('body')}) AS term FROM n)
SELECT pair_id, id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, id) AS place FROM (SELECT pair_id, id, count(*) AS n FROM a JOIN p USING (term) GROUP BY ALL)) WHERE place <= 24"""


def _commands(s: SparkSession, d: str) -> DataFrame:
    lines = code.lines(docs(s, d), "doc_id", "text").where("content like '$ %'").select("doc_id", F.expr("substring(content, 3)").alias("content"))
    first = _mapped(lines, "content", "commands", lambda t: "\n".join(p.split()[0] for p in texts.command_parts(t)))
    return first.select(F.explode(F.split("commands", "\n")).alias("command")).groupBy("command").agg(F.count("*").alias("n"))


def _rebound(s: SparkSession, d: str, checked: DataFrame | None = None) -> DataFrame:
    """Anchors that no longer hold, looked for in all other files by text, name and words, each place verified."""
    if checked is None:
        checked = stage(code.anchor_states(_anchors(s, d)), "checked")
    named = defs(s, d).select(F.concat_ws(":", "doc_id", "line").alias("node_id"), F.col("doc_id").alias("own"), "name")
    gone = _anchors(s, d).join(checked.where("state in ('stale', 'lost')").select("node_id"), "node_id").join(named, "node_id")
    cand = code.rebind_candidates(gone, docs(s, d), defs(s, d), "doc_id", "text", best=True)
    return code.rebound(gone.select("node_id"), cand).select("node_id", "path", "rank", F.round("similarity", 4).alias("similarity"))


def _swept(s: SparkSession, d: str) -> DataFrame:
    checked = stage(code.anchor_states(_anchors(s, d)), "checked")
    return code.swept(checked.withColumn("seen", F.substring_index("node_id", ":", 1).cast("long") % 2 == 0), _rebound(s, d, checked).select("node_id", F.col("path").alias("found_path"))).groupBy("state").agg(F.count("*").alias("n"))


def _masks(t: str) -> str:
    m = code.mask(t)
    return f"{int((m == 0).sum())}/{int((m == 1).sum())}/{int((m == 2).sum())}"


def _windows(s: SparkSession, d: str) -> DataFrame:
    """Where the four lines from each definition lie in the later text of their file."""
    kinds = "node_id string, first int, last int, share double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                part = r.before.split("\n")[r.span_start - 1 : r.span_end]
                rows.append((r.node_id, *code.best_window(r.now, code.fingerprint(code.stream("\n".join(part))), len(part))))
            yield pd.DataFrame(rows, columns=["node_id", "first", "last", "share"])

    return _anchors(s, d).where("now is not null").mapInPandas(run, kinds)


def _registered(s: SparkSession, d: str) -> DataFrame:
    s.udf.register("crux_of", F.pandas_udf(lambda t: t.map(lambda x: fusion.crux(x, 80)), "string"))
    return s.sql("SELECT id, crux_of(title) AS crux FROM {n}", n=nodes(s, d, "title"))


_ids = q.with_(q.N)
QUERIES = {
    "src1_scan": Query(lambda s, d: table(s, d, "nodes").groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM nodes GROUP BY 1"),
    "src2_tenant": Query(lambda s, d: nodes(s, d, "team_id").where("team_id = 'team-harbor'").select("id"), _ids + "SELECT id FROM n WHERE team_id = 'team-harbor'"),
    "src11_exchange_files": Query(_exchange, q.with_(_O) + "SELECT op, count(*) AS n, max(ts) AS last FROM o GROUP BY 1"),
    "src12_transcript_turns": Query(_turns),
    "src13_transcript_usage": Query(_usage, "SELECT count(*) AS messages, 0::BIGINT AS broken, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens FROM (SELECT max(CAST(floor(value) AS BIGINT)) AS i, max(user_id) AS o FROM events GROUP BY event_id // 3)"),
    "src14_tracker": Query(_tracker, _ids + "SELECT CASE WHEN length(title) % 5 < 2 THEN 'blocked' ELSE status END AS status, least(3, greatest(0, priority * 2)) AS priority, count(*) AS n FROM n WHERE kind = 'task' GROUP BY 1, 2"),
    "jn19_postings_join": Query(
        _postings_join, q.with_(q.N, ret._CORPUS) + f"SELECT term, count(DISTINCT id) AS records, count(*) AS hits FROM (SELECT id, unnest({' || '.join(ret._tok(f) for f in lexical.WEIGHTS)}) AS term FROM c) WHERE term IN ('digest', 'ledger', 'snapshot', 'quota') GROUP BY 1"
    ),
    "jn21_full_outer": Query(
        lambda s, d: nodes(s, d, "kind").join(table(s, d, "oplog").select(F.col("entity_id").alias("id")).distinct().withColumn("logged", F.lit(True)), "id", "full").groupBy(F.col("kind").isNull().alias("unknown"), F.col("logged").isNull().alias("silent")).agg(F.count("*").alias("n")),
        _ids + "SELECT kind IS NULL AS unknown, logged IS NULL AS silent, count(*) AS n FROM n FULL JOIN (SELECT DISTINCT entity_id AS id, true AS logged FROM oplog) USING (id) GROUP BY ALL",
    ),
    "ret3_parsed": Query(
        lambda s, d: s.createDataFrame([(" ".join(t.words), t.prefix) for t in lexical.parse('"ledger fence" quot* drift')], "term string, prefix boolean"), "SELECT * FROM (VALUES ('ledger fence', false), ('quot', true), ('drift', false)) t(term, prefix)"
    ),
    "ret11_cosines": Query(_cosines, f"SELECT b.vec_id, round({ret._DOT.format(a='a.embedding', b='b.embedding')} / sqrt({ret._DOT.format(a='a.embedding', b='a.embedding')} * {ret._DOT.format(a='b.embedding', b='b.embedding')}), 6) AS cos FROM embeddings a, embeddings b WHERE a.vec_id = 0"),
    "ret18_hop_by_type": Query(
        lambda s, d: ret._hops(s, d, stage(ret._pool(s, d).select("id", "rank"), "pool"))[0].groupBy("type").agg(F.count("*").alias("n")), q.with_(q.N, q.E, ret._CORPUS, *ret._bm25(), ret._POOL, *ret._HOPS) + "SELECT type, count(*) AS n FROM h1 GROUP BY 1"
    ),
    "ret25_graph_scores": Query(_graph_scores, _GRAPH),
    "ret32_vector_only": Query(_vector_only, q.with_(*ret._BASE, *ret._VEC[:3]) + "SELECT id, vec_rank FROM vr"),
    "ret37_cruxes": Query(lambda s, d: _mapped(nodes(s, d, "body").select("id", "body"), "body", "crux", fusion.crux)),
    "log8_ticks": Query(
        _ticks, "SELECT site_id, max(wall) AS last, max(c) - 1 AS top FROM (SELECT site_id, wall, count(*) AS c FROM (SELECT op_id, any_value(site_id) AS site_id, min(epoch_us(arrived_at) // 1000) AS wall FROM oplog GROUP BY 1) GROUP BY 1, 2) GROUP BY 1"
    ),
    "log14_merged_parents": Query(_merge_parents, _PARENTS),
    "log19_birth_operations": Query(_births, _BIRTHS),
    "txt4_candidates": Query(_candidates, _CAND),
    "txt8_absorb_edges": Query(
        lambda s, d: table(s, d, "absorb_pairs").where("label <> 'new'").select(F.concat(F.lit("pair:"), "pair_id").alias("src"), F.col("old").alias("dst"), F.explode(F.when(F.col("label") == "update", F.array(F.lit("supersedes"), F.lit("derived_from"))).when(F.col("label") == "duplicate", F.array(F.lit("duplicates"))).when(F.col("label") == "contradiction", F.array(F.lit("contradicts"))).otherwise(F.array(F.lit("relates")))).alias("type")),
        "SELECT 'pair:' || pair_id AS src, old AS dst, unnest(CASE label WHEN 'update' THEN ['supersedes', 'derived_from'] WHEN 'duplicate' THEN ['duplicates'] WHEN 'contradiction' THEN ['contradicts'] ELSE ['relates'] END) AS type FROM absorb_pairs WHERE label <> 'new'",
    ),
    "txt22_commands": Query(_commands, q.with_(_LINES) + "SELECT split_part(content[3:], ' ', 1) AS command, count(*) AS n FROM ln WHERE content LIKE '$ %' GROUP BY 1"),
    "cod13_signatures": Query(
        lambda s, d: defs(s, d).join(code.lines(docs(s, d), "doc_id", "text"), ["doc_id", "line"]).select("doc_id", "line", F.rtrim(F.regexp_extract("content", r"^([^{;]*)", 1)).alias("signature")),
        q.with_(_LINES, _DEFS) + "SELECT df.doc_id, df.line, rtrim(regexp_extract(content, '^([^{;]*)', 1)) AS signature FROM df JOIN ln ON ln.doc_id = df.doc_id AND ln.line = df.line",
    ),
    "cod14_streams": Query(lambda s, d: _mapped(docs(s, d), "text", "stream", code.stream)),
    "cod17_best_windows": Query(_windows),
    "cod19_rebound": Query(_rebound),
    "cod24_masks": Query(lambda s, d: _mapped(docs(s, d), "text", "counts", _masks)),
    "cod25_swept": Query(_swept),
    "fn1_json": Query(
        lambda s, d: nodes(s, d, "attrs").select("id", attribute("type").alias("type"), F.array_join(F.array_sort(F.json_object_keys("attrs")), ",").alias("keys")), _ids + f"SELECT id, {q.attr('type')} AS type, array_to_string(list_sort(json_keys(attrs)), ',') AS keys FROM n"
    ),
    "fn2_null_logic": Query(
        lambda s, d: nodes(s, d, "head_id", "assignee", "priority").select("id", F.coalesce("head_id", "id").alias("head"), F.col("head_id").eqNullSafe(F.col("id")).alias("own"), F.greatest("priority", F.lit(1)).alias("at_least")),
        _ids + "SELECT id, coalesce(head_id, id) AS head, head_id IS NOT DISTINCT FROM id AS own, greatest(priority, 1) AS at_least FROM n",
    ),
    "fn3_rounded": Query(lambda s, d: nodes(s, d, "salience").select("id", F.round(F.col("salience") * 0.27, 2).alias("r")), _ids + "SELECT id, round(salience * 0.27::DOUBLE, 2) AS r FROM n"),
    "fn4_strings": Query(
        lambda s, d: nodes(s, d, "title").select("id", F.substring("title", 3, 5).alias("part"), F.instr("title", "e").alias("at"), F.length("title").alias("n")), _ids + "SELECT id, substr(title, 3, 5) AS part, instr(title, 'e') AS at, length(title) AS n FROM n".replace(" AS at,", ' AS "at",')
    ),
    "fn5_ages": Query(lambda s, d: nodes(s, d, "created_at").select("id", F.floor((F.lit(NOW_MS) - F.col("created_at")) / 86_400_000).alias("days")), _ids + f"SELECT id, ({NOW_MS} - created_at) // 86400000 AS days FROM n"),
    "fn7_arrays": Query(
        lambda s, d: nodes(s, d, "title").select("id", F.array_join(F.slice(F.array_sort(F.array_distinct(F.split(F.lower("title"), " "))), 1, 3), "|").alias("words")), _ids + "SELECT id, array_to_string(list_sort(list_distinct(string_split(lower(title), ' ')))[1:3], '|') AS words FROM n"
    ),
    "fn10_versions": Query(
        lambda s, d: docs(s, d).select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(v\d+\.\d+\.\d+)"), F.lit(1))).alias("v")).groupBy("v").agg(F.count("*").alias("n")).withColumn("place", F.rank().over(Window.orderBy(F.desc(release_order(F.col("v")))))).where("place <= 50").select("v", "n", "place"),
        r"SELECT v, n, place FROM (SELECT v, n, CAST(rank() OVER (ORDER BY list_transform(string_split(v[2:], '.'), lambda x: x::INT) DESC) AS INTEGER) AS place FROM (SELECT v, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'v\d+\.\d+\.\d+')) AS v FROM documents) GROUP BY 1)) WHERE place <= 50",
    ),
    "fn11_maps": Query(
        lambda s, d: nodes(s, d, "attrs").select("id", F.from_json("attrs", "map<string,string>").alias("m")).select(
            "id", F.size("m").alias("n"), F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda k, v: F.length(k) > 4))), ",").alias("long_keys"), F.map_contains_key("m", "type").alias("typed"), F.try_element_at("m", F.lit("type")).alias("type")
        ),
        _ids + f"SELECT id, CAST(len(json_keys(attrs)) AS INTEGER) AS n, array_to_string(list_sort(list_filter(json_keys(attrs), lambda k: length(k) > 4)), ',') AS long_keys, list_contains(json_keys(attrs), 'type') AS typed, {q.attr('type')} AS type FROM n",
    ),
    "fn8_math": Query(lambda s, d: nodes(s, d, "salience").select("id", F.round(F.exp(-F.col("salience")), 6).alias("e"), F.round(F.sqrt("salience"), 6).alias("r")), _ids + "SELECT id, round(exp(-salience), 6) AS e, round(sqrt(salience), 6) AS r FROM n"),
    "str7_due_retries": Query(
        lambda s, d: table(s, d, "events").where("event_type = 'error'").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).select("event_id", F.least(F.lit(300_000), 1000 * F.pow(F.lit(2.0), F.least("k", F.lit(20)))).cast("long").alias("wait")),
        "SELECT event_id, CAST(least(300000, 1000 * pow(2, least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1, 20))) AS BIGINT) AS wait FROM events WHERE event_type = 'error'",
    ),
    "udf8_registered": Query(_registered),
}
