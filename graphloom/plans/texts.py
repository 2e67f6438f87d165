"""Queries of texts: similarity, verdicts, classes, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import fusion, texts
from graphloom.operators.current import attribute, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table


def nodes(s: SparkSession, d: str, *c: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes"), *c, deleted=True)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Incoming texts against the node they are about."""
    old = nodes(s, d, "title", "body").select(F.col("id").alias("node"), F.concat_ws("\n", "title", "body").alias("text"))
    p = table(s, d, "absorb_pairs").where("new is not null and new not like '{%'").withColumnRenamed("old", "node")
    return p.join(old, "node").select("pair_id", "label", "node", F.col("text").alias("old"), "new")


def _judged(s: SparkSession, d: str) -> DataFrame:
    f = texts.pair_features(_pairs(s, d), ["pair_id", "label", "node"])
    return f.withColumn("cos", F.lit(None).cast("double")).withColumn("verdict", texts.verdict())


def _confusion(s: SparkSession, d: str) -> DataFrame:
    return _judged(s, d).groupBy("label", "verdict").agg(F.count("*").alias("n"))


def _doc_paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.explode(texts.paths_in(F.col("text"))).alias("path"))


def _intent_sql(title: str, kind: str) -> str:
    words = f"list_transform(regexp_split_to_array(lower({title}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w[1:5])"
    cases = " ".join(
        f"WHEN len(list_filter(w, lambda x: {' OR '.join(f'''starts_with(x, '{p}')''' for p in texts.INTENT_STEMS[i])})) > 0 THEN '{i}'" for i in texts.INTENT_ORDER
    )
    return f"SELECT id, CASE WHEN ty = 'bug' THEN 'fix' {cases} ELSE 'feature' END AS intent FROM (SELECT id, {kind} AS ty, {words} AS w FROM n WHERE kind = 'task')"


_BLANK = r"trim(regexp_replace({}, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{1680}}\x{{2028}}\x{{2029}}\x{{0085}}\x{{FEFF}}]+', ' ', 'g'))"


def _blocks(s: SparkSession, d: str) -> DataFrame:
    """Per scope and title the block of the nearest source: shared ones give way to own ones."""
    n = nodes(s, d, "scope", "kind", "title", "acl").where("kind = 'note'")
    rank = F.when(F.col("acl") == "private", 1).when(F.col("acl") == "agent", 2).otherwise(0)
    return fusion.first_of(n.withColumn("rank", rank), ["scope", "title"], ["rank", "id"]).select("scope", "title", "id")


def _filled(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "scope", "kind", "excerpt").where("kind = 'note'").withColumn("len", F.length(F.coalesce("excerpt", F.lit(""))) + 1)
    return fusion.prefix_filled(n, "scope", "id", F.col("len"), 900).select("scope", "id", "kept", "clipped")


def _active(s: SparkSession, d: str) -> DataFrame:
    return texts.active_tasks(current_nodes(table(s, d, "nodes"), "scope", "kind", "title", "status", "priority", "assignee", "updated_at"), 1).select("scope", "id")


def _signals(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").where("lower(trim(source)) = 'transcript'")
    return texts.transcript_signals(docs, "doc_id", "text", "(?i)(decision:|решение:|entscheidung:)", "(?i)(open question:|вопрос открыт|offen:)")


def _rescue(s: SparkSession, d: str) -> DataFrame:
    """Per transcript what must not be lost: its decisions, open points and files, and the tasks of its scope."""
    docs = table(s, d, "documents").where("lower(trim(source)) = 'transcript'").select("doc_id", "scope")
    n = current_nodes(table(s, d, "nodes"), "scope", "kind", "title", "status", "priority", "assignee", "updated_at")
    tasks = docs.join(texts.active_tasks(n, 3), "scope").select("doc_id", F.lit("ACTIVE").alias("section"), "place", F.col("line").alias("item"))
    label = F.when(F.col("kind") == "decision", "DECIDED").when(F.col("kind") == "open", "OPEN").when(F.col("kind") == "file", "FILES")
    said = _signals(s, d).select("doc_id", label.alias("section"), "place", F.col("norm").alias("item")).where("section is not null")
    steps = docs.select("doc_id", F.lit("NEXT").alias("section"), F.posexplode(F.array(F.concat(F.lit("show "), "doc_id"), F.lit("ready --claim"))).alias("place", "item"))
    return texts.rescue_packets(tasks.unionByName(said).unionByName(steps), "doc_id", 600)


def _listing(s: SparkSession, d: str, newest: bool) -> DataFrame:
    n = table(s, d, "nodes").groupBy("id")
    pick = (F.max_by if newest else F.min_by)("attrs", F.struct("hlc", "site_id"))
    return n.agg(pick.alias("a")).select(F.col("id").alias("path"), F.md5("a").alias("hash"))


QUERIES = {
    "txt1_trigram_similarity": Query(lambda s, d: texts.pair_features(_pairs(s, d), ["pair_id"]).select("pair_id", F.round("jac", 6).alias("jac"))),
    "txt2_signals": Query(lambda s, d: texts.pair_features(_pairs(s, d), ["pair_id"]).select("pair_id", F.round("coverage", 6).alias("coverage"), F.round("growth", 6).alias("growth"), "updates", "flip", "drift")),
    "txt3_verdicts": Query(lambda s, d: _judged(s, d).select("pair_id", "label", "verdict")),
    "txt3_confusion": Query(_confusion),
    "txt5_best_target": Query(lambda s, d: texts.best_target(_judged(s, d), "pair_id", "node")),
    "txt6_applied": Query(lambda s, d: _judged(s, d).where("verdict <> 'new'").select("pair_id", F.col("node").alias("dst"), F.coalesce(*(F.when(F.col("verdict") == v, F.lit(t)) for v, t in (("duplicate", "duplicates"), ("update", "supersedes"), ("contradiction", "contradicts"), ("related", "relates")))).alias("type"))),
    "txt7_canonical": Query(
        lambda s, d: (lambda n: n.groupBy("scope", "kind", "content_hash").agg(F.min(F.struct("created_at", (-F.col("confidence")).alias("c"), "id"))["id"].alias("canonical"), F.count("*").alias("n")).where("n > 1"))(nodes(s, d, "scope", "kind", "content_hash", "created_at", "confidence")),
        q.with_(q.NALL) + "SELECT scope, kind, content_hash, arg_min(id, (created_at, -confidence, id)) AS canonical, count(*) AS n FROM nall GROUP BY 1, 2, 3 HAVING count(*) > 1",
    ),
    "txt9_exact_duplicates": Query(
        lambda s, d: nodes(s, d, "scope", "kind", "title", "body").select("id", texts.content_hash(F.col("kind"), F.col("title"), F.col("body")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"),
        q.with_(q.NALL) + f"SELECT sha256(kind || chr(0) || {_BLANK.format('coalesce(title, \'\')')} || chr(0) || {_BLANK.format('coalesce(body, \'\')')}) AS h, count(*) AS n FROM nall GROUP BY 1 HAVING count(*) > 1",
    ),
    "txt10_fragments": Query(lambda s, d: texts.fragment_rows(table(s, d, "documents"), "doc_id", "text")),
    "txt11_excerpts": Query(
        lambda s, d: nodes(s, d, "body").select("id", texts.excerpt(F.col("body")).alias("excerpt")),
        q.with_(q.NALL) + f"""SELECT id, CASE WHEN length(t) <= 300 THEN t WHEN contains(h, ' ') AND length(h) - instr(reverse(h), ' ') >= 239 THEN rtrim(h[1:length(h) - instr(reverse(h), ' ')]) || '…' ELSE rtrim(h) || '…' END AS excerpt
        FROM (SELECT id, t, t[1:299] AS h FROM (SELECT id, coalesce({_BLANK.format('body')}, '') AS t FROM nall))""",
    ),
    "txt12_transcript_signals": Query(_signals),
    "txt13_intent": Query(
        lambda s, d: nodes(s, d, "kind", "title", "attrs").where("kind = 'task'").select("id", texts.task_intent(F.col("title"), attribute("type")).alias("intent")), q.with_(q.NALL).replace("nall AS", "n AS") + _intent_sql("title", q.attr("type"))
    ),
    "txt13_scope": Query(lambda s, d: nodes(s, d, "kind", "body").where("kind = 'task'").select("id", texts.task_scope(texts.paths_in(F.col("body"))).alias("task_scope"))),
    "txt14_paths": Query(_doc_paths),
    "txt15_identifiers": Query(
        lambda s, d: nodes(s, d, "title").select("id", texts.split_identifier(F.col("title")).alias("words")),
        q.with_(q.NALL) + r"SELECT id, regexp_replace(regexp_replace(regexp_replace(title, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_\-./\\]', ' ', 'g') AS words FROM nall",
    ),
    "txt16_session_keys": Query(
        lambda s, d: table(s, d, "documents").select("doc_id", texts.session_key(F.coalesce("text", F.lit(""))).alias("session")).where("session <> ''"),
        "SELECT doc_id, lower(regexp_extract(text, '(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})', 1)) AS session FROM documents WHERE regexp_matches(text, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')",
    ),
    "txt17_merged_blocks": Query(_blocks, q.with_(q.NALL) + "SELECT scope, title, id FROM (SELECT *, row_number() OVER (PARTITION BY scope, title ORDER BY CASE acl WHEN 'private' THEN 1 WHEN 'agent' THEN 2 ELSE 0 END, id) k FROM nall WHERE kind = 'note') WHERE k = 1"),
    "txt18_filled_blocks": Query(
        _filled,
        q.with_(q.NALL) + """SELECT scope, id, CAST(kept AS BIGINT) AS kept, kept < len AS clipped FROM (SELECT scope, id, len, least(len, 900 - b) AS kept FROM (SELECT scope, id, length(coalesce(excerpt, '')) + 1 AS len,
        coalesce(sum(length(coalesce(excerpt, '')) + 1) OVER (PARTITION BY scope ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM nall WHERE kind = 'note')) WHERE kept > 0 AND (kept = len OR kept >= 48)""",
    ),
    "txt19_rescue_packets": Query(_rescue),
    "txt20_active_task": Query(_active, q.with_(q.N) + "SELECT scope, id FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY list_position(['in_progress', 'blocked', 'open'], status), priority, updated_at DESC, id) k FROM n WHERE kind = 'task' AND status IN ('open', 'blocked', 'in_progress')) WHERE k = 1"),
    "txt21_changed_files": Query(
        lambda s, d: texts.changed_files(_listing(s, d, False), _listing(s, d, True)), "SELECT id AS path, 'changed' AS change FROM (SELECT id, arg_min(attrs, (hlc, site_id)) AS a, arg_max(attrs, (hlc, site_id)) AS b FROM nodes GROUP BY 1) WHERE a <> b"
    ),
}
