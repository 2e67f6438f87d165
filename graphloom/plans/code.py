"""Queries of source text; documents stand for files, their code and paths for code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import code, graph, intervals, lexical
from graphloom.operators.current import current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table
from graphloom.staging import stage


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "source", "created_at")


def defs(s: SparkSession, d: str) -> DataFrame:
    return code.definitions(docs(s, d), "doc_id", "text")


def calling(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(files, definitions): the documents with definitions, each with calls of definitions of others added, as the texts have next to none."""
    found = stage(defs(s, d), "defs")
    n = max(1, found.count())
    called = found.select(F.pmod(F.hash("name", "doc_id", "line"), F.lit(n)).alias("slot"), F.concat(F.lit("  "), "name", F.lit("(x)")).alias("call"))
    slots = found.select("doc_id").distinct().withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.pmod(F.hash("doc_id", k), F.lit(n)))))
    more = slots.join(called, "slot").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("call")), "\n").alias("calls"))
    files = docs(s, d).join(found.select("doc_id").distinct(), "doc_id").join(more, "doc_id", "left")
    return files.withColumn("text", F.concat_ws("\n", "text", "calls")).drop("calls"), found


_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL)"
_DEF = code.DEFINITION.replace("'", "''")
_DEFS = f"df AS (SELECT doc_id, CAST(line AS INTEGER) AS line, regexp_extract(content, '{_DEF}', 2) AS name, regexp_extract(content, '{_DEF}', 1) AS kind FROM ln WHERE regexp_matches(content, '{_DEF}'))"
_PATH = r"packages/[a-z]+/src/[a-z-]+\.[a-z]+"


def _uses(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select(F.col("doc_id").alias("user"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({_PATH})"), F.lit(1))).alias("path"))


_USES = f"us AS (SELECT doc_id AS user, unnest(regexp_extract_all(text, '{_PATH}')) AS path FROM documents)"


def _listing(s: SparkSession, d: str, newest: bool) -> DataFrame:
    n = table(s, d, "nodes").groupBy("id")
    r = n.agg((F.max_by if newest else F.min_by)(F.struct("hlc", "attrs"), F.struct("hlc", "site_id")).alias("r"))
    return r.select(F.col("id").alias("path"), F.col("r.hlc").alias("mtime"), F.length("r.attrs").alias("size"), F.md5("r.attrs").alias("hash"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Call graph: each reference belongs to the last definition above it in its file."""
    files, dd = calling(s, d)
    refs = code.references(files, dd, "doc_id", "text").where("kind in ('call', 'new', 'read')")
    owned = intervals.as_of(refs, dd.groupBy("doc_id", "line").agg(F.min("name").alias("owner")), "doc_id", "line", "line", ["owner"])
    e = owned.where("asof_owner is not null and asof_owner <> name").select(F.col("asof_owner").alias("src"), F.col("name").alias("dst")).distinct()
    starts = e.select(F.col("src").alias("start")).distinct()
    return graph.reach(stage(e, "calls"), starts, 4).where("depth > 0")


def _search(s: SparkSession, d: str) -> DataFrame:
    units = code.search_units(docs(s, d), "doc_id", "text").join(docs(s, d).select("doc_id", F.coalesce("source", F.lit("")).alias("place")), "doc_id")
    return code.search(units, "doc_id", "digest_ledger sweep", 40).withColumns({c: F.round(c, 6) for c in ("score", "header_score")})


def _units(s: SparkSession, d: str) -> DataFrame:
    return code.search_units(docs(s, d), "doc_id", "text")


def _imports(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths that texts name as files, each defining its stem and (every third) the stem's first three letters; each text, as a file of its source, imports what it names."""
    uses = _uses(s, d)
    stem = F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1)
    paths = uses.select("path").distinct()
    defs_ = paths.select("path", stem.alias("name")).unionByName(paths.where(F.length("path") % 3 == 0).select("path", F.substring(stem, 1, 3).alias("name")))
    by = F.concat_ws("/", F.lit("docs"), F.coalesce(F.lower(F.trim("source")), F.lit("none")), F.col("user").cast("string"))
    refs = uses.join(docs(s, d).select(F.col("doc_id").alias("user"), "source"), "user").select(by.alias("path"), F.when(F.length("path") % 2 == 0, stem).otherwise(F.substring(stem, 1, 3)).alias("name"), F.lit("import").alias("kind"))
    return paths.unionByName(refs.select("path").distinct()), defs_, refs


_IMPORTS = rf"""WITH us0 AS (SELECT doc_id, lower(trim(source)) AS source, unnest(regexp_extract_all(text, '{_PATH}')) AS path FROM documents),
st AS (SELECT DISTINCT path, regexp_extract(path, '([^/]+)\.[a-z]+$', 1) AS stem FROM us0),
df AS (SELECT path, stem AS name FROM st UNION ALL SELECT path, stem[1:3] FROM st WHERE length(path) % 3 = 0),
rf AS (SELECT 'docs/' || coalesce(source, 'none') || '/' || doc_id AS path, CASE WHEN length(path) % 2 = 0 THEN regexp_extract(path, '([^/]+)\.[a-z]+$', 1) ELSE regexp_extract(path, '([^/]+)\.[a-z]+$', 1)[1:3] END AS name FROM us0),
fl AS (SELECT path FROM st UNION ALL SELECT DISTINCT path FROM rf),
pl AS (SELECT name, min(path) AS target, count(DISTINCT path) AS c FROM df GROUP BY 1),
ed AS (SELECT rf.name, rf.path, target, count(*) AS n FROM rf JOIN pl ON pl.name = rf.name AND c = 1 WHERE target <> rf.path GROUP BY ALL)"""
_DIR = "array_to_string(string_split({0}, '/')[1:least(3, len(string_split({0}, '/')) - 1)], '/')"
_MAP = _IMPORTS + f""", hb AS (SELECT dir, string_agg(name || '=' || refs, ',' ORDER BY k) AS hubs FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY refs DESC, name) AS k FROM (SELECT {_DIR.format('target')} AS dir, name, CAST(sum(n) AS BIGINT) AS refs FROM ed GROUP BY 1, 2)) WHERE k <= 3 GROUP BY 1),
ub AS (SELECT dir, string_agg(u || '=' || refs, ',' ORDER BY k) AS used_by FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY refs DESC, u) AS k FROM (SELECT {_DIR.format('target')} AS dir, {_DIR.format('path')} AS u, CAST(sum(n) AS BIGINT) AS refs FROM ed GROUP BY 1, 2) WHERE dir <> u) WHERE k <= 3 GROUP BY 1),
sz AS (SELECT dir, CAST(sum(f) AS BIGINT) AS files, CAST(sum(d) AS BIGINT) AS defs FROM (SELECT {_DIR.format('path')} AS dir, 1 AS f, 0 AS d FROM fl UNION ALL SELECT {_DIR.format('path')}, 0, 1 FROM df) GROUP BY 1)
SELECT dir, files, defs, coalesce(hubs, '') AS hubs, coalesce(used_by, '') AS used_by FROM sz LEFT JOIN hb USING (dir) LEFT JOIN ub USING (dir)"""


def _anchors(s: SparkSession, d: str) -> DataFrame:
    """Each definition with four lines as an anchor; its file later lost its first line, every seventh file all."""
    a = defs(s, d).select("doc_id", "line").distinct().join(docs(s, d), "doc_id")
    now = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.expr("substring(text, instr(text, '\n') + 1)"))
    return a.select(F.concat_ws(":", "doc_id", "line").alias("node_id"), F.col("text").alias("before"), now.alias("now"), F.col("line").cast("int").alias("span_start"), (F.col("line") + 3).cast("int").alias("span_end"))


def _line_anchor(s: SparkSession, d: str) -> DataFrame:
    spans = defs(s, d).select("doc_id", "name", F.col("line").alias("start"), (F.col("line") + 3).alias("end"))
    hits = code.grep(docs(s, d), "doc_id", "text", "return").select("doc_id", "line")
    return intervals.smallest_containing(hits, spans, "doc_id", "line", "start", "end").select("doc_id", "line", "name")


def _copies(s: SparkSession, d: str) -> DataFrame:
    """Documents of one fingerprint with the first of them, and every two such firsts that share a hash."""
    return code.shared_prints(stage(code.fingerprints(docs(s, d), "doc_id", "text"), "fp"), "doc_id", digits=4)


_STOPS = ", ".join(f"'{w}'" for w in code.STOP_WORDS)
_CRUX = rf"list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(coalesce(title, ''), '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda w: lower(w) NOT IN ({_STOPS}))), lambda w: {{'n': -length(w), 'w': w}}))"

QUERIES = {
    "cod1_scan": Query(
        lambda s, d: code.changed(_listing(s, d, True), _listing(s, d, False)).groupBy("state").agg(F.count("*").alias("n")),
        """SELECT CASE WHEN h0 = h1 AND a = b THEN 'unchanged' WHEN a = b THEN 'touched' ELSE 'dirty' END AS state, count(*) AS n FROM (SELECT min(hlc) AS h0, max(hlc) AS h1, arg_min(attrs, (hlc, site_id)) AS a, arg_max(attrs, (hlc, site_id)) AS b FROM nodes GROUP BY id) GROUP BY 1""",
    ),
    "cod2_definitions": Query(defs, q.with_(_LINES, _DEFS) + "SELECT doc_id, line, name, kind FROM df"),
    "cod3_references": Query(lambda s, d: code.references(*calling(s, d), "doc_id", "text")),
    "cod4_symbols": Query(lambda s, d: defs(s, d).where("name like 'c%'").select("name", "doc_id", "line"), q.with_(_LINES, _DEFS) + "SELECT name, doc_id, line FROM df WHERE name LIKE 'c%'"),
    "cod5_reference_kinds": Query(lambda s, d: code.references(*calling(s, d), "doc_id", "text").groupBy("kind").agg(F.count("*").alias("n"))),
    "cod6_call_graph": Query(_calls),
    "cod7_fan_in": Query(
        lambda s, d: code.fan_in(docs(s, d), defs(s, d), "doc_id", "text"),
        q.with_(_LINES, _DEFS, "w AS (SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM documents) WHERE name IN (SELECT name FROM df) GROUP BY ALL)", "o AS (SELECT doc_id, name, count(*) AS own FROM df GROUP BY ALL)")
        + "SELECT name, count(*) AS files, CAST(sum(n - coalesce(own, 0)) AS BIGINT) AS hits FROM w LEFT JOIN o USING (doc_id, name) WHERE n - coalesce(own, 0) > 0 GROUP BY 1",
    ),
    "cod8_unused": Query(
        lambda s, d: defs(s, d).select("name").distinct().join(code.fan_in(docs(s, d), defs(s, d), "doc_id", "text"), "name", "left_anti"),
        q.with_(_LINES, _DEFS, "w AS (SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM documents) WHERE name IN (SELECT name FROM df) GROUP BY ALL)", "o AS (SELECT doc_id, name, count(*) AS own FROM df GROUP BY ALL)")
        + "SELECT DISTINCT name FROM df WHERE name NOT IN (SELECT name FROM w LEFT JOIN o USING (doc_id, name) WHERE n - coalesce(own, 0) > 0)",
    ),
    "cod9_repo_map": Query(lambda s, d: code.cluster_map(*_imports(s, d)), _MAP),
    "cod9_import_states": Query(
        lambda s, d: code.import_edges(*_imports(s, d)[1:]).groupBy("state").agg(F.sum("n").alias("n")),
        _IMPORTS + " SELECT CASE WHEN c > 1 THEN 'ambiguous' WHEN target = rf.path THEN 'own' ELSE 'edge' END AS state, count(*) AS n FROM rf JOIN pl USING (name) GROUP BY 1",
    ),
    "cod10_search": Query(_search),
    "cod11_units": Query(_units),
    "cod12_grep": Query(
        lambda s, d: code.grep(docs(s, d), "doc_id", "text", "digest"), q.with_(_LINES) + "SELECT doc_id, CAST(line AS INTEGER) AS line, (length(content) - length(replace(content, 'digest', ''))) // 6 AS hits FROM ln WHERE contains(content, 'digest')"
    ),
    "cod16_shared_prints": Query(_copies),
    "cod18_anchor_states": Query(lambda s, d: code.anchor_states(_anchors(s, d)).select("node_id", "state", "span_start", "span_end", F.round("drift", 4).alias("drift"))),
    "cod20_crux_terms": Query(
        lambda s, d: current_nodes(table(s, d, "nodes"), "title").select("id", F.array_join(code.crux_terms(F.col("title")), " ").alias("terms")), q.with_(q.N) + f"SELECT id, coalesce(array_to_string(list_transform({_CRUX}[1:8], lambda x: x.w), ' '), '') AS terms FROM n"
    ),
    "cod21_line_owners": Query(
        _line_anchor,
        q.with_(_LINES, _DEFS) + "SELECT doc_id, line, name FROM (SELECT l.doc_id, CAST(l.line AS INTEGER) AS line, df.name, row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY df.line DESC) k FROM ln l JOIN df ON df.doc_id = l.doc_id AND l.line BETWEEN df.line AND df.line + 3 WHERE contains(content, 'return')) WHERE k = 1",
    ),
    "cod22_sweep_batch": Query(
        lambda s, d: current_nodes(table(s, d, "nodes"), "kind", "status", "accessed_at").where("kind = 'anchor'").orderBy(F.when(F.col("status") == "lost", 1).otherwise(0), "accessed_at", "id").limit(200).select("id", "status"),
        q.with_(q.N) + "SELECT id, status FROM n WHERE kind = 'anchor' ORDER BY CASE WHEN status = 'lost' THEN 1 ELSE 0 END, accessed_at, id LIMIT 200",
    ),
    "cod23_freshness": Query(lambda s, d: docs(s, d).groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("created_at").alias("latest")), "SELECT lower(trim(source)) AS source, max(created_at) AS latest FROM documents GROUP BY 1"),
    "src16_languages": Query(
        lambda s, d: _uses(s, d).groupBy(code.language(F.col("path")).alias("lang")).agg(F.count("*").alias("n")),
        q.with_(_USES) + "SELECT CASE x WHEN 'ts' THEN 'ts' WHEN 'py' THEN 'py' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'sql' THEN 'sql' WHEN 'md' THEN 'md' WHEN 'js' THEN 'js' END AS lang, count(*) AS n FROM (SELECT regexp_extract(path, '\\.([a-z]+)$', 1) AS x FROM us) GROUP BY 1",
    ),
}
