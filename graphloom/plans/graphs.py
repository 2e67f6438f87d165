"""Queries of trees, dependencies and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.operators.current import current_edges, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.records import _P3_DOWN_SQL, _P3_SQL
from graphloom.plans.registry import Query
from graphloom.sources.tables import table
from graphloom.staging import stage


def nodes(s: SparkSession, d: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes"), "kind", "status", "head_id", "hlc", "site_id", "open_blockers", "anc_blockers", "scope", "attrs")


def edges(s: SparkSession, d: str, *types: str) -> DataFrame:
    return current_edges(table(s, d, "edges"), "weight", types=types)


def closure(s: SparkSession, d: str) -> DataFrame:
    return graph.closure(table(s, d, "edges"))


_TREE = f"tree AS (SELECT ancestor, id AS descendant, distance AS depth FROM ({_P3_DOWN_SQL}) WHERE link = 'parent' AND id IN (SELECT id FROM ({_P3_SQL}) WHERE link = 'parent' AND state = 'tree'))"


def _middle(tree: DataFrame) -> tuple[str, str]:
    """A stated link: the record with most descendants, and the root with most of another tree."""
    rows = tree.groupBy("ancestor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ancestor").limit(2).collect()
    return rows[1]["ancestor"], rows[0]["ancestor"]


def _added(s: SparkSession, d: str) -> DataFrame:
    tree = stage(closure(s, d), "closure")
    return graph.closure_added(tree, *_middle(tree))


def _removed(s: SparkSession, d: str) -> DataFrame:
    tree = stage(closure(s, d), "closure")
    child = tree.join(tree.select(F.col("ancestor").alias("descendant")).distinct(), "descendant").agg(F.min("descendant")).first()[0]
    return graph.closure_removed(tree, child)


def _moves(s: SparkSession, d: str) -> DataFrame:
    tree = stage(closure(s, d), "closure")
    a, b = _middle(tree)
    rows = [(x, y, graph.move_verdict(tree, x, y)) for x, y in ((a, b), (b, b), (a, tree.where(F.col("ancestor") == a).agg(F.min("descendant")).first()[0]))]
    return s.createDataFrame(rows, "child string, parent string, verdict string")


_PICK = "pick AS (SELECT ancestor AS id, row_number() OVER (ORDER BY c DESC, ancestor) AS k FROM (SELECT ancestor, count(*) AS c FROM tree GROUP BY 1))"
_ADDED = q.with_(_TREE, _PICK) + """SELECT ancestor, descendant, CAST(a + b + 1 AS INTEGER) AS depth FROM
 (SELECT ancestor, depth AS a FROM tree WHERE descendant = (SELECT id FROM pick WHERE k = 1) UNION ALL SELECT id, 0 FROM pick WHERE k = 1),
 (SELECT descendant, depth AS b FROM tree WHERE ancestor = (SELECT id FROM pick WHERE k = 2) UNION ALL SELECT id, 0 FROM pick WHERE k = 2)"""
_REMOVED = q.with_(_TREE, "ch AS (SELECT min(descendant) AS id FROM tree WHERE descendant IN (SELECT ancestor FROM tree))") + """SELECT * FROM tree t WHERE NOT (
 ancestor IN (SELECT ancestor FROM tree WHERE descendant = (FROM ch)) AND (descendant = (FROM ch) OR descendant IN (SELECT descendant FROM tree WHERE ancestor = (FROM ch))))"""


def _counts(s: SparkSession, d: str) -> DataFrame:
    return graph.blocker_counts(edges(s, d, "blocks"), nodes(s, d))


_OB = f"ob AS (SELECT e.dst AS id, count(*) AS open_blockers FROM e JOIN n ON n.id = e.src WHERE e.type = 'blocks' AND n.status NOT IN {q.CLOSED} GROUP BY 1)"


def _blocking_ancestors(s: SparkSession, d: str) -> DataFrame:
    return closure(s, d).join(_counts(s, d).withColumnRenamed("id", "ancestor"), "ancestor").select("descendant", "ancestor", "depth", "open_blockers")


def _drift(s: SparkSession, d: str) -> DataFrame:
    both = nodes(s, d).select("id", "anc_blockers").join(graph.ancestor_blocker_counts(closure(s, d), _counts(s, d)).withColumnRenamed("anc_blockers", "counted"), "id", "left")
    return both.select("id", F.col("anc_blockers").alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted")).where("stored <> counted")


def _roots(s: SparkSession, d: str) -> DataFrame:
    """Stated start records: those that block most."""
    return edges(s, d, "blocks").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(20).select("id")


_ROOTS = "roots AS (SELECT src AS id FROM e WHERE type = 'blocks' GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 20)"


def _ways_sql(a: str, b: str) -> str:
    rec = f"""ways AS (SELECT id AS root, id, 0 AS depth, [id] AS path, false AS leaf FROM roots UNION ALL
      SELECT w.root, e.{b}, w.depth + 1, list_append(w.path, e.{b}), list_contains(w.path, e.{b}) FROM ways w JOIN e ON e.{a} = w.id AND e.type = 'blocks' JOIN n ON n.id = e.{b}
      WHERE n.status NOT IN {q.CLOSED} AND NOT w.leaf AND w.depth < 4)"""
    return "WITH RECURSIVE " + ", ".join((q.N, q.E, _ROOTS, rec))


def _ways(s: SparkSession, d: str, down: bool) -> DataFrame:
    return graph.dependency_rows(edges(s, d, "blocks").select("src", "dst"), _roots(s, d), nodes(s, d), 4, down)


def _acyclic(s: SparkSession, d: str) -> DataFrame:
    """Each blocks edge of the stated roots, asked for backwards, and once more from records apart."""
    e = edges(s, d, "blocks").select("src", "dst")
    back = e.join(F.broadcast(_roots(s, d).withColumnRenamed("id", "src")), "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.acyclicity(e, back).select("src", "dst", "verdict")


_ACYC = ("WITH RECURSIVE " + ", ".join((q.N, q.E, _ROOTS, "cand AS (SELECT e.dst AS src, e.src AS dst FROM e JOIN roots r ON r.id = e.src WHERE type = 'blocks')",
  "r AS (SELECT DISTINCT dst AS start, dst AS id FROM cand UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.id AND e.type = 'blocks')"))
  + " SELECT src, dst, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.start = cand.dst AND r.id = cand.src) THEN 'cycle' WHEN (SELECT count(*) FROM r WHERE r.start = cand.dst) >= 512 THEN 'reach' ELSE 'clear' END AS verdict FROM cand")


def _move(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    starts = nodes(s, d).where("scope = 'kiln-core' and kind = 'task'").select("id")
    return graph.crossing(e, graph.move_set(starts, e, nodes(s, d))).groupBy("type").agg(F.count("*").alias("n"))


_VL = "vl AS (SELECT * FROM (SELECT src AS newer, dst AS older FROM e WHERE type = 'supersedes' UNION SELECT head_id, id FROM n WHERE head_id <> '') WHERE newer <> older AND newer IN (SELECT id FROM n) AND older IN (SELECT id FROM n))"
_MOVE = "WITH RECURSIVE " + ", ".join((q.N, q.E, _VL, "ln AS (SELECT newer AS a, older AS b FROM vl UNION SELECT older, newer FROM vl UNION SELECT src, dst FROM e WHERE type = 'blocks' UNION SELECT dst, src FROM e WHERE type = 'blocks')",
  "m AS (SELECT id FROM n WHERE scope = 'kiln-core' AND kind = 'task' UNION SELECT ln.b FROM m JOIN ln ON ln.a = m.id)")) + " SELECT type, count(*) AS n FROM e WHERE (src IN (SELECT id FROM m)) <> (dst IN (SELECT id FROM m)) GROUP BY 1"
_COMP = "u AS (SELECT newer AS a, older AS b FROM vl UNION SELECT older, newer FROM vl), cc AS (SELECT a AS id, a AS r FROM u UNION SELECT u.b, cc.r FROM cc JOIN u ON u.a = cc.id), comp AS (SELECT id, min(r) AS chain FROM cc GROUP BY 1)"
_HEADS = "WITH RECURSIVE " + ", ".join((q.N, q.E, _VL, _COMP)) + """ SELECT chain, id, votes, row_number() OVER (PARTITION BY chain ORDER BY votes DESC, hlc DESC NULLS LAST, site_id DESC NULLS LAST, id DESC) AS place FROM (
  SELECT chain, comp.id, (SELECT count(*) FROM n v WHERE v.head_id = comp.id AND v.id <> comp.id) AS votes, hlc, site_id FROM comp JOIN n ON n.id = comp.id
  WHERE comp.id NOT IN (SELECT older FROM vl) OR chain NOT IN (SELECT chain FROM comp WHERE id NOT IN (SELECT older FROM vl)))"""


def _decisions(s: SparkSession, d: str) -> DataFrame:
    """Decisions, whether they are a head, and their open contradictions."""
    n, e = nodes(s, d), edges(s, d, "contradicts")
    dec = n.where(F.get_json_object("attrs", "$.type") == "decision").select("id", F.col("head_id").isNull().alias("is_head"))
    opp = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("contradictions"))
    return dec.join(opp, "id", "left").fillna(0, ["contradictions"])


def _stranded(s: SparkSession, d: str) -> DataFrame:
    """Records whose head lies in another scope."""
    n = nodes(s, d)
    return n.where("head_id is not null").join(n.select(F.col("id").alias("head_id"), F.col("scope").alias("hs")), "head_id").where("hs <> scope").select("id", "head_id")


QUERIES = {
    "grf1_closure": Query(closure, q.with_(_TREE) + "SELECT * FROM tree"),
    "grf2_closure_added": Query(_added, _ADDED),
    "grf3_closure_removed": Query(_removed, _REMOVED),
    "grf4_move_verdicts": Query(_moves),
    "grf5_relatives": Query(
        lambda s, d: closure(s, d).groupBy("descendant").agg(F.count("*").alias("ancestors"), F.min_by("ancestor", F.struct("depth", "ancestor")).alias("nearest")),
        q.with_(_TREE) + "SELECT descendant, count(*) AS ancestors, arg_min(ancestor, (depth, ancestor)) AS nearest FROM tree GROUP BY 1",
    ),
    "grf6_blocking_ancestors": Query(_blocking_ancestors, q.with_(q.N, q.E, _OB, _TREE) + "SELECT descendant, ancestor, depth, open_blockers FROM tree JOIN ob ON ob.id = ancestor"),
    "grf7_acyclicity": Query(_acyclic, _ACYC),
    "grf8_open_blockers": Query(_counts, q.with_(q.N, q.E, _OB) + "SELECT * FROM ob"),
    "grf9_ancestor_blockers": Query(lambda s, d: graph.ancestor_blocker_counts(closure(s, d), _counts(s, d)), q.with_(q.N, q.E, _OB, _TREE) + "SELECT descendant AS id, count(*) AS anc_blockers FROM tree JOIN ob ON ob.id = ancestor GROUP BY 1"),
    "grf9_ancestor_drift": Query(
        _drift, q.with_(q.N, q.E, _OB, _TREE) + "SELECT n.id, anc_blockers AS stored, coalesce(c, 0) AS counted FROM n LEFT JOIN (SELECT descendant, count(*) AS c FROM tree JOIN ob ON ob.id = ancestor GROUP BY 1) ON descendant = n.id WHERE anc_blockers <> coalesce(c, 0)"
    ),
    "grf10_version_chains": Query(lambda s, d: graph.version_chains(edges(s, d, "supersedes"), nodes(s, d))),
    "grf11_version_heads": Query(lambda s, d: graph.version_heads(edges(s, d, "supersedes"), nodes(s, d)), _HEADS),
    "grf12_supersession_plan": Query(
        lambda s, d: (lambda c, h: c.join(h.where("place = 1").select("chain", F.col("id").alias("head")), "chain").where("id <> head").select("id", "head"))(
            graph.version_chains(edges(s, d, "supersedes"), nodes(s, d)), graph.version_heads(edges(s, d, "supersedes"), nodes(s, d))
        ),
        "WITH RECURSIVE " + ", ".join((q.N, q.E, _VL, _COMP)) + f" SELECT comp.id, h.id AS head FROM comp JOIN ({_HEADS}) h ON h.chain = comp.chain AND h.place = 1 WHERE comp.id <> h.id",
    ),
    "grf13_versions_bounded": Query(
        lambda s, d: graph.version_chains(edges(s, d, "supersedes"), nodes(s, d)).groupBy("chain").agg(F.least(F.count("*"), F.lit(65)).alias("versions"), (F.count("*") > 65).alias("truncated")),
        "WITH RECURSIVE " + ", ".join((q.N, q.E, _VL, _COMP)) + " SELECT chain, least(count(*), 65) AS versions, count(*) > 65 AS truncated FROM comp GROUP BY 1",
    ),
    "grf14_dependency_tree": Query(lambda s, d: _ways(s, d, True).select("root", "id", "depth", F.array_join("path", "/").alias("path")), _ways_sql("src", "dst") + " SELECT root, id, depth, array_to_string(path, '/') AS path FROM ways"),
    "grf15_dependency_why": Query(lambda s, d: _ways(s, d, False).groupBy("root").agg(F.count("*").alias("occurrences"), F.max("depth").alias("critical")), _ways_sql("dst", "src") + " SELECT root, count(*) AS occurrences, max(depth) AS critical FROM ways GROUP BY 1"),
    "grf16_move_crossing": Query(_move, _MOVE),
    "grf17_stranded": Query(_stranded, q.with_(q.N) + "SELECT a.id, a.head_id FROM n a JOIN n b ON b.id = a.head_id WHERE a.scope <> b.scope"),
    "grf19_payload": Query(
        lambda s, d: graph.payload(edges(s, d), nodes(s, d)),
        q.with_(q.N, q.E) + ", t AS (SELECT id FROM n LEFT JOIN (SELECT x, count(*) AS c FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) ON x = id ORDER BY coalesce(c, 0) DESC, id LIMIT 25000) SELECT src, type, dst FROM e WHERE src IN (FROM t) AND dst IN (FROM t)",
    ),
    "grf20_decisions": Query(
        _decisions, q.with_(q.N, q.E) + f"SELECT id, head_id IS NULL AS is_head, coalesce(c, 0) AS contradictions FROM n LEFT JOIN (SELECT x, count(*) AS c FROM (SELECT src AS x FROM e WHERE type = 'contradicts' UNION ALL SELECT dst FROM e WHERE type = 'contradicts') GROUP BY 1) ON x = id WHERE {q.attr('type')} = 'decision'"
    ),
    "agg10_degrees": Query(lambda s, d: graph.degrees(edges(s, d)), q.with_(q.E) + "SELECT x AS id, count(*) AS degree FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) GROUP BY 1"),
}
