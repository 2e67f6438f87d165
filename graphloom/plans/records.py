"""Queries of the general record problems: p1, p3 and p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import feed, hierarchy, references
from graphloom.plans.registry import Query
from graphloom.sources.tables import table
from graphloom.staging import release, stage


def _p1(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(table(spark, d, "edges"), table(spark, d, "nodes"))


def _pieces(spark: SparkSession, d: str, pieces: int = 5) -> references.Picture:
    """The picture after the tables came in shuffled batches, each folded by itself into what was stored."""
    picture = None
    for k in range(pieces):
        part = [table(spark, d, t).where(F.pmod(F.xxhash64("hlc", "site_id", "created_at", *c), F.lit(pieces)) == k) for t, c in (("edges", ("src", "dst")), ("nodes", ("id",)))]
        after = references.folded(picture, *part)
        staged = references.Picture(stage(after.edges, "edge-states"), stage(after.nodes, "node-states"), stage(after.counts, "counts"))
        if picture:
            release(picture.edges, picture.nodes, picture.counts)
        picture = staged
    return picture


def _p3(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.parent_links(table(spark, d, "edges")).unionByName(hierarchy.head_links(table(spark, d, "nodes")))
    return hierarchy.hierarchies(links)


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.with_paths(_p3(spark, d))


def _p4(spark: SparkSession, d: str) -> DataFrame:
    return feed.current_state(table(spark, d, "oplog"))


def _canon(c: str) -> str:
    low = rf"lower(regexp_replace({c}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'))"
    return f"""CASE WHEN regexp_matches({low}, '^[a-z][a-z0-9]{{1,7}}-[0-9a-tv-z]{{12}}$')
      THEN split_part({low}, '-', 1) || '-' || translate(right({low}, 12), 'ilo', '110') ELSE {low} END"""


_P1_SQL = f"""
WITH e AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, type, dst ORDER BY hlc DESC, site_id DESC) rn FROM edges)
  WHERE rn = 1 AND deleted_at IS NULL
), n AS (
  SELECT * FROM (SELECT {_canon('id')} AS k, deleted_at, created_at, row_number() OVER (PARTITION BY id ORDER BY hlc DESC, site_id DESC) rn FROM nodes)
  WHERE rn = 1
), ends AS (
  SELECT src, type, dst, created_at, 'src' AS side, {_canon('src')} AS k FROM e
  UNION ALL SELECT src, type, dst, created_at, 'dst', {_canon('dst')} FROM e
), c AS (
  SELECT src, type, dst, side,
    CASE WHEN n.k IS NULL THEN 'missing' WHEN n.deleted_at IS NOT NULL THEN 'deleted' WHEN n.created_at > ends.created_at THEN 'late' END AS reason,
    strftime(make_timestamp(ends.created_at * 1000), '%Y-%m') AS period
  FROM ends LEFT JOIN n ON ends.k = n.k
)
SELECT src, type, dst, side, reason, period FROM c WHERE reason IS NOT NULL
"""

_P1_KEYS_SQL = f"SELECT CASE WHEN side = 'src' THEN {_canon('src')} ELSE {_canon('dst')} END AS key, count(*) AS refs, reason FROM ({_P1_SQL}) WHERE reason <> 'late' GROUP BY ALL"

_P1_REPORT_SQL = f"SELECT 'edges' AS table_name, side, reason, period, count(*) AS n FROM ({_P1_SQL}) GROUP BY ALL"

_P3_IDS = """
WITH RECURSIVE e AS (
  SELECT src, dst, hlc, site_id FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hlc DESC, site_id DESC) rn FROM edges WHERE type = 'parent')
  WHERE rn = 1 AND deleted_at IS NULL AND lower(coalesce(json_extract_string(attrs, '$.cycle'), '')) IN ('', '0', 'false', 'null')
), p AS (
  SELECT 'parent' AS link, src AS id, dst AS parent FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY hlc DESC, site_id DESC, dst DESC) rn FROM e) WHERE rn = 1
  UNION ALL
  SELECT 'head', id, head_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hlc DESC, site_id DESC) rn FROM nodes)
  WHERE rn = 1 AND head_id IS NOT NULL AND head_id <> ''
), ids AS (
  SELECT link, id FROM p UNION SELECT link, parent FROM p
), w AS (
  SELECT link, id, id AS place, [id] AS seen, false AS closed FROM ids
  UNION ALL
  SELECT w.link, w.id, p.parent, CASE WHEN list_contains(w.seen, p.parent) THEN w.seen ELSE list_append(w.seen, p.parent) END, list_contains(w.seen, p.parent)
  FROM w JOIN p ON w.link = p.link AND w.place = p.id WHERE NOT w.closed
), last AS (
  SELECT * FROM w WHERE closed OR NOT EXISTS (SELECT 1 FROM p WHERE p.link = w.link AND p.id = w.place)
), r AS (
  SELECT *, CASE WHEN closed THEN list_position(seen, place) END AS lp FROM last
)
SELECT link, id,
  CASE WHEN closed THEN list_min(seen[lp:]) ELSE place END AS root,
  CAST(CASE WHEN closed THEN lp - 1 ELSE len(seen) - 1 END AS INTEGER) AS depth,
  CASE WHEN NOT closed THEN list_reverse(seen) WHEN lp = 1 THEN [id] ELSE list_reverse(seen[:lp]) END AS ids,
  CASE WHEN NOT closed THEN 'tree' WHEN lp = 1 THEN 'cycle' ELSE 'below' END AS state
FROM r
"""

_P3_SQL = f"SELECT link, id, root, depth, array_to_string(ids, '/') AS path, state FROM ({_P3_IDS})"

_P3_DOWN_SQL = f"""
SELECT link, ancestor, id, CAST(depth - (i - 1) AS INTEGER) AS distance FROM (
  SELECT link, id, depth, unnest(range(1, len(ids) + 1)) AS i, unnest(ids) AS ancestor FROM ({_P3_IDS})
) WHERE i - 1 < depth
"""

_P3_LOOPS_SQL = f"SELECT link, root, count(*) AS members, max(id) AS greatest FROM ({_P3_SQL}) WHERE state = 'cycle' GROUP BY ALL"

_P4_SQL = """
WITH o AS (
  SELECT op_id, any_value(entity_id) AS entity_id, any_value(op) AS op, any_value(field) AS field, any_value(value) AS value,
         any_value(site_id) AS site_id, any_value(hlc.ts) AS ts, any_value(hlc.ctr) AS ctr
  FROM oplog GROUP BY op_id
), dead AS (SELECT DISTINCT entity_id FROM o WHERE op = 'purge'),
s AS (SELECT entity_id, field, 'set' AS what, arg_max(op_id, (ts, ctr, site_id)) AS result FROM o WHERE op = 'set' GROUP BY ALL),
i AS (
  SELECT entity_id, field, 'inc' AS what, CAST(CAST(sum(v) AS BIGINT) AS VARCHAR) AS result
  FROM (SELECT entity_id, field, site_id, max(CAST(value AS BIGINT)) AS v FROM o WHERE op = 'inc' GROUP BY ALL) GROUP BY ALL
), gone AS (
  SELECT entity_id, field, unnest(CAST(json_extract(value, '$.tags') AS VARCHAR[])) AS tag FROM o WHERE op = 'edge_del'
), a AS (
  SELECT *, coalesce(json_extract_string(value, '$.tag'), op_id) AS tag FROM o WHERE op = 'edge_add'
), e AS (
  SELECT entity_id, field, 'edge' AS what, arg_max(op_id, (ts, ctr, site_id)) AS result FROM a
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.entity_id = a.entity_id AND g.field = a.field AND g.tag = a.tag) GROUP BY ALL
), u AS (SELECT * FROM s UNION ALL SELECT * FROM i UNION ALL SELECT * FROM e)
SELECT entity_id, field, what, result FROM u
WHERE entity_id NOT IN (SELECT entity_id FROM dead)
  AND (what <> 'edge' OR (split_part(entity_id, '|', 1) NOT IN (SELECT entity_id FROM dead) AND split_part(entity_id, '|', 3) NOT IN (SELECT entity_id FROM dead)))
"""

QUERIES = {
    "p1_found": Query(_p1, _P1_SQL),
    "p1_folded": Query(lambda s, d: references.orphans(_pieces(s, d)), _P1_SQL),
    "p1_keys": Query(lambda s, d: references.orphan_keys(_pieces(s, d)), _P1_KEYS_SQL),
    "p1_report": Query(lambda s, d: references.orphan_report(_p1(s, d)), _P1_REPORT_SQL),
    "p3_found": Query(_p3_found, _P3_SQL),
    "p3_descendants": Query(lambda s, d: hierarchy.descendants(_p3(s, d)), _P3_DOWN_SQL),
    "p3_loops": Query(lambda s, d: hierarchy.loops(_p3(s, d)), _P3_LOOPS_SQL),
    "p4_found": Query(lambda s, d: _p4(s, d).drop("what"), f"SELECT entity_id, field, result FROM ({_P4_SQL})"),
    "p4_totals": Query(
        lambda s, d: _p4(s, d).groupBy("what").agg({"*": "count"}).withColumnRenamed("count(1)", "n"),
        f"SELECT what, count(*) AS n FROM ({_P4_SQL}) GROUP BY what",
    ),
}
