"""Queries of the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import oplog
from graphloom.operators.current import current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table


def ops(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "oplog")


_O = "o AS (SELECT op_id, arg_min(entity_id, (arrived_at, value)) AS entity_id, any_value(op) AS op, any_value(field) AS field, arg_min(value, (arrived_at, value)) AS value, any_value(site_id) AS site_id, any_value(hlc.ts) AS ts, any_value(hlc.ctr) AS ctr, any_value(seq) AS seq FROM oplog GROUP BY op_id)"
_REG = "reg AS (SELECT entity_id, field, arg_max(value, (ts, ctr, site_id)) AS value, arg_max(op_id, (ts, ctr, site_id)) AS op_id FROM o WHERE op = 'set' GROUP BY ALL)"
_CNT = "cnt AS (SELECT entity_id, field, CAST(sum(v) AS BIGINT) AS total FROM (SELECT entity_id, field, site_id, max(CAST(value AS BIGINT)) AS v FROM o WHERE op = 'inc' GROUP BY ALL) GROUP BY ALL)"
_TOMB = "tomb AS (SELECT entity_id, tag, max(ts) AS gone_at FROM (SELECT entity_id, unnest(CAST(json_extract(value, '$.tags') AS VARCHAR[])) AS tag, ts FROM o WHERE op = 'edge_del') GROUP BY ALL)"
_EDG = """edg AS (SELECT a.entity_id, arg_max(a.tag, (gone_at IS NULL, ts, ctr, site_id, a.tag)) AS tag, coalesce(arg_max([w], (gone_at IS NULL, ts, ctr, site_id, a.tag))[1], 1.0) AS weight, min(ts) AS created_at,
  CASE WHEN NOT bool_or(gone_at IS NULL) THEN max(gone_at) END AS deleted_at
  FROM (SELECT *, coalesce(json_extract_string(value, '$.tag'), op_id) AS tag, CAST(json_extract_string(value, '$.weight') AS DOUBLE) AS w FROM o WHERE op = 'edge_add') a
  LEFT JOIN tomb t ON t.entity_id = a.entity_id AND t.tag = a.tag GROUP BY 1)"""
_DEAD = "dead AS (SELECT DISTINCT entity_id FROM o WHERE op = 'purge')"


def _site_half(s: SparkSession, d: str, low: bool) -> DataFrame:
    return ops(s, d).where(F.col("site_id") < "sm" if low else F.col("site_id") >= "sm")


def _delta(s: SparkSession, d: str) -> DataFrame:
    known = oplog.watermarks(ops(s, d).where("seq <= 200")).where("site_id < 'sx'")
    return oplog.delta(ops(s, d), known).groupBy("site_id").agg(F.count_distinct("op_id").alias("n"))


def _election(s: SparkSession, d: str, external: bool) -> DataFrame:
    n = current_nodes(table(s, d, "nodes"), "scope", "kind", "content_hash", "attrs", "created_at", "site_id")
    key = F.coalesce(F.get_json_object("attrs", "$.external_ref"), F.get_json_object("attrs", "$.repo")) if external else F.lower(F.substring_index("content_hash", ":", 1))
    rows = n.select("id", "scope", "kind", key.alias("canon"), "created_at", "site_id").where("canon is not null")
    return oplog.election(rows, ["scope", "kind", "canon"], ["created_at", "site_id"]).select("id", "winner", "demoted")


def _election_sql(key: str) -> str:
    return q.with_(q.N, f"t AS (SELECT id, scope, kind, {key} AS canon, created_at, site_id FROM n)") + """SELECT id, winner, CASE WHEN id <> winner THEN canon || ':' || id END AS demoted FROM (
      SELECT *, first_value(id) OVER (PARTITION BY scope, kind, canon ORDER BY created_at, site_id, id) AS winner, count(*) OVER (PARTITION BY scope, kind, canon) AS c FROM t WHERE canon IS NOT NULL) WHERE c > 1"""


def _three_way(s: SparkSession, d: str) -> DataFrame:
    """Stored titles and statuses against the log's, with older rows as what was last agreed."""
    n = table(s, d, "nodes")
    now = current_nodes(n, "title", "status", deleted=True)
    old = n.groupBy("id").agg(F.min_by(F.struct("title", "status"), F.struct("hlc", "site_id")).alias("r")).select("id", "r.title", "r.status")
    won = oplog.registers(ops(s, d)).where("field in ('title', 'status')").select(F.col("entity_id").alias("id"), "field", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("value"))

    def long(df: DataFrame) -> DataFrame:
        return df.unpivot(["id"], ["title", "status"], "field", "value")

    here = long(now).join(won.select("id").distinct(), "id", "left_semi")
    return oplog.three_way(won, here, long(old), ["id", "field"]).groupBy("field", "action").agg(F.count("*").alias("n"))


_THREE = q.with_(q.NALL, _O, _REG, "old AS (SELECT id, title, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hlc, site_id) rn FROM nodes) WHERE rn = 1)",
  "won AS (SELECT entity_id AS id, field, json_extract_string(value, '$') AS v FROM reg WHERE field IN ('title', 'status'))",
  "l AS (SELECT id, unnest(['title', 'status']) AS field, unnest([title, status]) AS v FROM nall WHERE id IN (SELECT id FROM won))",
  "b AS (SELECT id, unnest(['title', 'status']) AS field, unnest([title, status]) AS v, true AS known FROM old)") + """
SELECT field, CASE WHEN s IS NOT DISTINCT FROM l THEN 'sync' WHEN known IS NULL THEN 'apply' WHEN s IS NOT DISTINCT FROM b THEN 'keep' WHEN l IS NOT DISTINCT FROM b THEN 'apply' ELSE 'conflict' END AS action, count(*) AS n
FROM (SELECT coalesce(won.id, l.id) AS id, coalesce(won.field, l.field) AS field, won.v AS s, l.v AS l FROM won FULL JOIN l ON won.id = l.id AND won.field = l.field) x
LEFT JOIN (SELECT id, field, v AS b, known FROM b) y USING (id, field) GROUP BY ALL"""  # fmt: skip


def _closes(s: SparkSession, d: str) -> DataFrame:
    """Latest closing instants that no later status says: entity, instant."""
    o = ops(s, d)
    closed = o.where("op = 'set' and field = 'closed_at' and value <> 'null'").groupBy("entity_id").agg(F.max(oplog.clock()).alias("c"))
    status = o.where("op = 'set' and field = 'status'").groupBy("entity_id").agg(F.max(oplog.clock()).alias("s"))
    return closed.join(status, "entity_id", "left").where("s is null or s < c").select("entity_id", "c.ts")


_CLOSES = q.with_(_O) + """SELECT entity_id, c.ts AS ts FROM (SELECT entity_id, max({'ts': ts, 'ctr': ctr, 'site_id': site_id}) AS c FROM o WHERE op = 'set' AND field = 'closed_at' AND value <> 'null' GROUP BY 1)
LEFT JOIN (SELECT entity_id, max({'ts': ts, 'ctr': ctr, 'site_id': site_id}) AS s FROM o WHERE op = 'set' AND field = 'status' GROUP BY 1) USING (entity_id) WHERE s IS NULL OR s < c"""


def _dependencies(s: SparkSession, d: str) -> DataFrame:
    """Edge additions sorted into what they mean for an import."""
    kind = F.when(F.col("field") == "blocks", "blocks").when(F.col("field") == "parent", "parent").when(F.col("field").isin("relates", "duplicates", "supersedes"), "extra").otherwise("unknown")
    return ops(s, d).where("op = 'edge_add'").groupBy(kind.alias("part")).agg(F.count_distinct("op_id").alias("n"))


COLUMNS = ("kind", "scope", "title", "status", "priority")

QUERIES = {
    "log1_registers": Query(lambda s, d: oplog.registers(ops(s, d)).select("entity_id", "field", "op_id"), q.with_(_O, _REG) + "SELECT entity_id, field, op_id FROM reg"),
    # clocks cut to thirty days stand for sites that reuse a clock
    "log1_collisions": Query(
        lambda s, d: oplog.collisions(ops(s, d).withColumn("hlc", F.struct((F.col("hlc.ts") - F.col("hlc.ts") % 2_592_000_000).alias("ts"), F.lit(0).alias("ctr")))),
        q.with_(_O) + "SELECT entity_id, field, ts - ts % 2592000000 AS ts, CAST(0 AS INTEGER) AS ctr, site_id, count(DISTINCT value) AS n FROM o WHERE op = 'set' GROUP BY ALL HAVING count(DISTINCT value) > 1",
    ),
    "log2_counters": Query(lambda s, d: oplog.counters(ops(s, d)), q.with_(_O, _CNT) + "SELECT * FROM cnt"),
    "log3_live_edges": Query(lambda s, d: oplog.projected_edges(ops(s, d)).where("deleted_at is null").select("entity_id", "tag"), q.with_(_O, _TOMB, _EDG) + "SELECT entity_id, tag FROM edg WHERE deleted_at IS NULL"),
    "log4_projected_edges": Query(lambda s, d: oplog.projected_edges(ops(s, d)), q.with_(_O, _TOMB, _EDG) + "SELECT * FROM edg"),
    "log5_unique": Query(lambda s, d: oplog.unique(ops(s, d)).select("op_id", "entity_id", "op", "field", "value"), q.with_(_O) + "SELECT op_id, entity_id, op, field, value FROM o"),
    "log6_joined_replicas": Query(lambda s, d: oplog.joined(oplog.replica(_site_half(s, d, True)), oplog.replica(_site_half(s, d, False))).select("entity_id", "field", "ts", "ctr", "site_id"), q.with_(_O) + "SELECT entity_id, field, m.ts AS ts, m.ctr AS ctr, m.s AS site_id FROM (SELECT entity_id, field, max({'ts': ts, 'ctr': ctr, 's': site_id}) AS m FROM o WHERE op = 'set' GROUP BY ALL)"),
    "log7_snapshot": Query(lambda s, d: oplog.snapshot(ops(s, d))),
    "log9_without_purged": Query(
        lambda s, d: oplog.without_purged(oplog.projected_edges(ops(s, d)).select("entity_id"), ops(s, d)),
        q.with_(_O, _TOMB, _EDG, _DEAD) + "SELECT entity_id FROM edg WHERE entity_id NOT IN (FROM dead) AND split_part(entity_id, '|', 1) NOT IN (FROM dead) AND split_part(entity_id, '|', 3) NOT IN (FROM dead)",
    ),
    "log10_materialised": Query(
        lambda s, d: oplog.materialised(ops(s, d), COLUMNS),
        q.with_(_O, _REG, _DEAD) + "SELECT * FROM (SELECT entity_id, " + ", ".join(f"max(json_extract_string(value, '$')) FILTER (field = '{c}') AS {c}" for c in COLUMNS) + ", count(*) FILTER (field LIKE 'attrs.%') AS n_attrs FROM reg WHERE entity_id NOT IN (FROM dead) GROUP BY 1) WHERE kind IS NOT NULL",
    ),
    "log11_parked": Query(lambda s, d: oplog.parked(ops(s, d)).select("op_id").distinct(), q.with_(_O) + "SELECT op_id FROM o WHERE op IN ('set', 'inc') AND entity_id NOT IN (SELECT entity_id FROM o WHERE op = 'set' AND field = 'kind')"),
    "log12_content_election": Query(lambda s, d: _election(s, d, False), _election_sql("lower(split_part(content_hash, ':', 1))")),
    "log13_external_election": Query(lambda s, d: _election(s, d, True), _election_sql(f"coalesce({q.attr('external_ref')}, {q.attr('repo')})")),
    "log15_unsaid_closes": Query(_closes, _CLOSES),
    "log16_peer_delta": Query(
        _delta,
        q.with_(_O, "w AS (SELECT site_id, max((ts << 16) + ctr) AS hlc FROM o WHERE seq <= 200 AND site_id < 'sx' GROUP BY 1)") + "SELECT o.site_id, count(*) AS n FROM o LEFT JOIN w USING (site_id) WHERE (ts << 16) + ctr > coalesce(hlc, -1) GROUP BY 1",
    ),
    "log17_three_way": Query(_three_way, _THREE),
    "log18_dependencies": Query(_dependencies, q.with_(_O) + "SELECT CASE WHEN field IN ('blocks', 'parent') THEN field WHEN field IN ('relates', 'duplicates', 'supersedes') THEN 'extra' ELSE 'unknown' END AS part, count(*) AS n FROM o WHERE op = 'edge_add' GROUP BY 1"),
    "agg6_watermarks": Query(lambda s, d: oplog.watermarks(ops(s, d)), "SELECT site_id, max((hlc.ts << 16) + hlc.ctr) AS hlc FROM oplog GROUP BY 1"),
    "srt6_batches": Query(
        lambda s, d: oplog.next_batch(oplog.delta(oplog.unique(ops(s, d)), s.createDataFrame([("none", 0)], "site_id string, hlc long")), F.length("value") + F.length("entity_id"), 300, 20_000),
        q.with_(_O) + """, r AS (SELECT op_id, row_number() OVER w AS place, CAST(sum(length(value) + length(entity_id)) OVER w AS BIGINT) AS bytes, (SELECT count(*) FROM o) AS total FROM o
        WINDOW w AS (ORDER BY (ts << 16) + ctr, site_id, op_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT op_id, place, bytes, count(*) OVER () < any_value(total) OVER () AS more FROM r WHERE place <= 300 AND (bytes <= 20000 OR place = 1)""",
    ),
}
