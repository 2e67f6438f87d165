"""Queries of scans, writes and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.constants import NOW_MS
from graphloom.functions.ids import canonical_id
from graphloom.operators import oplog
from graphloom.operators.current import current_edges, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.log import _O
from graphloom.plans.registry import Query
from graphloom.sinks import writes
from graphloom.sources import files
from graphloom.sources.tables import table
from graphloom.staging import stage

CUT = NOW_MS - 200 * 86_400_000


def nodes(s: SparkSession, d: str, *c: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes"), *c)


def ops(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "oplog")


def _peers(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("a", 300), ("b", 250)], "peer string, last_seq_sent long")


def _health(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nodes").groupBy("id")
    old = n.agg(F.min_by(F.struct("status", "created_at"), F.struct("hlc", "site_id")).alias("r")).select("id", F.col("r.status").alias("state"), F.col("r.created_at").alias("since"))
    new = n.agg(F.max_by("status", F.struct("hlc", "site_id")).alias("state")).withColumn("since", F.lit(NOW_MS))
    return writes.upsert_health(old, new, "id")


def _donors(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "content_hash")
    return writes.donors(n, n)


def _lifecycle(s: SparkSession, d: str) -> DataFrame:
    """All tasks deleted, the open ones restored, the cancelled ones purged; then what the log says of each."""
    n = nodes(s, d, "kind", "status").where("kind = 'task'").select("id", "status")
    ops_ = writes.removed(n, "w1", 1000).unionByName(writes.restored(n.where("status = 'open'"), "w2", 2000)).unionByName(writes.purge_ops(n.where("status = 'cancelled'"), "w3", 500))
    return oplog.without_purged(oplog.registers(ops_), ops_).groupBy("field", F.when(F.coalesce("value", F.lit("null")) == "null", "live").otherwise("deleted").alias("state")).agg(F.count("*").alias("n"))


def _removals(s: SparkSession, d: str) -> DataFrame:
    """Edges added by operations and those of every second source removed by the tags that were added: what is left."""
    e = current_edges(table(s, d, "edges"), "weight").where("type in ('blocks', 'relates')").select("src", "type", "dst")
    added = stage(writes.edge_ops(e, "w1", 1000), "added")
    tags = added.select(F.substring_index("entity_id", "|", 1).alias("src"), "field", F.substring_index("entity_id", "|", -1).alias("dst"), F.array(F.get_json_object("value", "$.tag")).alias("tags"))
    gone = writes.edge_ops(tags.where(F.ascii(F.substring("src", -1, 1)) % 2 == 0).withColumnRenamed("field", "type"), "w2", 2000, remove=True)
    left = oplog.projected_edges(added.unionByName(gone))
    return left.select(F.substring_index(F.substring_index("entity_id", "|", 2), "|", -1).alias("type"), F.col("deleted_at").isNull().alias("live")).groupBy("type", "live").agg(F.count("*").alias("n"))


QUERIES = {
    "snk5_lifecycle": Query(_lifecycle, q.with_(q.N) + "SELECT 'deleted_at' AS field, CASE WHEN status = 'open' THEN 'live' ELSE 'deleted' END AS state, count(*) AS n FROM n WHERE kind = 'task' AND status <> 'cancelled' GROUP BY 2"),
    "snk6_removals": Query(_removals, q.with_(q.E) + "SELECT type, ascii(right(src, 1)) % 2 = 1 AS live, count(*) AS n FROM e WHERE type IN ('blocks', 'relates') GROUP BY 1, 2"),
    "src4_point_lookup": Query(lambda s, d: nodes(s, d, "kind").orderBy("id").limit(1).select("id", "kind"), q.with_(q.N) + "SELECT id, kind FROM n ORDER BY id LIMIT 1"),
    "src5_key_range": Query(lambda s, d: files.by_prefix(nodes(s, d, "scope"), "scope", "kiln-").select("id", "scope"), q.with_(q.N) + "SELECT id, scope FROM n WHERE starts_with(scope, 'kiln-')"),
    "src6_id_prefix": Query(lambda s, d: files.by_prefix(table(s, d, "nodes").select("id").distinct(), "id", "kiln-a"), "SELECT DISTINCT id FROM nodes WHERE starts_with(id, 'kiln-a')"),
    "src7_distinct_scopes": Query(lambda s, d: table(s, d, "nodes").select("scope").distinct(), "SELECT DISTINCT scope FROM nodes"),
    "src8_log_since": Query(lambda s, d: files.since(ops(s, d).select("op_id", "seq").distinct(), 300, 500), "SELECT DISTINCT op_id, seq FROM oplog WHERE seq > 300 ORDER BY seq, op_id LIMIT 500"),
    "src9_entity_log": Query(
        lambda s, d: (lambda o: o.join(F.broadcast(o.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(1).select("entity_id")), "entity_id").select("op_id", "entity_id", F.col("hlc.ts").alias("ts")).distinct())(ops(s, d)),
        "SELECT DISTINCT op_id, entity_id, hlc.ts AS ts FROM oplog WHERE entity_id = (SELECT entity_id FROM oplog GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 1)",
    ),
    "src10_value_set": Query(lambda s, d: nodes(s, d, "kind").where(F.array_contains(files.value_set('["doc", "note"]'), F.col("kind"))).select("id"), q.with_(q.N) + "SELECT id FROM n WHERE kind IN ('doc', 'note')"),
    "src18_federation": Query(
        lambda s, d: files.federation([("project", nodes(s, d, "acl").where("acl = 'team'"), 1.0), ("personal", nodes(s, d, "acl").where("acl = 'private'"), 0.99)]).groupBy("source_name", "source_weight").agg(F.count("*").alias("n")),
        q.with_(q.N) + "SELECT CASE acl WHEN 'team' THEN 'project' ELSE 'personal' END AS source_name, CASE acl WHEN 'team' THEN 1.0::DOUBLE ELSE 0.99::DOUBLE END AS source_weight, count(*) AS n FROM n WHERE acl IN ('team', 'private') GROUP BY 1, 2",
    ),
    "snk1_appended": Query(lambda s, d: writes.new_ops(ops(s, d).where("seq <= 200"), ops(s, d)).select("op_id"), "SELECT DISTINCT op_id FROM oplog WHERE seq > 200"),
    "snk2_greatest": Query(
        lambda s, d: writes.upsert_greatest(ops(s, d).where("seq <= 200"), ops(s, d).where("seq > 200"), ["site_id"], "seq"), "SELECT site_id, max(seq) AS seq FROM oplog GROUP BY 1"
    ),
    "snk3_guarded": Query(
        lambda s, d: (lambda e: writes.upsert_last(e.where("weight < 0.5"), e.where("weight >= 0.5"), ["src", "type", "dst"], "weight", ["hlc", "site_id"]))(table(s, d, "edges").select("src", "type", "dst", "weight", "hlc", "site_id")).select("src", "type", "dst", "hlc", "site_id"),
        "SELECT src, type, dst, m.hlc AS hlc, m.site_id AS site_id FROM (SELECT src, type, dst, max({'hlc': hlc, 'site_id': site_id}) AS m FROM edges WHERE weight IS NOT NULL GROUP BY ALL)",
    ),
    "snk4_health": Query(_health, f"SELECT id, b AS state, CASE WHEN a = b THEN t ELSE {NOW_MS} END AS since FROM (SELECT id, arg_min(status, (hlc, site_id)) AS a, arg_min(created_at, (hlc, site_id)) AS t, arg_max(status, (hlc, site_id)) AS b FROM nodes GROUP BY 1)"),
    "snk5_set_operations": Query(lambda s, d: writes.set_ops(nodes(s, d, "title").where("title like 'Review%'").select("id", F.lit("status").alias("field"), F.lit("closed").alias("value")), "local", NOW_MS).select("entity_id", "field", "value"), q.with_(q.N) + "SELECT id AS entity_id, 'status' AS field, '\"closed\"' AS value FROM n WHERE title LIKE 'Review%'"),
    "snk6_edge_operations": Query(lambda s, d: writes.edge_ops(current_edges(table(s, d, "edges"), "weight", types=("blocks",)), "local", NOW_MS).select("entity_id", "op", "field"), q.with_(q.E) + "SELECT concat_ws('|', src, type, dst) AS entity_id, 'edge_add' AS op, type AS field FROM e WHERE type = 'blocks'"),
    "snk7_export_buckets": Query(lambda s, d: writes.bucketed(ops(s, d)).groupBy("site_id", "bucket").agg(F.count_distinct("op_id").alias("n")), "SELECT site_id, seq // 1000 AS bucket, count(DISTINCT op_id) AS n FROM oplog GROUP BY 1, 2"),
    "snk8_canonical_json": Query(lambda s, d: nodes(s, d, "attrs").select("id", writes.canonical_json(F.col("attrs")).alias("attrs"))),
    "snk9_file_union": Query(
        lambda s, d: writes.file_union(ops(s, d).where("seq % 2 = 0"), ops(s, d).where("seq % 3 = 0"), ops(s, d))[0].groupBy("op").agg(F.count("*").alias("n")), q.with_(_O) + "SELECT op, count(*) AS n FROM o GROUP BY 1"
    ),
    "snk10_compactable": Query(
        lambda s, d: writes.compactable(nodes(s, d, "kind", "status", "closed_at", "compacted_at"), current_edges(table(s, d, "edges"), "weight"), CUT).select("id"),
        q.with_(q.N, q.E) + f"SELECT id FROM n WHERE kind = 'task' AND status IN {q.CLOSED} AND closed_at < {CUT} AND compacted_at IS NULL AND id NOT IN (SELECT dst FROM e JOIN n r ON r.id = e.src WHERE e.type IN ('blocks', 'parent', 'relates') AND r.status NOT IN {q.CLOSED})",
    ),
    "snk11_prunable": Query(lambda s, d: writes.prunable_ops(ops(s, d), _peers(s), NOW_MS).select("op_id").distinct(), f"SELECT DISTINCT op_id FROM oplog WHERE hlc.ts < {NOW_MS - 30 * 86_400_000} AND op <> 'purge' AND seq <= 250"),
    "snk11_no_peers": Query(lambda s, d: writes.prunable_ops(ops(s, d), _peers(s).where("false"), NOW_MS).select("op_id").distinct(), "SELECT op_id FROM oplog WHERE false"),
    "snk12_evicted": Query(
        lambda s, d: writes.evicted(nodes(s, d, "accessed_at").withColumnRenamed("id", "node_id"), 500), q.with_(q.N) + "SELECT id AS node_id FROM n WHERE id NOT IN (SELECT id FROM n ORDER BY accessed_at DESC NULLS LAST, id LIMIT 500)"
    ),
    "snk13_donors": Query(_donors, q.with_(q.N) + "SELECT id, donor FROM n JOIN (SELECT content_hash, min(id) AS donor FROM n GROUP BY 1) USING (content_hash) WHERE id <> donor"),
    "fn6_hashes": Query(lambda s, d: nodes(s, d, "title").select("id", F.sha1("title").alias("s1"), F.sha2("title", 256).alias("s2")), q.with_(q.N) + "SELECT id, sha1(title) AS s1, sha256(title) AS s2 FROM n"),
    "fn9_packed_clock": Query(lambda s, d: ops(s, d).select("op_id", (F.shiftleft("hlc.ts", 16) + F.col("hlc.ctr")).alias("packed")).distinct(), "SELECT DISTINCT op_id, (hlc.ts << 16) + hlc.ctr AS packed FROM oplog"),
    "fn_canonical_ids": Query(
        lambda s, d: table(s, d, "edges").select("dst", canonical_id(F.col("dst")).alias("canon")).distinct(),
        r"SELECT DISTINCT dst, CASE WHEN regexp_matches(l, '^[a-z][a-z0-9]{1,7}-[0-9a-tv-z]{12}$') THEN split_part(l, '-', 1) || '-' || translate(right(l, 12), 'ilo', '110') ELSE l END AS canon FROM (SELECT dst, lower(regexp_replace(dst, '^\s+|\s+$', '', 'g')) AS l FROM edges)",
    ),
}
