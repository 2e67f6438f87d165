"""Queries that run a stream to its end; their SQL is that of the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import sqltext as q
from graphloom.plans.log import _CNT, _O
from graphloom.plans.registry import Query
from graphloom.sources.tables import table
from graphloom.staging import discard_at_exit, shared_root
from graphloom.streaming import log, timers


def _stream(s: SparkSession, d: str, name: str, merge: log.Merge) -> DataFrame:
    """The feed as five files in mixed order, of which each micro-batch reads one."""
    path = f"{shared_root(s)}/graphloom-{s.sparkContext.applicationId}/feed-{uuid.uuid4().hex}"
    table(s, d, "oplog").repartition(5, F.xxhash64("op_id", "arrived_at")).write.parquet(path)
    discard_at_exit(s, path)
    return log.merged(s, path, name, merge)


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


QUERIES = {
    "str1_offsets": Query(lambda s, d: table(s, d, "oplog").where("seq > 300").orderBy("site_id", "seq").select("site_id", "seq", "op_id").distinct(), "SELECT DISTINCT site_id, seq, op_id FROM oplog WHERE seq > 300"),
    "str2_site_watermarks": Query(lambda s, d: _stream(s, d, "marks", log.merge_watermarks), "SELECT site_id, max((hlc.ts << 16) + hlc.ctr) AS hlc FROM oplog GROUP BY 1"),
    "str3_parked": Query(
        lambda s, d: _stream(s, d, "parked", log.merge_parked).where("parked").select("op_id"),
        q.with_(_O) + "SELECT op_id FROM o WHERE op IN ('set', 'inc') AND entity_id NOT IN (SELECT entity_id FROM o WHERE op = 'set' AND field = 'kind')",
    ),
    "str4_unique": Query(lambda s, d: _stream(s, d, "unique", log.merge_unique), "SELECT DISTINCT op_id FROM oplog"),
    "str5_registers": Query(
        lambda s, d: _stream(s, d, "registers", log.merge_registers).select("entity_id", "field", "ts", "ctr", "site_id"),
        q.with_(_O) + "SELECT entity_id, field, m.ts AS ts, m.ctr AS ctr, m.s AS site_id FROM (SELECT entity_id, field, max({'ts': ts, 'ctr': ctr, 's': site_id}) AS m FROM o WHERE op = 'set' GROUP BY ALL)",
    ),
    "str5_counters": Query(lambda s, d: _stream(s, d, "counters", log.merge_counters).groupBy("entity_id", "field").agg(F.sum("v").alias("total")), q.with_(_O, _CNT) + "SELECT * FROM cnt"),
    "str10_exchange": Query(lambda s, d: _stream(s, d, "exchange", log.merge_delta).groupBy("site_id").agg(F.count("*").alias("n")), "SELECT site_id, count(DISTINCT op_id) AS n FROM oplog GROUP BY 1"),
    "str11_tumbling": Query(
        lambda s, d: timers.tumbling(_events(s, d)).withColumn("total", F.round("total", 4)), "SELECT epoch_ms(time_bucket(INTERVAL 1 hour, ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
    ),
    "str11_sessions": Query(
        lambda s, d: timers.sessions(_events(s, d)).select("user_id", "n", F.col("start_ms")),
        """SELECT user_id, count(*) AS n, epoch_us(min(ts)) // 1000 AS start_ms FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 hours THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g""",
    ),
}
