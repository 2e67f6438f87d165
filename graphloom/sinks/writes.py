"""Appends, upserts, exports and maintenance of the store's tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from graphloom.constants import CLOSED, DAY_MS, STATUSES
from graphloom.operators.numbering import numbered

BUCKET = 1000


def new_ops(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Operations of a batch that the log doesn't have, each once."""
    from graphloom.operators.oplog import unique

    return unique(batch).join(stored.select("op_id"), "op_id", "left_anti")


def upsert_greatest(stored: DataFrame, batch: DataFrame, keys: list[str], value: str) -> DataFrame:
    return stored.select(*keys, value).unionByName(batch.select(*keys, value)).groupBy(*keys).agg(F.max(value).alias(value))


def upsert_last(stored: DataFrame, batch: DataFrame, keys: list[str], value: str, clock: list[str]) -> DataFrame:
    """The value of the greatest clock; an equal clock keeps what is stored."""
    both = stored.withColumn("_s", F.lit(1)).unionByName(batch.withColumn("_s", F.lit(0)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(value, *clock), F.struct(*clock, "_s")).alias("r")).select(*keys, "r.*")


def upsert_health(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """States with ``since``, which stays while the state does."""
    old = stored.select(key, F.col("state").alias("s0"), F.col("since").alias("t0"))
    both = old.join(batch.select(key, F.col("state").alias("s1"), F.col("since").alias("t1")), key, "full")
    return both.select(key, F.coalesce("s1", "s0").alias("state"), F.when(F.col("s1").isNull() | (F.col("s0") == F.col("s1")), F.coalesce("t0", "t1")).otherwise(F.col("t1")).alias("since"))


def set_ops(patches: DataFrame, site: str, ts: int) -> DataFrame:
    """Operations that set the fields of (id, field, value) patches, numbered in order."""
    n = F.col("_n")
    return numbered(patches.select("id", "field", "value"), "id", "field", name="_n").select(
        F.concat(F.lit(f"{site}:"), n).alias("op_id"), n.cast("long").alias("seq"), F.struct(F.lit(ts).cast("long").alias("ts"), (n - 1).cast("int").alias("ctr")).alias("hlc"), F.lit(site).alias("site_id"), F.col("id").alias("entity_id"), F.lit("set").alias("op"), "field", F.to_json(F.array("value")).substr(F.lit(2), F.length(F.to_json(F.array("value"))) - 2).alias("value")
    )


def edge_ops(edges: DataFrame, site: str, ts: int, remove: bool = False) -> DataFrame:
    """Operations that add (src, type, dst) with a fresh tag, or remove the given ``tags``."""
    n = F.col("_n")
    op_id = F.concat(F.lit(f"{site}:"), n)
    value = F.to_json(F.struct(F.col("tags"))) if remove else F.to_json(F.struct(op_id.alias("tag")))
    return numbered(edges, "src", "type", "dst", name="_n").select(op_id.alias("op_id"), F.struct(F.lit(ts).cast("long").alias("ts"), (n - 1).cast("int").alias("ctr")).alias("hlc"), F.lit(site).alias("site_id"), F.concat_ws("|", "src", "type", "dst").alias("entity_id"), F.lit("edge_del" if remove else "edge_add").alias("op"), F.col("type").alias("field"), value.alias("value"))


def removed(ids: DataFrame, site: str, ts: int) -> DataFrame:
    """Operations that delete records: ``deleted_at`` is set to the instant."""
    return set_ops(ids.select("id", F.lit("deleted_at").alias("field"), F.lit(ts).cast("long").alias("value")), site, ts)


def restored(ids: DataFrame, site: str, ts: int) -> DataFrame:
    """Operations that bring deleted records back: ``deleted_at`` is set to null."""
    return set_ops(ids.select("id", F.lit("deleted_at").alias("field"), F.lit(None).cast("long").alias("value")), site, ts)


def purge_ops(ids: DataFrame, site: str, ts: int) -> DataFrame:
    """Operations that erase records for good."""
    n = F.col("_n")
    return numbered(ids.select("id"), "id", name="_n").select(
        F.concat(F.lit(f"{site}:"), n).alias("op_id"), n.cast("long").alias("seq"), F.struct(F.lit(ts).cast("long").alias("ts"), (n - 1).cast("int").alias("ctr")).alias("hlc"), F.lit(site).alias("site_id"),
        F.col("id").alias("entity_id"), F.lit("purge").alias("op"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"),
    )


def bucketed(ops: DataFrame) -> DataFrame:
    return ops.withColumn("bucket", F.floor(F.col("seq") / BUCKET).cast("long"))


def export_log(ops: DataFrame, path: str) -> None:
    """JSON lines per site and bucket of a thousand sequence numbers, in order within a file."""
    rows = bucketed(ops).repartition("site_id", "bucket").sortWithinPartitions("site_id", "bucket", "seq")
    rows.write.partitionBy("site_id", "bucket").mode("overwrite").json(path)


def export_nodes(nodes: DataFrame, path: str) -> None:
    """The projection by the first character of the id's body."""
    first = F.substring(F.substring_index("id", "-", -1), 1, 1)
    nodes.withColumn("part", first).repartition("part").write.partitionBy("part").mode("overwrite").json(path)


@pandas_udf(T.StringType())
def _canonical(s):  # noqa: ANN001, ANN202
    return s.map(lambda x: None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def canonical_json(c: Column) -> Column:
    """JSON with keys sorted at every level and no blanks."""
    return _canonical(c)


def file_union(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All operations once, and the op_ids that have different contents."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    payload = F.struct("site_id", "entity_id", "op", "field", F.regexp_replace("value", r"\s", "").alias("value"))
    clash = every.groupBy("op_id").agg(F.count_distinct(payload).alias("n")).where("n > 1")
    return every.dropDuplicates(["op_id"]), clash.select("op_id")


def compactable(nodes: DataFrame, edges: DataFrame, before: int) -> DataFrame:
    """Tasks closed before an instant and not yet compacted that no blocks, parent or relates edge of an unfinished record points to."""
    busy = nodes.where(~F.col("status").isin(*CLOSED)).select(F.col("id").alias("src"))
    held = edges.where("type in ('blocks', 'parent', 'relates')").join(busy, "src").select(F.col("dst").alias("id"))
    old = nodes.where((F.col("kind") == "task") & F.col("status").isin(*CLOSED) & (F.col("closed_at") < before) & F.col("compacted_at").isNull())
    return old.join(held, "id", "left_anti")


def prunable_ops(ops: DataFrame, peers: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Old operations that all peers have; purges stay, and without peers nothing goes."""
    least = peers.agg(F.min("last_seq_sent").alias("least"))
    old = ops.where((F.col("hlc.ts") < now_ms - days * DAY_MS) & (F.col("op") != "purge"))
    return old.join(F.broadcast(least)).where("seq <= least").drop("least")


def evicted(cache: DataFrame, keep: int, key: str = "node_id") -> DataFrame:
    """Entries beyond the ``keep`` last accessed ones."""
    kept = cache.orderBy(F.desc("accessed_at"), key).limit(keep).select(key)
    return cache.join(kept, key, "left_anti").select(key)


def donors(missing: DataFrame, live: DataFrame) -> DataFrame:
    """(id, donor): for each record without a vector the smallest live record of equal content."""
    first = live.groupBy("content_hash").agg(F.min("id").alias("donor"))
    return missing.join(first, "content_hash").where("id <> donor").select("id", "donor")


def birth_ops(rows: DataFrame, site: str, ts: int, owner: str, actor: str, allowed: tuple[str, ...] = ("kind", "scope", "title", "body", "status", "priority")) -> DataFrame:
    """Operations that create records: allowed fields only, owner and actor forced, a status valid for the kind.

    A status the kind doesn't have becomes its first one; null fields aren't set.
    """
    valid = F.coalesce(*(F.when((F.col("kind") == k) & ~F.col("status").isin(*s), F.lit(s[0])) for k, s in STATUSES.items()), F.col("status"))
    forced = rows.withColumn("status", valid).withColumns({"owner_id": F.lit(owner), "actor": F.lit(actor)})
    fields = [*(c for c in allowed if c in rows.columns), "owner_id", "actor"]
    long = forced.select("id", *(F.col(c).cast("string").alias(c) for c in fields)).unpivot(["id"], fields, "field", "value")
    return set_ops(long.where("value is not null"), site, ts)
