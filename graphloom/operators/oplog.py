"""Merging an operation log: registers, counters, edge sets, elections, deltas.

All merges are commutative, associative and idempotent, so they are plain
aggregations in any order; :func:`joined` merges two merged states the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.feed import current_state

#: Bits of the counter in a packed clock.
CLOCK_BITS = 16
SKEW_MS = 300_000


def packed(ts: Column, ctr: Column) -> Column:
    """A clock in one long, ordered like (ts, ctr)."""
    return F.shiftleft(ts, CLOCK_BITS) + ctr


def clock() -> Column:
    return F.struct(F.col("hlc.ts").alias("ts"), F.col("hlc.ctr").alias("ctr"), "site_id")


def unique(ops: DataFrame) -> DataFrame:
    """Each op_id once: of copies the one that arrived first."""
    rest = [c for c in ops.columns if c != "op_id"]
    first = ops.groupBy("op_id").agg(F.min_by(F.struct(*rest), F.struct("arrived_at", "value")).alias("r"))
    return first.select("op_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def registers(ops: DataFrame) -> DataFrame:
    """(entity_id, field, value, op_id) of the last writer of each field."""
    return ops.where("op = 'set'").groupBy("entity_id", "field").agg(F.max_by(F.struct("value", "op_id"), clock()).alias("w")).select("entity_id", "field", "w.value", "w.op_id")


def collisions(ops: DataFrame) -> DataFrame:
    """Equal clocks of one field with different values, and how many values."""
    return (
        ops.where("op = 'set'").groupBy("entity_id", "field", F.col("hlc.ts").alias("ts"), F.col("hlc.ctr").alias("ctr"), "site_id").agg(F.count_distinct("value").alias("n")).where("n > 1")
    )


def counters(ops: DataFrame) -> DataFrame:
    """(entity_id, field, total): the greatest total of each site, summed."""
    sites = ops.where("op = 'inc'").groupBy("entity_id", "field", "site_id").agg(F.max(F.expr("try_cast(value AS BIGINT)")).alias("v"))
    return sites.groupBy("entity_id", "field").agg(F.sum("v").alias("total"))


def tombstones(ops: DataFrame) -> DataFrame:
    """(entity_id, tag, gone_at): removed tags and when they were last removed."""
    rows = ops.where("op = 'edge_del'").select("entity_id", F.explode(F.from_json(F.get_json_object("value", "$.tags"), "array<string>")).alias("tag"), F.col("hlc.ts").alias("ts"))
    return rows.groupBy("entity_id", "tag").agg(F.max("ts").alias("gone_at"))


def projected_edges(ops: DataFrame) -> DataFrame:
    """Per edge its representative addition, weight, first instant, and removal if no tag is left.

    The representative is the latest addition among live tags, else among all.
    """
    adds = ops.where("op = 'edge_add'").select(
        "entity_id", F.coalesce(F.get_json_object("value", "$.tag"), "op_id").alias("tag"), F.get_json_object("value", "$.weight").cast("double").alias("weight"), F.col("hlc.ts").alias("ts"), F.col("hlc.ctr").alias("ctr"), "site_id"
    )
    marked = adds.join(tombstones(ops), ["entity_id", "tag"], "left").withColumn("live", F.col("gone_at").isNull())
    best = F.max_by(F.struct("tag", "weight"), F.struct("live", "ts", "ctr", "site_id", "tag"))
    return marked.groupBy("entity_id").agg(
        best.alias("b"), F.min("ts").alias("created_at"), F.when(~F.bool_or("live"), F.max("gone_at")).alias("deleted_at")
    ).select("entity_id", F.col("b.tag").alias("tag"), F.coalesce("b.weight", F.lit(1.0)).alias("weight"), "created_at", "deleted_at")


def joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Registers of two replicas, (entity_id, field, value, ts, ctr, site_id), merged."""
    top = a.unionByName(b).groupBy("entity_id", "field").agg(F.max_by("value", F.struct("ts", "ctr", "site_id", "value")).alias("value"), F.max(F.struct("ts", "ctr", "site_id")).alias("c"))
    return top.select("entity_id", "field", "value", "c.ts", "c.ctr", "c.site_id")


def replica(ops: DataFrame) -> DataFrame:
    """Registers with their clocks, as one replica holds them."""
    top = ops.where("op = 'set'").groupBy("entity_id", "field").agg(F.max_by("value", clock()).alias("value"), F.max(clock()).alias("c"))
    return top.select("entity_id", "field", "value", "c.ts", "c.ctr", "c.site_id")


def snapshot(ops: DataFrame) -> DataFrame:
    """A hash of the whole state of each entity, the same for every order of arrival.

    Hashes of the parts are added up, so that no entity's parts are gathered.
    """
    line = F.xxhash64("field", "what", "result").cast("decimal(38,0)")
    return current_state(ops).groupBy("entity_id").agg(F.count("*").alias("parts"), F.sum(line).cast("string").alias("digest"))


def watermarks(ops: DataFrame) -> DataFrame:
    """(site_id, hlc): the greatest packed clock of each site."""
    return ops.groupBy("site_id").agg(F.max(packed(F.col("hlc.ts"), F.col("hlc.ctr"))).alias("hlc"))


def delta(ops: DataFrame, known: DataFrame) -> DataFrame:
    """Operations newer than a peer's watermark of their site, or of sites it doesn't know."""
    stamped = ops.withColumn("packed", packed(F.col("hlc.ts"), F.col("hlc.ctr")))
    w = known.select("site_id", F.col("hlc").alias("seen"))
    return stamped.join(w, "site_id", "left").where(F.col("packed") > F.coalesce("seen", F.lit(-1))).drop("seen")


def next_batch(ops: DataFrame, size: Column, rows: int = 1000, most: int = 4 << 20) -> DataFrame:
    """(op_id, place, bytes, more): the next operations for a peer, by clock, site and op_id.

    At most so many rows, and so many bytes together unless the first operation
    alone has more; ``more`` says whether any are left.  One row beyond the bound
    is looked at, so that the sums run over a bounded set.
    """
    order = ["at", "site_id", "op_id"]
    first = ops.select("op_id", "site_id", packed(F.col("hlc.ts"), F.col("hlc.ctr")).alias("at"), size.cast("long").alias("size")).orderBy(*order).limit(rows + 1)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    summed = first.withColumns({"place": F.row_number().over(w), "bytes": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.count("*").over(Window.partitionBy(F.lit(0)))})
    kept = summed.where((F.col("place") <= rows) & ((F.col("bytes") <= most) | (F.col("place") == 1)))
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    return kept.withColumn("more", n < F.col("all")).select("op_id", "place", "bytes", "more")


def purged(ops: DataFrame) -> DataFrame:
    return ops.where("op = 'purge'").select("entity_id").distinct()


def without_purged(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows whose entity, or either end of whose edge, was never purged."""
    dead = purged(ops)
    out = rows.join(dead, "entity_id", "left_anti")
    for part in (1, -1):
        end = F.when(F.col("entity_id").contains("|"), F.substring_index("entity_id", "|", part))
        out = out.withColumn("_end", end).join(dead.withColumnRenamed("entity_id", "_end"), "_end", "left_anti").drop("_end")
    return out


def parked(ops: DataFrame) -> DataFrame:
    """Operations of entities that nothing in the log has created (no ``kind`` was ever set)."""
    born = ops.where("op = 'set' and field = 'kind'").select("entity_id").distinct()
    return ops.where("op in ('set', 'inc')").join(born, "entity_id", "left_anti")


def materialised(ops: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row per created entity from the winners of its fields; attrs.* keys are kept as a map."""
    won = without_purged(registers(ops), ops)
    fields = [F.max(F.when(F.col("field") == c, F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"))).alias(c) for c in columns]
    rows = won.groupBy("entity_id").agg(*fields, F.count_if(F.col("field").startswith("attrs.")).alias("n_attrs"))
    return rows.where("kind is not null")


def election(rows: DataFrame, keys: list[str], born: list[str]) -> DataFrame:
    """Per key the oldest birth wins (null births last); the others are demoted to ``key:id``."""
    order = F.struct(*(x for c in born for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))), "id")
    first = rows.groupBy(*keys).agg(F.min_by("id", order).alias("winner"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, keys).withColumn("demoted", F.when(F.col("id") != F.col("winner"), F.concat(keys[-1], F.lit(":"), "id")))


def three_way(snapshot_rows: DataFrame, local: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """What to do with each value: sync, apply, keep or conflict; nulls compare as values."""
    both = snapshot_rows.withColumnRenamed("value", "s").join(local.withColumnRenamed("value", "l"), keys, "full").join(baseline.withColumnRenamed("value", "b").withColumn("known", F.lit(True)), keys, "left")
    s, l, b = F.col("s"), F.col("l"), F.col("b")
    act = F.when(s.eqNullSafe(l), "sync").when(F.col("known").isNull(), "apply").when(s.eqNullSafe(b), "keep").when(l.eqNullSafe(b), "apply").otherwise("conflict")
    return both.select(*keys, act.alias("action"))


def ticks(ops: DataFrame, site: str, wall: str, order: str) -> DataFrame:
    """``ops`` with the clock (ts, ctr) of a site that ticks at each of its own operations in order.

    The closed form of :func:`ticked` without received clocks: the greatest wall
    time so far, and how many operations have had it.
    """
    so_far = Window.partitionBy(site).orderBy(wall, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ops.withColumn("ts", F.max(wall).over(so_far))
    return rows.withColumn("ctr", F.row_number().over(Window.partitionBy(site, "ts").orderBy(wall, order)) - 1)


def ticked(times: list[tuple[int, tuple[int, int] | None]], start: tuple[int, int] = (0, 0)) -> list[tuple[int, int]]:
    """The clocks of one site for a sequence of (wall time, received clock or None).

    A received clock further ahead than the allowed skew counts with the skew; a
    counter of more than 16 bits is an error.
    """
    ts, ctr, out = *start, []
    for wall, got in times:
        if got is not None:
            g_ts, g_ctr = (got[0], got[1]) if got[0] <= wall + SKEW_MS else (wall + SKEW_MS, 0)
            top = max(wall, ts, g_ts)
            ctr = max(ctr, g_ctr) + 1 if top == ts == g_ts else ctr + 1 if top == ts else g_ctr + 1 if top == g_ts else 0
            ts = top
        elif wall > ts:
            ts, ctr = wall, 0
        else:
            ctr += 1
        if ctr >= 1 << CLOCK_BITS:
            raise OverflowError("the clock's counter is full")
        out.append((ts, ctr))
    return out
