"""Queries of the kinds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.ids import prefix_range
from graphloom.operators import intervals
from graphloom.operators.current import current_edges, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table


def nodes(s: SparkSession, d: str, *c: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes"), *c)


def edges(s: SparkSession, d: str, *types: str) -> DataFrame:
    return current_edges(table(s, d, "edges"), "weight", "created_at", types=types)


def _twins(s: SparkSession, d: str, key) -> DataFrame:
    """Ids that share a content hash with a smaller one; hot hashes are reduced to their first id."""
    n = nodes(s, d, "scope", "kind", "content_hash", "attrs").select("id", "scope", "kind", key.alias("h")).where("h is not null and h <> ''")
    first = n.groupBy("scope", "kind", "h").agg(F.min("id").alias("winner"), F.count("*").alias("n")).where("n > 1")
    return n.join(first, ["scope", "kind", "h"]).where("id <> winner").select(F.col("id").alias("loser"), "winner")


def _twins_sql(h: str) -> str:
    return q.with_(q.N, f"t AS (SELECT id, scope, kind, {h} AS h FROM n)") + "SELECT id AS loser, winner FROM (SELECT id, h, min(id) OVER (PARTITION BY scope, kind, h) AS winner FROM t WHERE h IS NOT NULL AND h <> '') WHERE id <> winner"


# spans: a document's lines as spans of 40 characters per sentence number
def _spans(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "events")
    return v.select(F.col("user_id"), F.col("event_id"), (F.col("event_id") % 900).cast("long").alias("start"), (F.col("event_id") % 900 + F.floor("value") % 50).cast("long").alias("end"))


_SPANS = "sp AS (SELECT user_id, event_id, event_id % 900 AS s, event_id % 900 + CAST(floor(value) AS BIGINT) % 50 AS t FROM events)"


def _points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").where("event_type = 'error'").select("user_id", F.col("event_id").alias("p_id"), (F.col("event_id") * 7 % 900).alias("at_line"))


_POINTS = "pt AS (SELECT user_id, event_id AS p_id, event_id * 7 % 900 AS at_line FROM events WHERE event_type = 'error')"


def _typed(s: SparkSession, d: str, kind: str) -> DataFrame:
    return table(s, d, "events").where(F.col("event_type") == kind).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")


def _typed_sql(kind: str) -> str:
    return f"(SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events WHERE event_type = '{kind}')"


def _asof(s: SparkSession, d: str, fallback: bool) -> DataFrame:
    views = _typed(s, d, "view").groupBy("user_id", "t").agg(F.max_by("value", "event_id").alias("value"))
    out = intervals.as_of(_typed(s, d, "purchase").select("user_id", "event_id", "t"), views, "user_id", "t", "t", ["value"], fallback)
    return out.select("event_id", "user_id", F.col("asof_value").alias("price"), F.col("asof_t").alias("valid_from"))


def _frozen(s: SparkSession, d: str) -> DataFrame:
    """Purchases with the instant of the price that held, frozen when they were made, looked up again by exactly that instant; a third have one that no price has."""
    kept = _asof(s, d, False).join(_typed(s, d, "purchase").select("event_id", "t"), "event_id")
    kept = kept.select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("t") + 1).otherwise(F.col("valid_from")).alias("valid_from"))
    prices = _typed(s, d, "view").groupBy("user_id", F.col("t").alias("valid_from")).agg(F.max_by("value", "event_id").alias("price"))
    return kept.join(prices, ["user_id", "valid_from"], "left").select("event_id", "price")


_VIEWS = f"vw AS (SELECT user_id, t, arg_max(value, event_id) AS value FROM {_typed_sql('view')} GROUP BY ALL)"


def _lag(s: SparkSession, d: str) -> DataFrame:
    """Per operation the last earlier instant of the same site."""
    o = table(s, d, "oplog").select("op_id", "site_id", F.col("hlc.ts").alias("ts")).distinct()
    w = Window.partitionBy("site_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    return o.withColumn("previous", F.max("ts").over(w)).select("op_id", "previous")


_ROOTS = ("kiln/", "harbor/c", "vellum/", "lantern/api", "none/")


def _prefix(s: SparkSession, d: str) -> DataFrame:
    """Records whose repository lies under each of stated prefixes, of any length, by key ranges."""
    n = nodes(s, d, "attrs").select("id", F.get_json_object("attrs", "$.repo").alias("repo")).where("repo is not null")
    roots = s.createDataFrame([(r, *prefix_range(r)) for r in _ROOTS], "root string, low string, high string")
    return n.join(F.broadcast(roots), (F.col("repo") >= F.col("low")) & (F.col("repo") < F.col("high"))).select("id", "root")


_ATTR_TAGS = "CASE WHEN json_type(attrs, '$.tags') = 'ARRAY' THEN CAST(json_extract(attrs, '$.tags') AS VARCHAR[]) END"


def _family(s: SparkSession, d: str) -> DataFrame:
    """Ancestors times descendants of one record: two small stated sets."""
    from graphloom.operators import hierarchy

    e = table(s, d, "edges")
    up = hierarchy.descendants(hierarchy.hierarchies(hierarchy.parent_links(e))).drop("link")
    pick = up.join(up.select(F.col("id").alias("ancestor")).distinct(), "ancestor").groupBy("ancestor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ancestor").limit(1).select(F.col("ancestor").alias("mid"))
    above = up.join(F.broadcast(pick), up.id == F.col("mid")).select("ancestor", F.col("distance").alias("a"))
    below = up.join(F.broadcast(pick), up.ancestor == F.col("mid")).select("id", F.col("distance").alias("b"))
    return below.crossJoin(F.broadcast(above)).select("ancestor", F.col("id").alias("descendant"), (F.col("a") + F.col("b")).alias("depth"))


QUERIES = {
    "jn1_inner": Query(lambda s, d: edges(s, d).join(nodes(s, d, "kind"), F.col("dst") == F.col("id")).select("src", "type", "dst", "kind"), q.with_(q.N, q.E) + "SELECT src, type, dst, kind FROM e JOIN n ON dst = id"),
    "jn2_both_ends": Query(
        lambda s, d: edges(s, d).join(nodes(s, d, "kind").select(F.col("id").alias("src"), F.col("kind").alias("from_kind")), "src").join(nodes(s, d, "kind").select(F.col("id").alias("dst"), F.col("kind").alias("to_kind")), "dst").groupBy("from_kind", "type", "to_kind").agg(F.count("*").alias("n")),
        q.with_(q.N, q.E) + "SELECT a.kind AS from_kind, e.type, b.kind AS to_kind, count(*) AS n FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst GROUP BY ALL",
    ),
    "jn3_left": Query(
        lambda s, d: nodes(s, d, "kind").join(edges(s, d, "parent").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("children")), "id", "left").select("id", "children"),
        q.with_(q.N, q.E) + "SELECT id, c AS children FROM n LEFT JOIN (SELECT dst, count(*) AS c FROM e WHERE type = 'parent' GROUP BY 1) ON dst = id",
    ),
    "jn4_semi": Query(lambda s, d: nodes(s, d).select("id").join(edges(s, d, "blocks").select(F.col("src").alias("id")), "id", "left_semi"), q.with_(q.N, q.E) + "SELECT id FROM n WHERE EXISTS (SELECT 1 FROM e WHERE src = n.id AND type = 'blocks')"),
    "jn5_anti": Query(lambda s, d: nodes(s, d).select("id").join(edges(s, d).select(F.col("dst").alias("id")), "id", "left_anti"), q.with_(q.N, q.E) + "SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE dst = n.id)"),
    "jn6_content_twins": Query(lambda s, d: _twins(s, d, F.lower(F.substring_index("content_hash", ":", 1))), _twins_sql("lower(split_part(content_hash, ':', 1))")),
    "jn7_external_twins": Query(lambda s, d: _twins(s, d, F.coalesce(F.get_json_object("attrs", "$.external_ref"), F.get_json_object("attrs", "$.repo"))), _twins_sql(f"coalesce({q.attr('external_ref')}, {q.attr('repo')})")),
    "jn8_point_in_span": Query(
        lambda s, d: intervals.containing(_points(s, d), _spans(s, d), "user_id", "at_line", "start", "end").groupBy("p_id").agg(F.count("*").alias("n"), F.min(F.col("end") - F.col("start")).alias("shortest")),
        q.with_(_SPANS, _POINTS) + "SELECT p_id, count(*) AS n, min(t - s) AS shortest FROM pt JOIN sp USING (user_id) WHERE at_line BETWEEN s AND t GROUP BY 1",
    ),
    "jn9_span_overlap": Query(
        lambda s, d: intervals.overlapping(_spans(s, d), _spans(s, d), "user_id", "start", "end").groupBy("event_id").agg(F.count("*").alias("n")),
        q.with_(_SPANS) + "SELECT a.event_id, count(*) AS n FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.s <= b.t AND b.s <= a.t GROUP BY 1",
    ),
    "jn10_smallest_span": Query(
        lambda s, d: intervals.smallest_containing(_points(s, d), _spans(s, d).groupBy("user_id", "start", "end").agg(F.min("event_id").alias("event_id")), "user_id", "at_line", "start", "end").select("p_id", "event_id"),
        q.with_(_SPANS, _POINTS) + "SELECT p_id, event_id FROM (SELECT p_id, event_id, row_number() OVER (PARTITION BY p_id ORDER BY t - s, s DESC, event_id) rn FROM pt JOIN sp USING (user_id) WHERE at_line BETWEEN s AND t) WHERE rn = 1",
    ),
    "jn11_prefix": Query(_prefix, q.with_(q.N) + f"SELECT id, root FROM n JOIN (VALUES {', '.join(f"('{r}')" for r in _ROOTS)}) t(root) ON starts_with({q.attr('repo')}, root)"),
    "jn12_as_of": Query(lambda s, d: _asof(s, d, False), q.with_(_VIEWS) + f"SELECT event_id, p.user_id, vw.value AS price, vw.t AS valid_from FROM {_typed_sql('purchase')} p ASOF LEFT JOIN vw ON p.user_id = vw.user_id AND p.t >= vw.t"),
    "jn13_as_of_or_first": Query(
        lambda s, d: _asof(s, d, True),
        q.with_(_VIEWS, "f AS (SELECT user_id, min(t) AS ft, arg_min(value, t) AS fv FROM vw GROUP BY 1)")
        + f"SELECT event_id, p.user_id, coalesce(vw.value, fv) AS price, coalesce(vw.t, ft) AS valid_from FROM {_typed_sql('purchase')} p ASOF LEFT JOIN vw ON p.user_id = vw.user_id AND p.t >= vw.t LEFT JOIN f ON f.user_id = p.user_id",
    ),
    "jn14_frozen_key": Query(
        _frozen,
        q.with_(_VIEWS) + f"""SELECT event_id, vw.value AS price FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN t + 1 ELSE (SELECT max(v.t) FROM vw v WHERE v.user_id = p0.user_id AND v.t <= p0.t) END AS valid_from
        FROM {_typed_sql('purchase')} p0) p LEFT JOIN vw ON vw.user_id = p.user_id AND vw.t = p.valid_from""",
    ),
    "jn15_session_lag": Query(_lag, "SELECT op_id, max(ts) OVER (PARTITION BY site_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM (SELECT DISTINCT op_id, site_id, hlc.ts AS ts FROM oplog)"),
    "jn16_seed_join": Query(
        lambda s, d: edges(s, d).join(F.broadcast(nodes(s, d, "salience").orderBy(F.desc("salience"), "id").limit(50).select(F.col("id").alias("src"))), "src").select("src", "type", "dst"),
        q.with_(q.N, q.E) + "SELECT src, type, dst FROM e WHERE src IN (SELECT id FROM n ORDER BY salience DESC, id LIMIT 50)",
    ),
    "jn18_json_table": Query(
        lambda s, d: nodes(s, d, "attrs").select("id", F.explode(F.from_json(F.get_json_object("attrs", "$.tags"), "array<string>")).alias("tag")).join(s.createDataFrame([("crdt", 1), ("ui", 2)], "tag string, w int"), "tag").select("id", "tag", "w"),
        q.with_(q.N) + f"SELECT id, tag, w FROM (SELECT id, unnest({_ATTR_TAGS}) AS tag FROM n) JOIN (VALUES ('crdt', 1), ('ui', 2)) v(tag, w) USING (tag)",
    ),
    "jn20_small_product": Query(_family),
}
