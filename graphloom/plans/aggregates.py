"""Queries of aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.constants import NOW_MS
from graphloom.operators import attribution as at
from graphloom.operators.current import attribute, current_edges, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table


def nodes(s: SparkSession, d: str, *c: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes"), *c)


def edges(s: SparkSession, d: str, *types: str) -> DataFrame:
    return current_edges(table(s, d, "edges"), "weight", types=types)


def _tags():
    return F.coalesce(F.from_json(attribute("tags"), "array<string>"), F.array().cast("array<string>"))


_TAGS = "CASE WHEN json_type(attrs, '$.tags') = 'ARRAY' THEN CAST(json_extract(attrs, '$.tags') AS VARCHAR[]) ELSE [] END"


# Tags stand for caveats by their length.
_CAVEATS = ("coordinator_fixed", "tests_weak", "report_inaccurate", "scope_missed", "unheard_of")
_COSTS = (0.35, 0.4, 0.25, 0.3, 0.0)


def _caveat(tag):
    return F.element_at(F.array(*map(F.lit, _CAVEATS)), (F.length(tag) % 5 + 1).cast("int"))


# a task is an attempt: its site the model, its access the effort, its tags the caveats
def attempts(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "kind", "status", "attrs", "site_id", "acl", "salience", "created_at", "closed_at").where("kind = 'task'")
    verdict = F.when(F.col("status") == "closed", "accepted").when(F.col("status").isin("blocked", "in_progress"), "rework").when(F.col("status") == "cancelled", "rejected")
    return n.select("id", F.coalesce(attribute("type"), F.lit("task")).alias("task_class"), F.col("site_id").alias("model_id"), F.col("acl").alias("effort"), verdict.alias("verdict"), F.transform(_tags(), _caveat).alias("caveats"), F.col("salience").alias("cost_usd")).where("verdict is not null")


_ATT = f"""att AS (SELECT id, coalesce({q.attr('type')}, 'task') AS task_class, site_id AS model_id, acl AS effort, CASE status WHEN 'closed' THEN 'accepted' WHEN 'cancelled' THEN 'rejected' ELSE 'rework' END AS verdict,
  list_distinct(list_transform({_TAGS}, lambda x: length(x) % 5)) AS caveats, salience AS cost_usd FROM n WHERE kind = 'task' AND status IN ('closed', 'blocked', 'in_progress', 'cancelled')),
qa AS (SELECT *, CASE WHEN verdict = 'rejected' THEN 0.0::DOUBLE ELSE greatest(0.1::DOUBLE, (CASE verdict WHEN 'accepted' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) - coalesce(list_sum(list_transform(caveats, lambda x: ({list(_COSTS)})[x + 1]::DOUBLE)), 0)) END AS q FROM att)"""


def _r(df: DataFrame, *c: str) -> DataFrame:
    return df.withColumns({x: F.round(x, 6) for x in c})


def _arms(s: SparkSession, d: str) -> DataFrame:
    return at.arms(attempts(s, d))


_ARMS = "SELECT task_class, model_id, effort, count(*) AS n, round(sum(q), 6) AS total, round(avg(q), 6) AS mean, round(avg(cost_usd), 6) AS mean_cost, round(sum(cost_usd), 6) AS cost, 1.0::DOUBLE AS coverage, round(avg(CASE WHEN len(caveats) = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS clean, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'rework') AS rework, count(*) FILTER (verdict = 'rejected') AS rejected FROM qa GROUP BY 1, 2, 3"


def _usage(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "events").select(F.floor(F.col("event_id") / 3).alias("message"), F.floor("value").cast("long").alias("input"), F.get_json_object("props", "$.k").cast("long").alias("output"))
    return at.usage(m, "message", ("input", "output"))


def _agree(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "kind", "attrs", "scope", "layer")
    rows = n.select(F.concat_ws(":", F.coalesce(attribute("type"), F.lit("unknown")), F.substring_index("scope", "-", -1)).alias("p"), F.concat_ws(":", "kind", F.substring_index("scope", "-", -1)).alias("a"))
    return at.agreement(rows, "p", "a")


def _percentiles(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy("event_type")
    return e.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))))


def _top(s: SparkSession, d: str, order, k: int, *cols: str) -> DataFrame:
    return nodes(s, d, *cols).orderBy(*order).limit(k).select("id", *cols)


_ids = q.with_(q.N)
_SUFFIX = "regexp_extract(scope, '-([^-]*)$', 1)"

QUERIES = {
    "agg1_task_counts": Query(
        lambda s, d: nodes(s, d, "kind", "status", "open_blockers").where("kind = 'task'").agg(F.count_if((F.col("status") == "open") & (F.col("open_blockers") == 0)).alias("ready"), F.count_if((F.col("status") == "open") & (F.col("open_blockers") > 0)).alias("blocked"), F.count_if(F.col("status") == "in_progress").alias("working")),
        _ids + "SELECT count(*) FILTER (status = 'open' AND open_blockers = 0) AS ready, count(*) FILTER (status = 'open' AND open_blockers > 0) AS blocked, count(*) FILTER (status = 'in_progress') AS working FROM n WHERE kind = 'task'",
    ),
    "agg2_reach_sums": Query(
        lambda s, d: nodes(s, d, "layer", "attrs").groupBy("layer").agg(F.sum(F.when(attribute("reach") == "project", 1).otherwise(0)).alias("project"), F.sum(F.when(attribute("repo").isNull(), 1).otherwise(0)).alias("no_repo")),
        _ids + f"SELECT layer, CAST(sum(CASE WHEN {q.attr('reach')} = 'project' THEN 1 ELSE 0 END) AS BIGINT) AS project, CAST(sum(CASE WHEN {q.attr('repo')} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_repo FROM n GROUP BY 1",
    ),
    "agg5_multi_parent": Query(lambda s, d: edges(s, d, "parent").groupBy("src").agg(F.count("*").alias("n")).where("n > 1"), q.with_(q.E) + "SELECT src, count(*) AS n FROM e WHERE type = 'parent' GROUP BY 1 HAVING count(*) > 1"),
    "agg7_distinct": Query(lambda s, d: nodes(s, d, "scope", "kind", "owner_id").groupBy("scope").agg(F.count_distinct("kind").alias("kinds"), F.count_distinct("owner_id").alias("owners")), _ids + "SELECT scope, count(DISTINCT kind) AS kinds, count(DISTINCT owner_id) AS owners FROM n GROUP BY 1"),
    "agg8_joined_tags": Query(
        lambda s, d: nodes(s, d, "scope", "attrs").select("scope", F.explode(_tags()).alias("tag")).distinct().groupBy("scope").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags")),
        _ids + f"SELECT scope, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT scope, unnest({_TAGS}) AS tag FROM n) GROUP BY 1",
    ),
    "agg9_json_array": Query(
        lambda s, d: nodes(s, d, "kind", "status").select("kind", "status").distinct().groupBy("kind").agg(F.to_json(F.sort_array(F.collect_list("status"))).alias("statuses")),
        _ids + "SELECT kind, CAST(to_json(list(status ORDER BY status)) AS VARCHAR) AS statuses FROM (SELECT DISTINCT kind, status FROM n) GROUP BY 1",
    ),
    "agg12_health": Query(lambda s, d: nodes(s, d, "kind", "status", "actor").groupBy("kind", "status", "actor").agg(F.count("*").alias("n")), _ids + "SELECT kind, status, actor, count(*) AS n FROM n GROUP BY ALL"),
    "agg13_workspaces": Query(lambda s, d: nodes(s, d, "scope", "created_at").groupBy("scope").agg(F.count("*").alias("n"), F.max("created_at").alias("latest")), _ids + "SELECT scope, count(*) AS n, max(created_at) AS latest FROM n GROUP BY 1"),
    "agg14_usage": Query(_usage, "SELECT count(*) AS messages, 0::BIGINT AS broken, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output FROM (SELECT event_id // 3 AS m, max(CAST(floor(value) AS BIGINT)) AS i, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS o FROM events GROUP BY 1)"),
    "agg15_parent_progress": Query(
        lambda s, d: edges(s, d, "parent").join(nodes(s, d, "status"), F.col("src") == F.col("id")).join(nodes(s, d, "kind").select(F.col("id").alias("dst")), "dst").groupBy("dst").agg(F.count_if(F.col("status") == "closed").alias("done"), F.count_if(F.col("status") == "cancelled").alias("cancelled"), F.count("*").alias("total")),
        q.with_(q.N, q.E) + "SELECT dst, count(*) FILTER (status = 'closed') AS done, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) AS total FROM e JOIN n ON n.id = src WHERE type = 'parent' AND dst IN (SELECT id FROM n) GROUP BY 1",
    ),
    "agg16_knowledge_counts": Query(
        lambda s, d: nodes(s, d, "kind", "layer", "attrs").select("kind", "layer", F.coalesce(attribute("reach"), F.lit("none")).alias("reach")).groupingSets([["kind"], ["layer"], ["reach"]], "kind", "layer", "reach").agg(F.count("*").alias("n")),
        _ids + f"SELECT kind, layer, reach, count(*) AS n FROM (SELECT kind, layer, coalesce({q.attr('reach')}, 'none') AS reach FROM n) GROUP BY GROUPING SETS ((kind), (layer), (reach))",
    ),
    "agg17_arms": Query(lambda s, d: _r(_arms(s, d), "total", "mean", "mean_cost", "cost", "coverage", "clean"), q.with_(q.N, _ATT) + _ARMS),
    "agg18_credible_bounds": Query(lambda s, d: _r(at.intervals(_arms(s, d)).select("task_class", "model_id", "effort", "n", "low", "high"), "low", "high")),
    "agg19_decisions": Query(lambda s, d: at.decisions(at.intervals(_arms(s, d)))),
    "agg20_quality": Query(lambda s, d: _r(attempts(s, d).select("id", at.quality(F.col("verdict"), F.col("caveats")).alias("q")), "q"), q.with_(q.N, _ATT) + "SELECT id, round(q, 6) AS q FROM qa"),
    "agg21_memory_counts": Query(
        lambda s, d: nodes(s, d, "kind", "attrs").groupBy("kind", F.coalesce(attribute("type"), F.lit("")).alias("type")).agg(F.count("*").alias("n")), _ids + f"SELECT kind, coalesce({q.attr('type')}, '') AS type, count(*) AS n FROM n GROUP BY ALL"
    ),
    "agg22_percentiles": Query(_percentiles, "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1"),
    "agg23_scope_totals": Query(lambda s, d: nodes(s, d, "scope", "body").groupBy("scope").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars")), _ids + "SELECT scope, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM n GROUP BY 1"),
    "agg24_team_projects": Query(lambda s, d: nodes(s, d, "team_id", "scope").groupBy("team_id").agg(F.count_distinct("scope").alias("projects")), _ids + "SELECT team_id, count(DISTINCT scope) AS projects FROM n GROUP BY 1"),
    "agg26_agreement": Query(
        _agree,
        _ids + f"SELECT count(*) AS compared, count(*) FILTER (coalesce({q.attr('type')}, 'unknown') = kind) AS same_class, count(*) AS same_scope FROM n",
    ),
    "agg27_distribution": Query(lambda s, d: nodes(s, d, "attrs").groupBy(F.coalesce(attribute("type"), F.lit("task")).alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class"), _ids + f"SELECT coalesce({q.attr('type')}, 'task') AS class, count(*) AS n FROM n GROUP BY 1"),
    "agg29_overdue_writes": Query(lambda s, d: table(s, d, "oplog").where(F.col("hlc.ts") > NOW_MS - 60 * 86_400_000).agg(F.min("hlc.ts").alias("first"), F.max("hlc.ts").alias("last"), F.count("*").alias("n")), f"SELECT min(hlc.ts) AS first, max(hlc.ts) AS last, count(*) AS n FROM oplog WHERE hlc.ts > {NOW_MS - 60 * 86_400_000}"),
    "agg25_rollup": Query(lambda s, d: nodes(s, d, "scope", "kind").rollup("scope", "kind").agg(F.count("*").alias("n")), _ids + "SELECT scope, kind, count(*) AS n FROM n GROUP BY ROLLUP (scope, kind)"),
    "que21_attempt_list": Query(lambda s, d: _r(attempts(s, d).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost")), "cost"), q.with_(q.N, _ATT) + "SELECT verdict, count(*) AS n, round(sum(cost_usd), 6) AS cost FROM att GROUP BY 1"),
    "que22_cost_drift": Query(lambda s, d: attempts(s, d).withColumn("again", F.round("cost_usd", 3)).where(F.abs(F.col("again") - F.col("cost_usd")) > 1e-9).select("id"), q.with_(q.N, _ATT) + "SELECT id FROM att WHERE abs(round(cost_usd, 3) - cost_usd) > 1e-9"),
    "que23_routing": Query(lambda s, d: at.decisions(at.intervals(_arms(s, d))).join(_arms(s, d).groupBy("task_class").agg(F.sum("n").alias("n"), F.count_if(F.col("coverage") < 1).alias("uncovered")), "task_class")),
    "win1_rank": Query(lambda s, d: nodes(s, d, "scope", "priority").withColumn("r", F.rank().over(Window.partitionBy("scope").orderBy("priority"))).select("id", "r"), _ids + "SELECT id, rank() OVER (PARTITION BY scope ORDER BY priority) AS r FROM n"),
    "win2_first_way": Query(
        lambda s, d: edges(s, d).withColumn("n", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("weight"), "src", "type"))).where("n = 1").select("dst", "src", "type"),
        q.with_(q.E) + "SELECT dst, src, type FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src, type) AS k FROM e) WHERE k = 1",
    ),
    "win3_total_beside": Query(lambda s, d: (lambda n: n.orderBy(F.desc("salience"), "id").limit(20).select("id").crossJoin(F.broadcast(n.agg(F.count("*").alias("total")))))(nodes(s, d, "salience")), _ids + "SELECT id, count(*) OVER () AS total FROM n ORDER BY salience DESC, id LIMIT 20"),
    "win4_fifo_before": Query(
        lambda s, d: nodes(s, d, "scope").withColumn("before", F.count("*").over(Window.partitionBy("scope").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))).select("id", "before"), _ids + "SELECT id, count(*) OVER (PARTITION BY scope ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n"
    ),
    "win5_frames": Query(
        lambda s, d: table(s, d, "events").select("event_id", F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("last"), F.ntile(4).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("quarter")),
        "SELECT event_id, lag(value) OVER w AS last, ntile(4) OVER w AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    ),
    "srt1_ties": Query(lambda s, d: _top(s, d, ("priority", "id"), 50, "priority"), _ids + "SELECT id, priority FROM n ORDER BY priority, id LIMIT 50"),
    "srt2_updated": Query(lambda s, d: _top(s, d, (F.desc("created_at"), "id"), 50, "created_at"), _ids + "SELECT id, created_at FROM n ORDER BY created_at DESC, id LIMIT 50"),
    "srt3_page": Query(lambda s, d: nodes(s, d, "scope").orderBy("scope", "id").offset(40).limit(20).select("id", "scope"), _ids + "SELECT id, scope FROM n ORDER BY scope, id LIMIT 20 OFFSET 40"),
    "srt4_top_per_group": Query(
        lambda s, d: nodes(s, d, "scope", "salience").withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("salience"), "id"))).where("k <= 3").select("scope", "id", "k"),
        _ids + "SELECT scope, id, k FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY salience DESC, id) AS k FROM n) WHERE k <= 3",
    ),
    "srt5_clock_order": Query(
        lambda s, d: nodes(s, d, "hlc", "site_id").orderBy("hlc", "site_id", "id").limit(50).select("id", "hlc", "site_id"), _ids + "SELECT id, hlc, site_id FROM n ORDER BY hlc, site_id, id LIMIT 50"
    ),
    "set1_union_all": Query(lambda s, d: edges(s, d).select(F.col("src").alias("id")).unionByName(edges(s, d).select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("n")), q.with_(q.E) + "SELECT id, count(*) AS n FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1"),
    "set2_union": Query(lambda s, d: edges(s, d).select(F.col("src").alias("id")).union(edges(s, d).select("dst")).distinct(), q.with_(q.E) + "SELECT src AS id FROM e UNION SELECT dst FROM e"),
    "set3_first_of_title": Query(
        lambda s, d: nodes(s, d, "kind", "title", "created_at").groupBy("kind", F.lower("title").alias("name")).agg(F.min(F.struct("created_at", "id"))["id"].alias("id")).select("kind", "id"),
        _ids + "SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind, lower(title) ORDER BY created_at, id) AS k FROM n) WHERE k = 1",
    ),
    "set4_except": Query(lambda s, d: nodes(s, d).select("id").exceptAll(edges(s, d).select(F.col("src").alias("id")).distinct()), q.with_(q.N, q.E) + "SELECT id FROM n EXCEPT SELECT src FROM e"),
}
