"""Queries of the work queue: what is ready, claimable, leased and shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.constants import CLOSED, LEASE_MS, NOW_MS
from graphloom.operators import visibility as vis
from graphloom.operators import workqueue as wq
from graphloom.operators.current import current_edges, current_nodes
from graphloom.plans import sqltext as q
from graphloom.plans.registry import Query
from graphloom.sources.tables import table

COLUMNS = (
    "kind", "layer", "scope", "title", "status", "priority", "salience", "open_blockers", "anc_blockers", "head_id", "acl", "owner_id", "team_id",
    "agent_id", "assignee", "lease_holder", "lease_epoch", "lease_expires", "created_at", "updated_at", "attrs",
)


def nodes(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_nodes(table(s, d, "nodes"), *(columns or COLUMNS))


def edges(s: SparkSession, d: str, *types: str) -> DataFrame:
    return current_edges(table(s, d, "edges"), "weight", "created_at", types=types)


def _lost(s: SparkSession, d: str, n: DataFrame) -> DataFrame:
    return vis.lost_owners(edges(s, d, "touches").select("src", "dst"), n.where("kind = 'anchor'"))


_SCORE = f"""
  round(0.4::DOUBLE * CASE priority WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6667::DOUBLE WHEN 2 THEN 0.3333::DOUBLE ELSE 0.0::DOUBLE END, 2)
  + round(0.27::DOUBLE * least(coalesce(unblocks, 0), 3) / 3.0::DOUBLE, 2)
  + round(0.14::DOUBLE * CASE least(7, greatest(0, floor(({NOW_MS} - clock) / 86400000))) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 7 THEN 0.15::DOUBLE ELSE 0.4::DOUBLE END, 2)
  + round(0.1::DOUBLE * coalesce(anchor, 0.5::DOUBLE), 2)
  + round(0.09::DOUBLE * CASE coalesce({q.attr('type')}, 'task') WHEN 'bug' THEN 1.0::DOUBLE WHEN 'task' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END, 2)
"""
_UNBLOCKS = f"u AS (SELECT e.src AS id, count(*) AS unblocks FROM e JOIN n ON n.id = e.dst WHERE e.type = 'blocks' AND n.status NOT IN {q.CLOSED} GROUP BY 1)"
_ANCHOR = """an AS (SELECT e.src AS id, CASE max(CASE WHEN n.status IN ('stale', 'lost') THEN 2 WHEN n.status <> 'fresh' THEN 1 ELSE 0 END)
  WHEN 2 THEN 0.2::DOUBLE WHEN 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS anchor
  FROM e JOIN n ON n.id = e.dst WHERE e.type = 'touches' AND n.kind = 'anchor' GROUP BY 1)"""
_WAIT = f"kind = 'task' AND status = 'open' AND open_blockers = 0 AND anc_blockers = 0 AND coalesce({q.attr('type')}, '') <> 'epic'"


def _ready_sql(extra: str = "true", limit: int | None = 20, anchor: bool = True) -> str:
    an = _ANCHOR if anchor else "an AS (SELECT '' AS id, 0.5::DOUBLE AS anchor WHERE false)"
    scored = f"sc AS (SELECT id, priority, title, round({_SCORE}, 2) AS score FROM (SELECT *, updated_at AS clock FROM n LEFT JOIN u USING (id) LEFT JOIN an USING (id)) WHERE {_WAIT} AND ({extra}))"
    total = ", count(*) OVER () AS total_ready" if limit else ""
    cut = f" LIMIT {limit}" if limit else ""
    return q.with_(q.N, q.E, _UNBLOCKS, an, scored) + f"SELECT *{total} FROM sc ORDER BY score DESC, priority, id{cut}"


_VIEWER = vis.Viewer("u-007", "team-harbor", "agent-19")
_CORE = "((acl = 'team' AND (team_id = 'team-harbor' OR team_id = '')) OR (acl = 'private' AND owner_id = 'u-007') OR (acl = 'agent' AND agent_id = 'agent-19'))"
_EXPIRED = f"kind = 'task' AND status = 'in_progress' AND lease_expires > 0 AND lease_expires < {NOW_MS} AND open_blockers = 0 AND anc_blockers = 0 AND coalesce({q.attr('type')}, '') <> 'epic'"


def _merged(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d), edges(s, d, "blocks", "touches")
    late = wq.expired(n, NOW_MS).withColumn("status", F.lit("open"))
    both = n.join(late.select("id"), "id", "left_anti").unionByName(late)
    return wq.ready(both, e, NOW_MS, limit=20)


def _jobs(s: SparkSession, d: str) -> DataFrame:
    """A job per task: its lease, and as attempts how often it has been seen."""
    n = nodes(s, d, "kind", "status", "lease_expires", "seen_count", "scope", "priority", "created_at")
    return n.where("kind = 'task'").select(
        "id", "scope", F.least("seen_count", F.lit(9)).alias("attempts"), "lease_expires", (F.col("created_at") + wq.job_backoff(F.least("seen_count", F.lit(9)))).alias("run_after"), "priority"
    )


_JOBS = """j AS (SELECT id, scope, least(seen_count, 9) AS attempts, lease_expires, priority,
  created_at + least(300000, 1000 * CAST(pow(2, least(least(seen_count, 9), 20)) AS BIGINT)) AS run_after FROM n WHERE kind = 'task')"""


def _leased(s: SparkSession, d: str) -> DataFrame:
    held = nodes(s, d, "kind", "lease_holder").select("id", F.coalesce("lease_holder", F.lit("")).alias("lease_holder"))
    return _jobs(s, d).join(held, "id").withColumns({"lease_expires": F.coalesce("lease_expires", F.lit(0)), "last_error": F.lit(None).cast("string")})


def _new_jobs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(s, d, "kind", "scope", "priority")
    stored = n.where("kind in ('note', 'doc')").select("id", "kind", F.col("scope").alias("entity_id"))
    return stored, n.where("kind in ('doc', 'task')").select("id", "kind", F.when(F.col("priority") == 0, None).otherwise(F.col("scope")).alias("entity_id"))


def _job_state():
    return F.when(F.col("attempts") >= 5, "dead").when(F.col("lease_expires") > NOW_MS, "leased").when(F.col("run_after") > NOW_MS, "waiting").otherwise("ready")


_JOB_STATE = f"CASE WHEN attempts >= 5 THEN 'dead' WHEN lease_expires > {NOW_MS} THEN 'leased' WHEN run_after > {NOW_MS} THEN 'waiting' ELSE 'ready' END"


def _prime(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    return wq.digest(n, _lost(s, d, n), "ses-487701")


_REACH = f"""(CASE coalesce({q.attr('reach')}, '') WHEN 'project' THEN true WHEN 'session' THEN coalesce({q.attr('session_id')}, '') = 'ses-487701'
  ELSE coalesce({q.attr('episode_id')}, '') = '' OR 'episode:' || {q.attr('episode_id')} = 'ses-487701' END)"""
_LOST = "lost AS (SELECT e.src AS id FROM e JOIN n a ON a.id = e.dst WHERE e.type = 'touches' AND a.kind = 'anchor' GROUP BY 1 HAVING min(CASE WHEN a.status = 'lost' THEN 1 ELSE 0 END) = 1)"
_SHOWN = f"layer >= 2 AND head_id IS NULL AND {_REACH} AND {q.attr('state')} IS DISTINCT FROM 'pending_review' AND status NOT IN {q.HIDDEN}"
_PRIME = (
    q.with_(q.N, q.E, _LOST)
    + f"""SELECT scope, layer, id, title, place FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, layer ORDER BY salience DESC, id) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY scope ORDER BY layer DESC, salience DESC, id) AS pos FROM n WHERE {_SHOWN} AND id NOT IN (SELECT id FROM lost)) WHERE pos <= 60)
WHERE place <= CASE WHEN layer = 3 THEN 4 ELSE 3 END"""
)


def _requests(n: DataFrame) -> DataFrame:
    """Each lease is asked for by its holder and, with an old epoch, by a latecomer."""
    held = n.where("lease_holder <> ''").select("id", F.col("lease_holder").alias("holder"), F.col("lease_epoch").alias("epoch"))
    return held.unionByName(held.withColumn("epoch", F.col("epoch") - 1))


def _fenced_sql(after: str, kept: str) -> str:
    return q.with_(q.N) + f"""SELECT id, lease_holder AS holder, ok AS accepted, CASE WHEN ok THEN '{after}' ELSE status END AS status, CASE WHEN ok THEN {kept} END AS lease_expires
    FROM (SELECT id, lease_holder, status, o = 0 AND status = 'in_progress' AS ok FROM n, (VALUES (0), (1)) t(o) WHERE lease_holder <> '')"""


def _board(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d).where("kind = 'task'")
    open_ = F.when(F.col("open_blockers") > 0, "blocked").when(F.col("open_blockers") == 0, "open")
    column = F.when(F.col("status") == "open", open_).when(F.col("status").isin("in_progress", "closed", "cancelled"), F.col("status"))
    return n.withColumn("board_column", column).where("board_column is not null").groupBy("scope", "board_column").agg(F.count("*").alias("n"))


def _closed_top(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = nodes(s, d, "kind", "scope", "status", "updated_at").where("kind = 'task' and status = 'closed'")
    w = Window.partitionBy("scope").orderBy(F.desc("updated_at"), "id")
    return n.withColumn("place", F.row_number().over(w)).where("place <= 100").select("scope", "id", "place")


def _release(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d, "kind", "status", "open_blockers"), edges(s, d, "blocks")
    freed = n.where("status = 'open' and open_blockers = 1").select(F.col("id").alias("dst"))
    return e.join(freed, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("frees"))


def _stand_ins(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind").isin("doc", "entity", "note", "task"), "anchor").otherwise(F.col("kind"))
    status = F.element_at(F.array(*map(F.lit, ("fresh", "drifted", "stale", "lost"))), (F.col("created_at") % 4 + 1).cast("int"))
    return nodes(s, d, "kind", "created_at").select("id", kind.alias("kind"), status.alias("status"))


def _recount(s: SparkSession, d: str) -> DataFrame:
    """Stored against recomputed blocker counts, where they differ."""
    n, e = nodes(s, d, "status", "open_blockers"), edges(s, d, "blocks")
    live = n.where(~F.col("status").isin(*CLOSED)).select(F.col("id").alias("src"))
    counted = e.join(live, "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("counted"))
    both = n.join(counted, "id", "left").select("id", F.col("open_blockers").alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return both.where("stored <> counted")


_RECOUNT = q.with_(q.N, q.E) + f"""SELECT id, open_blockers AS stored, coalesce(c, 0) AS counted FROM n LEFT JOIN (
  SELECT e.dst, count(*) AS c FROM e JOIN n ON n.id = e.src WHERE e.type = 'blocks' AND n.status NOT IN {q.CLOSED} GROUP BY 1) ON id = dst
  WHERE open_blockers <> coalesce(c, 0)"""


def _timeline(s: SparkSession, d: str) -> DataFrame:
    """The tail of the log by its sequence, titles looked up and long values clipped."""
    last = table(s, d, "oplog").groupBy("op_id").agg(F.max(F.struct("seq", "entity_id", "op", "field", "value")).alias("r")).select("op_id", "r.*").orderBy(F.desc("seq"), "op_id").limit(200)
    clipped = F.when(F.length("value") > 160, F.concat(F.substring("value", 1, 160), F.lit("…"))).otherwise(F.col("value"))
    return last.join(nodes(s, d, "title").withColumnRenamed("id", "entity_id"), "entity_id", "left").select("op_id", "seq", "entity_id", "op", "field", clipped.alias("value"), "title")


_TIMELINE = q.with_(q.N, "o AS (SELECT op_id, max(seq) AS seq, arg_max(entity_id, seq) AS entity_id, arg_max(op, seq) AS op, arg_max(field, seq) AS field, arg_max(value, seq) AS value FROM oplog GROUP BY 1)") + """
SELECT op_id, seq, entity_id, op, field, CASE WHEN length(value) > 160 THEN value[1:160] || '…' ELSE value END AS value, title FROM (SELECT * FROM o ORDER BY seq DESC, op_id LIMIT 200) l LEFT JOIN n ON n.id = l.entity_id"""


def _cards(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d, "title", "kind"), edges(s, d)
    up = e.where("type = 'parent'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("parent"))
    down = e.where("type = 'parent'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("children"))
    links = e.where("type not in ('parent', 'replies_to')").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("links"))
    comments = e.where("type = 'replies_to'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("comments"))
    out = n.where("kind = 'task'").join(up, "id", "left")
    for part in (down, links, comments):
        out = out.join(part, "id", "left")
    return out.fillna(0, ["children", "links", "comments"]).select("id", "title", "parent", "children", "links", "comments")


_CARDS = q.with_(q.N, q.E) + """SELECT id, title, p.parent, coalesce(c.c, 0) AS children, coalesce(l.c, 0) AS links, coalesce(m.c, 0) AS comments FROM n
LEFT JOIN (SELECT src, min(dst) AS parent FROM e WHERE type = 'parent' GROUP BY 1) p ON p.src = id
LEFT JOIN (SELECT dst, count(*) AS c FROM e WHERE type = 'parent' GROUP BY 1) c ON c.dst = id
LEFT JOIN (SELECT src, count(*) AS c FROM e WHERE type NOT IN ('parent', 'replies_to') GROUP BY 1) l ON l.src = id
LEFT JOIN (SELECT dst, count(*) AS c FROM e WHERE type = 'replies_to' GROUP BY 1) m ON m.dst = id WHERE kind = 'task'"""


def _cancel(s: SparkSession, d: str) -> DataFrame:
    """Per blocked record that would be ready if its only blocker were cancelled: the blocker."""
    n, e = nodes(s, d, "kind", "status", "open_blockers", "anc_blockers"), edges(s, d, "blocks")
    waiting = n.where("kind = 'task' and status = 'open' and open_blockers <= 1 and anc_blockers = 0").select(F.col("id").alias("dst"))
    unfinished = n.where(~F.col("status").isin(*CLOSED)).select(F.col("id").alias("src"))
    only = e.join(unfinished, "src").join(waiting, "dst").groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("blocker"))
    return only.where("n = 1").select(F.col("dst").alias("id"), "blocker")


_CANCEL = q.with_(q.N, q.E) + f"""SELECT dst AS id, min(src) AS blocker FROM e JOIN n s ON s.id = e.src JOIN n t ON t.id = e.dst
WHERE e.type = 'blocks' AND s.status NOT IN {q.CLOSED} AND t.kind = 'task' AND t.status = 'open' AND t.open_blockers <= 1 AND t.anc_blockers = 0 GROUP BY 1 HAVING count(*) = 1"""


def _slots(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "kind", "scope", "status").where("kind = 'task' and status in ('open', 'in_progress')")
    return wq.run_slots(n.withColumn("running", F.col("status") == "in_progress"), "scope", "id", "running", 2).select("scope", "id", "ahead", "granted")


_SLOTS = q.with_(q.N) + """, t AS (SELECT scope, id, status = 'in_progress' AS running FROM n WHERE kind = 'task' AND status IN ('open', 'in_progress'))
SELECT scope, id, ahead, running OR ahead < 2 AS granted FROM (SELECT *, CAST(count(*) OVER (PARTITION BY scope ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  + coalesce(sum(CAST(running AS INT)) OVER (PARTITION BY scope ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS ahead FROM t)"""


def _attempts(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d, "kind", "closed_at", "created_at", "priority", "status").where("kind = 'task' and status <> 'open'")
    alive = F.when(F.col("priority") > 0, F.col("created_at") % 2 == 0)  # what a probe of the process would have said
    return wq.live_state(n.select("id", F.col("closed_at").alias("finished_at"), alive.alias("alive"))).groupBy("state").agg(F.count("*").alias("n"))


_ATTEMPTS = q.with_(q.N) + """SELECT CASE WHEN priority <= 0 OR priority IS NULL THEN 'unknown' WHEN created_at % 2 = 0 AND closed_at IS NULL THEN 'working' WHEN created_at % 2 = 0 THEN 'orphan' WHEN closed_at IS NULL THEN 'lost' ELSE 'done' END AS state, count(*) AS n FROM n WHERE kind = 'task' AND status <> 'open' GROUP BY 1"""


def _background(s: SparkSession, d: str) -> DataFrame:
    """Per site whether its background mark has kept up with its writes; each second site has a mark."""
    sites = table(s, d, "nodes").select("site_id").union(table(s, d, "oplog").select("site_id")).union(s.createDataFrame([("s-idle",)], "site_id string")).where("site_id is not null").distinct()
    marks = sites.withColumn("stamp", F.when(F.ascii(F.substring("site_id", -1, 1)) % 2 == 0, F.lit(_STAMP)))
    return wq.mark_verdicts(marks, table(s, d, "oplog").select("site_id", F.col("hlc.ts").alias("ts")), _PERIOD)


_STAMP, _PERIOD = NOW_MS - 45 * 86_400_000, 86_400_000
_BACKGROUND = f"""WITH s AS (SELECT site_id, CASE WHEN ascii(right(site_id, 1)) % 2 = 0 THEN {_STAMP} END AS stamp FROM (SELECT site_id FROM nodes UNION SELECT site_id FROM oplog UNION SELECT 's-idle') WHERE site_id IS NOT NULL),
w AS (SELECT s.site_id, any_value(stamp) AS stamp, count(o.site_id) AS late, max(hlc.ts) - min(hlc.ts) AS span FROM s LEFT JOIN oplog o ON o.site_id = s.site_id AND (stamp IS NULL OR hlc.ts > stamp + {2 * _PERIOD}) GROUP BY 1)
SELECT site_id, late, CASE WHEN stamp IS NULL THEN CASE WHEN late > 0 THEN 'never' ELSE 'idle' END WHEN late = 0 OR span < {_PERIOD} THEN 'ok' ELSE 'frozen' END AS verdict FROM w"""

QUERIES = {
    "que1_ready": Query(lambda s, d: wq.ready(nodes(s, d), edges(s, d, "blocks", "touches"), NOW_MS), _ready_sql()),
    "que2_ready_all_scores": Query(lambda s, d: wq.ready(nodes(s, d), edges(s, d, "blocks", "touches"), NOW_MS, limit=None, anchors=False), _ready_sql(limit=None, anchor=False)),
    "que2_ready_repo": Query(
        lambda s, d: wq.ready(nodes(s, d), edges(s, d, "blocks", "touches"), NOW_MS, repo="kiln/parser"), _ready_sql(f"{q.attr('repo')} IS NULL OR {q.attr('repo')} IN ('', 'kiln/parser')")
    ),
    "que2_ready_access": Query(
        lambda s, d: wq.ready(nodes(s, d).withColumn("granted", F.lit(False)), edges(s, d, "blocks", "touches"), NOW_MS, extra=vis.access_core(_VIEWER)), _ready_sql(_CORE)
    ),
    "que3_ready_with_expired": Query(_merged, _ready_sql().replace("status = 'open' AND", f"(status = 'open' OR ({_EXPIRED})) AND")),
    "que3_expired": Query(lambda s, d: wq.expired(nodes(s, d), NOW_MS).select("id", "lease_holder", "lease_expires"), q.with_(q.N) + f"SELECT id, lease_holder, lease_expires FROM n WHERE {_EXPIRED}"),
    "que4_repo_counts": Query(
        lambda s, d: nodes(s, d, "kind", "status", "attrs").where("kind = 'task' and status = 'open'").agg(
            F.count_if(F.get_json_object("attrs", "$.repo") == "kiln/parser").alias("known"),
            F.count_if(F.coalesce(F.get_json_object("attrs", "$.repo"), F.lit("")) == "").alias("unknown"),
            F.count_if(~F.coalesce(F.get_json_object("attrs", "$.repo"), F.lit("")).isin("", "kiln/parser")).alias("foreign"),
        ),
        q.with_(q.N) + f"SELECT count(*) FILTER ({q.attr('repo')} = 'kiln/parser') AS known, count(*) FILTER (coalesce({q.attr('repo')}, '') = '') AS unknown, count(*) FILTER (coalesce({q.attr('repo')}, '') NOT IN ('', 'kiln/parser')) AS \"foreign\" FROM n WHERE kind = 'task' AND status = 'open'",
    ),
    "que5_claim": Query(
        lambda s, d: wq.claim(nodes(s, d), "agent-19", NOW_MS, LEASE_MS),
        q.with_(q.N) + f"SELECT id, 'in_progress' AS status, 'agent-19' AS lease_holder, coalesce(lease_epoch, 0) + 1 AS lease_epoch, {NOW_MS + LEASE_MS} AS lease_expires FROM n WHERE kind = 'task' AND open_blockers = 0 AND (status = 'open' OR (status = 'in_progress' AND lease_expires > 0 AND lease_expires < {NOW_MS}))",
    ),
    "que6_renew": Query(lambda s, d: wq.fenced(nodes(s, d), _requests(nodes(s, d)), "renew", NOW_MS, LEASE_MS), _fenced_sql("in_progress", str(NOW_MS + LEASE_MS))),
    "que6_release": Query(lambda s, d: wq.fenced(nodes(s, d), _requests(nodes(s, d)), "release", NOW_MS, LEASE_MS), _fenced_sql("open", "0")),
    "que6_close": Query(lambda s, d: wq.fenced(nodes(s, d), _requests(nodes(s, d)), "close", NOW_MS, LEASE_MS), _fenced_sql("closed", "0")),
    "que7_claim_candidates": Query(
        lambda s, d: nodes(s, d).where(wq.claimable(NOW_MS)).select("id", "priority", "updated_at").orderBy("priority", "updated_at", "id").limit(25),
        q.with_(q.N) + f"SELECT id, priority, updated_at FROM n WHERE kind = 'task' AND open_blockers = 0 AND (status = 'open' OR (status = 'in_progress' AND lease_expires > 0 AND lease_expires < {NOW_MS})) ORDER BY priority, updated_at, id LIMIT 25",
    ),
    "que8_lease_renewal_due": Query(
        lambda s, d: nodes(s, d, "status", "lease_expires").where(f"status = 'in_progress' and lease_expires > 0 and lease_expires - {LEASE_MS} + 300000 <= {NOW_MS}").select("id", "lease_expires"),
        q.with_(q.N) + f"SELECT id, lease_expires FROM n WHERE status = 'in_progress' AND lease_expires > 0 AND lease_expires - {LEASE_MS} + 300000 <= {NOW_MS}",
    ),
    "que9_job_backoff": Query(lambda s, d: _jobs(s, d).select("id", "attempts", "run_after"), q.with_(q.N, _JOBS) + "SELECT id, attempts, run_after FROM j"),
    "que9_job_claim": Query(
        lambda s, d: _jobs(s, d).where(_job_state() == "ready").orderBy("priority", "run_after", "id").limit(50).select("id", "priority", "run_after"),
        q.with_(q.N, _JOBS) + f"SELECT id, priority, run_after FROM j WHERE {_JOB_STATE} = 'ready' ORDER BY priority, run_after, id LIMIT 50",
    ),
    "que9_job_sweep": Query(
        lambda s, d: wq.swept_jobs(_leased(s, d), NOW_MS).select("id", "attempts", "run_after", "lease_holder", "last_error"),
        q.with_(q.N, _JOBS) + f"""SELECT id, CAST(CASE WHEN h THEN attempts + 1 ELSE attempts END AS BIGINT) AS attempts, CASE WHEN h THEN {NOW_MS} + least(300000, 1000 * CAST(pow(2, least(attempts, 20)) AS BIGINT)) ELSE run_after END AS run_after,
        CASE WHEN h THEN '' ELSE lease_holder END AS lease_holder, CASE WHEN h THEN 'lease expired' END AS last_error FROM (SELECT j.*, n.lease_holder, n.lease_holder <> '' AND coalesce(n.lease_expires, 0) <= {NOW_MS} AS h FROM j JOIN n USING (id))""",
    ),
    "que9_job_enqueue": Query(
        lambda s, d: wq.enqueued(*_new_jobs(s, d)).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities")),
        q.with_(q.N) + """, st AS (SELECT id, kind, scope AS entity_id FROM n WHERE kind IN ('note', 'doc')), nw AS (SELECT id, kind, CASE WHEN priority = 0 THEN NULL ELSE scope END AS entity_id FROM n WHERE kind IN ('doc', 'task')),
        al AS (SELECT kind, entity_id FROM st UNION ALL SELECT kind, NULL FROM nw WHERE entity_id IS NULL UNION ALL SELECT DISTINCT kind, entity_id FROM nw WHERE entity_id IS NOT NULL AND (kind, entity_id) NOT IN (SELECT (kind, entity_id) FROM st))
        SELECT kind, count(*) AS n, count(DISTINCT entity_id) AS entities FROM al GROUP BY 1""",
    ),
    "que10_run_slots": Query(_slots, _SLOTS),
    "que11_board": Query(
        _board, q.with_(q.N) + " UNION ALL ".join(f"SELECT scope, '{c}' AS board_column, count(*) AS n FROM n WHERE kind = 'task' AND {w} GROUP BY scope" for c, w in (("open", "status = 'open' AND open_blockers = 0"), ("blocked", "status = 'open' AND open_blockers > 0"), ("in_progress", "status = 'in_progress'"), ("closed", "status = 'closed'"), ("cancelled", "status = 'cancelled'")))
    ),
    "que11_board_closed": Query(_closed_top, q.with_(q.N) + "SELECT scope, id, place FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY updated_at DESC, id) AS place FROM n WHERE kind = 'task' AND status = 'closed') WHERE place <= 100"),
    "que12_release_preview": Query(_release, q.with_(q.N, q.E) + "SELECT e.src AS id, count(*) AS frees FROM e JOIN n ON n.id = e.dst WHERE e.type = 'blocks' AND n.status = 'open' AND n.open_blockers = 1 GROUP BY 1"),
    "que13_cards": Query(_cards, _CARDS),
    "que14_timeline": Query(_timeline, _TIMELINE),
    "que15_prime_digest": Query(_prime, _PRIME),
    "que16_pending_and_lost": Query(
        lambda s, d: nodes(s, d).where("layer >= 2 and head_id is null").agg(F.count_if(vis.in_reach("ses-487701") & vis.awaiting_review()).alias("pending"), F.count_if(~vis.in_reach("ses-487701")).alias("hidden"), F.count_if(vis.unknown_reach()).alias("unknown")),
        q.with_(q.N) + f"SELECT count(*) FILTER ({_REACH} AND {q.attr('state')} = 'pending_review' AND status NOT IN {q.HIDDEN}) AS pending, count(*) FILTER (NOT {_REACH}) AS hidden, count(*) FILTER (coalesce({q.attr('reach')}, '') NOT IN ('session', 'project') AND coalesce({q.attr('episode_id')}, '') = '') AS unknown FROM n WHERE layer >= 2 AND head_id IS NULL",
    ),
    "que17_in_progress": Query(
        lambda s, d: nodes(s, d, "kind", "scope", "status", "assignee").where("kind = 'task' and status = 'in_progress'").groupBy("scope").agg(F.count("*").alias("n"), F.count_distinct("assignee").alias("people")),
        q.with_(q.N) + "SELECT scope, count(*) AS n, count(DISTINCT assignee) AS people FROM n WHERE kind = 'task' AND status = 'in_progress' GROUP BY 1",
    ),
    "que18_digest_cache_valid": Query(
        lambda s, d: table(s, d, "oplog").groupBy("site_id").agg(F.max("seq").alias("seq")).select("site_id", "seq", (F.col("seq") <= 400).alias("valid")),
        "SELECT site_id, max(seq) AS seq, max(seq) <= 400 AS valid FROM oplog GROUP BY 1",
    ),
    "que19_review_list": Query(
        lambda s, d: nodes(s, d, "kind", "head_id", "title", "status", "attrs").where("kind = 'note'").where(vis.history(False)).withColumn("attrs", F.regexp_replace("attrs", '"state": "imported"', '"state": "pending_review"')).where(vis.awaiting_review()).select("id", "title"),
        q.with_(q.N) + f"SELECT id, title FROM n WHERE kind = 'note' AND head_id IS NULL AND {q.attr('state')} IN ('imported', 'pending_review') AND status NOT IN {q.HIDDEN}",
    ),
    "que20_attempt_states": Query(_attempts, _ATTEMPTS),
    "que24_recount_blockers": Query(_recount, _RECOUNT),
    "que25_freed_by_cancel": Query(_cancel, _CANCEL),
    "que26_background": Query(_background, _BACKGROUND),
    "agg3_unblocks": Query(lambda s, d: wq.unblocks(edges(s, d, "blocks"), nodes(s, d, "status")), q.with_(q.N, q.E, _UNBLOCKS) + "SELECT * FROM u"),
    "agg4_top_blocker": Query(
        lambda s, d: wq.top_blocker(nodes(s, d, "status"), edges(s, d, "blocks")),
        q.with_(q.N, q.E) + f"SELECT e.src AS id, count(*) AS n FROM e JOIN n s ON s.id = e.src JOIN n t ON t.id = e.dst WHERE e.type = 'blocks' AND s.status NOT IN {q.CLOSED} AND t.status = 'open' GROUP BY 1 ORDER BY n DESC, id LIMIT 1",
    ),
    "agg11_job_states": Query(
        lambda s, d: wq.job_stats(_jobs(s, d).withColumn("lease_expires", F.coalesce("lease_expires", F.lit(0))), "scope", NOW_MS),
        q.with_(q.N, _JOBS) + f"""SELECT scope, count(*) AS total, count(*) FILTER (attempts >= 5) AS dead, count(*) FILTER (attempts < 5 AND lease_expires > {NOW_MS}) AS leased,
        count(*) FILTER (attempts < 5 AND coalesce(lease_expires, 0) <= {NOW_MS}) AS waiting, count(*) FILTER (attempts < 5 AND coalesce(lease_expires, 0) <= {NOW_MS} AND run_after <= {NOW_MS}) AS ready FROM j GROUP BY 1""",
    ),
    # documents and entities stand for anchors, of which no touches edge of the tables names one
    "jn17_anchor_term": Query(
        lambda s, d: wq.anchor_term(edges(s, d, "touches"), _stand_ins(s, d)),
        q.with_(q.N.replace("n AS", "n0 AS"), q.E, "n AS (SELECT id, CASE WHEN kind IN ('doc', 'entity', 'note', 'task') THEN 'anchor' ELSE kind END AS kind, ['fresh', 'drifted', 'stale', 'lost'][created_at % 4 + 1] AS status FROM n0)", _ANCHOR) + "SELECT * FROM an",
    ),
}
