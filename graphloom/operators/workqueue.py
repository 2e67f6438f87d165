"""What to do next: ready queue, leases, jobs, boards and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.constants import CLOSED, DAY_MS, READY_WEIGHTS
from graphloom.operators import visibility as vis
from graphloom.operators.current import attribute


def d(x: float) -> Column:
    """A double literal; decimals would round in another way."""
    return F.lit(float(x)).cast("double")


def clock_ms(c: Column) -> Column:
    """An instant written in seconds, milli- or microseconds as milliseconds."""
    return F.when(c < 100_000_000_000, c * 1000).when(c < 100_000_000_000_000, c).otherwise(F.floor(c / 1000)).cast("long")


def freshness_clock() -> Column:
    """Source time of imported records unless they were changed here since.

    Only numeric JSON counts as a clock; a number in quotes doesn't.
    """
    w = F.col("updated_at")

    def number(key: str) -> Column:
        raw = F.regexp_extract("attrs", rf'"{key}"\s*:\s*(-?\d+(?:\.\d+)?)\s*[,}}]', 1)
        return F.when(raw != "", raw.cast("double").cast("long"))

    synced, updated, created = number("external_synced_at"), number("external_updated_at"), number("external_created_at")
    return (
        F.when(synced.isNotNull() & (w > synced + 60_000), w)
        .when(updated.isNotNull(), F.least(updated, w))
        .when(created.isNotNull(), F.least(created, w))
        .otherwise(w)
    )


def unblocks(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, unblocks): how many unfinished records each record blocks."""
    waiting = nodes.where(~F.col("status").isin(*CLOSED)).select(F.col("id").alias("dst"))
    return blocks.join(waiting, "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("unblocks"))


def anchor_term(touches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, anchor): 1 if all anchors are fresh, 0.2 if one is stale or lost, else 0.6."""
    anchors = nodes.where("kind = 'anchor'").select(F.col("id").alias("dst"), "status")
    worst = F.max(F.when(F.col("status").isin("stale", "lost"), 2).when(F.col("status") != "fresh", 1).otherwise(0))
    return touches.join(anchors, "dst").groupBy(F.col("src").alias("id")).agg(F.when(worst == 2, 0.2).when(worst == 0, 1.0).otherwise(0.6).cast("double").alias("anchor"))


def ready_score(now_ms: int, weights: dict[str, float] = READY_WEIGHTS) -> Column:
    """The sum of five terms, each rounded, so that printed terms add up."""
    w = weights
    days = F.least(F.lit(7), F.greatest(F.lit(0), F.floor((F.lit(now_ms) - freshness_clock()) / DAY_MS)))
    fresh = F.when(days == 0, 1.0).when(days <= 2, 0.7).when(days == 7, 0.15).otherwise(0.4).cast("double")
    priority = F.when(F.col("priority") == 0, 1.0).when(F.col("priority") == 1, 0.6667).when(F.col("priority") == 2, 0.3333).otherwise(0.0).cast("double")
    kind = F.coalesce(attribute("type"), F.lit("task"))
    type_term = F.when(kind == "bug", 1.0).when(kind == "task", 0.5).otherwise(0.25).cast("double")
    return (
        F.round(d(w["priority"]) * priority, 2)
        + F.round(d(w["unblocks"]) * F.least(F.coalesce("unblocks", F.lit(0)), F.lit(3)) / d(3), 2)
        + F.round(d(w["freshness"]) * fresh, 2)
        + F.round(d(w["anchors"]) * F.coalesce("anchor", d(0.5)), 2)
        + F.round(d(w["type"]) * type_term, 2)
    )


def ready(nodes: DataFrame, edges: DataFrame, now_ms: int, limit: int | None = 20, scope: str | None = None, repo: str = "", extra: Column | None = None, anchors: bool = True) -> DataFrame:
    """Open unblocked tasks by score, with the number of all of them.

    ``nodes`` and ``edges`` are newest live rows.  Counts per record are
    aggregated once and joined, not looked up per row.
    """
    waiting = nodes.where("kind = 'task' and status = 'open' and open_blockers = 0 and anc_blockers = 0").where(vis.not_epic()).where(vis.in_repo(repo))
    if scope is not None:
        waiting = waiting.where(F.col("scope") == scope)
    if extra is not None:
        waiting = waiting.where(extra)
    rows = waiting.join(unblocks(edges.where("type = 'blocks'"), nodes), "id", "left")
    rows = rows.join(anchor_term(edges.where("type = 'touches'"), nodes), "id", "left") if anchors else rows.withColumn("anchor", d(0.5))
    scored = rows.withColumn("score", F.round(ready_score(now_ms), 2))
    total = scored.agg(F.count("*").alias("total_ready"))
    top = scored.select("id", "priority", "title", "score").orderBy(F.desc("score"), "priority", "id")
    return (top.limit(limit) if limit else top).join(F.broadcast(total)) if limit else top


def expired(nodes: DataFrame, now_ms: int) -> DataFrame:
    """Tasks in progress whose lease has run out, epics left out."""
    return nodes.where("kind = 'task' and status = 'in_progress' and lease_expires > 0 and open_blockers = 0 and anc_blockers = 0").where(
        (F.col("lease_expires") < now_ms) & vis.not_epic()
    )


def top_blocker(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The record that blocks most open records; ties go to the smaller id."""
    source = nodes.where(~F.col("status").isin(*CLOSED)).select(F.col("id").alias("src"))
    target = nodes.where("status = 'open'").select(F.col("id").alias("dst"))
    blocks = edges.where("type = 'blocks'").join(target, "dst").join(source, "src")
    return blocks.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1)


def claimable(now_ms: int) -> Column:
    """Whether a task may be claimed.  Ancestors' blockers don't stop a claim, unlike the ready queue."""
    free = (F.col("status") == "open") | ((F.col("status") == "in_progress") & (F.col("lease_expires") > 0) & (F.col("lease_expires") < now_ms))
    return (F.col("kind") == "task") & (F.col("open_blockers") == 0) & free


def claim(nodes: DataFrame, holder: str, now_ms: int, lease_ms: int) -> DataFrame:
    """The state after ``holder`` claims each claimable task: status, lease, next epoch."""
    can = claimable(now_ms)
    return nodes.where(can).select(
        "id",
        F.lit("in_progress").alias("status"),
        F.lit(holder).alias("lease_holder"),
        (F.coalesce("lease_epoch", F.lit(0)) + 1).alias("lease_epoch"),
        F.lit(now_ms + lease_ms).alias("lease_expires"),
    )


def fenced(nodes: DataFrame, requests: DataFrame, action: str, now_ms: int, lease_ms: int) -> DataFrame:
    """Renew, release or close with fencing: only the holder's own epoch counts.

    ``requests`` has id, holder and epoch; the answer says whether each was
    accepted and the state it leads to.
    """
    both = requests.join(nodes.select("id", "status", "lease_holder", "lease_epoch"), "id", "left")
    ok = (F.col("lease_holder") == F.col("holder")) & (F.col("lease_epoch") == F.col("epoch")) & (F.col("status") == "in_progress")
    after = {"renew": "in_progress", "release": "open", "close": "closed"}[action]
    kept = F.lit(now_ms + lease_ms) if action == "renew" else F.lit(0)
    return both.select("id", "holder", F.coalesce(ok, F.lit(False)).alias("accepted"), F.when(ok, after).otherwise(F.col("status")).alias("status"), F.when(ok, kept).alias("lease_expires"))


def job_backoff(attempts: Column) -> Column:
    """min(300 s, 1 s * 2^attempts) in milliseconds."""
    return F.least(F.lit(300_000).cast("long"), F.lit(1000).cast("long") * F.pow(F.lit(2.0), F.least(attempts, F.lit(20))).cast("long"))


def run_slots(tickets: DataFrame, lane: str, order: str, running: str, slots: int) -> DataFrame:
    """FIFO position of each ticket of a lane: running ones and earlier ones come before it."""
    before = Window.partitionBy(lane).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(lane).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    ahead = F.coalesce(F.count("*").over(before), F.lit(0)) + F.coalesce(F.sum(F.col(running).cast("int")).over(after), F.lit(0))
    return tickets.withColumn("ahead", ahead).withColumn("granted", F.col(running) | (F.col("ahead") < slots))


def digest(nodes: DataFrame, lost: DataFrame, session: str, window: int = 60, layer3: int = 4, layer2: int = 3) -> DataFrame:
    """Per scope the first records of layers 3 and 2, from the window of all visible ones."""
    shown = nodes.where("layer >= 2").where(vis.history(False) & vis.in_reach(session) & vis.not_pending() & vis.live_status())
    shown = shown.join(lost, "id", "left_anti")
    first = Window.partitionBy("scope").orderBy(F.desc("layer"), F.desc("salience"), "id")
    layer = Window.partitionBy("scope", "layer").orderBy(F.desc("salience"), "id")
    rows = shown.withColumn("at", F.row_number().over(first)).where(F.col("at") <= window).withColumn("place", F.row_number().over(layer))
    most = F.when(F.col("layer") == 3, layer3).otherwise(layer2)
    return rows.where(F.col("place") <= most).select("scope", "layer", "id", "title", "place")


def live_state(rows: DataFrame) -> DataFrame:
    """What has become of an attempt by ``finished_at`` and whether its process is ``alive`` (null: couldn't be asked).

    A process that outlives its finished attempt is an orphan, one that died before the end is lost.
    """
    open_ = F.col("finished_at").isNull()
    state = F.when(F.col("alive").isNull(), "unknown").when(F.col("alive"), F.when(open_, "working").otherwise("orphan")).when(open_, "lost").otherwise("done")
    return rows.withColumn("state", state)


def mark_verdicts(marks: DataFrame, writes: DataFrame, period: int, periods: int = 2) -> DataFrame:
    """(site_id, late, verdict) of background marks (site_id, stamp) against local writes (site_id, ts).

    Late writes come more than ``periods`` periods after the mark, or are all where
    there is none.  idle: neither mark nor writes; never: writes without a mark;
    frozen: late writes that span a period; ok: else.
    """
    late = marks.join(writes, "site_id", "left").withColumn("ts", F.when(F.col("stamp").isNull() | (F.col("ts") > F.col("stamp") + periods * period), F.col("ts")))
    per = late.groupBy("site_id").agg(F.max("stamp").alias("stamp"), F.count("ts").alias("late"), (F.max("ts") - F.min("ts")).alias("span"))
    some = F.col("late") > 0
    verdict = F.when(F.col("stamp").isNull(), F.when(some, "never").otherwise("idle")).when(~some | (F.col("span") < period), "ok").otherwise("frozen")
    return per.select("site_id", "late", verdict.alias("verdict"))


def job_stats(jobs: DataFrame, by: str, now_ms: int, most: int = 5) -> DataFrame:
    """Counts per group: total, dead, leased, waiting (ready ones included) and ready."""
    dead, leased = F.col("attempts") >= most, F.col("lease_expires") > now_ms
    return jobs.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(dead).alias("dead"), F.count_if(~dead & leased).alias("leased"), F.count_if(~dead & ~leased).alias("waiting"),
        F.count_if(~dead & ~leased & (F.col("run_after") <= now_ms)).alias("ready"),
    )


def enqueued(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with new ones of (kind, entity_id) pairs that aren't waiting yet, each pair once; jobs without entity always join."""
    own = new.where("entity_id is null")
    first = new.where("entity_id is not null").groupBy("kind", "entity_id").agg(F.min("id").alias("id")).select("id", "kind", "entity_id")
    return stored.unionByName(first.join(stored.select("kind", "entity_id"), ["kind", "entity_id"], "left_anti").select(*stored.columns)).unionByName(own.select(*stored.columns))


def failed(jobs: DataFrame, failures: DataFrame, now_ms: int) -> DataFrame:
    """Jobs after failures (id, holder, error): only the holder's count; one more attempt, no lease, a later start."""
    both = jobs.join(failures.select("id", F.col("holder").alias("_h"), "error"), "id", "left")
    hit = (F.col("_h") == F.col("lease_holder")) & (F.col("lease_holder") != "")
    return _tried(both, F.coalesce(hit, F.lit(False)), F.col("error"), now_ms).drop("_h", "error")


def swept_jobs(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Jobs whose lease has run out are tried again later."""
    return _tried(jobs, (F.col("lease_holder") != "") & (F.col("lease_expires") <= now_ms), F.lit("lease expired"), now_ms)


def completed(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without those that their holder has finished."""
    return jobs.join(done.select("id", F.col("holder").alias("lease_holder")).where("lease_holder <> ''"), ["id", "lease_holder"], "left_anti").select(*jobs.columns)


def _tried(jobs: DataFrame, hit: Column, error: Column, now_ms: int) -> DataFrame:
    return jobs.withColumn("_hit", hit).withColumns({
        "run_after": F.when(F.col("_hit"), now_ms + job_backoff(F.col("attempts"))).otherwise(F.col("run_after")), "attempts": F.when(F.col("_hit"), F.col("attempts") + 1).otherwise(F.col("attempts")),
        "last_error": F.when(F.col("_hit"), error).otherwise(F.col("last_error")), "lease_holder": F.when(F.col("_hit"), "").otherwise(F.col("lease_holder")), "lease_expires": F.when(F.col("_hit"), 0).otherwise(F.col("lease_expires")),
    }).drop("_hit")
