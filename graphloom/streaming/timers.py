"""Leases and retries as timers of keyed state, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE_OUT = "task string, holder string, state string"
LEASE_STATE = "holder string, until long"


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    task = key[0]
    if state.hasTimedOut:
        holder, _ = state.get
        state.remove()
        yield pd.DataFrame([(task, holder, "expired")], columns=["task", "holder", "state"])
        return
    holder, until = state.get if state.exists else (None, 0)
    out = []
    for batch in batches:
        for r in batch.sort_values("at").itertuples(index=False):
            if r.action == "claim" and (holder is None or r.at >= until):
                holder, until = r.holder, r.at + r.lease
                out.append((task, holder, "claimed"))
            elif r.action == "renew" and r.holder == holder and r.at < until:
                until = r.at + r.lease
                out.append((task, holder, "renewed"))
            elif r.action == "release" and r.holder == holder:
                out.append((task, holder, "released"))
                holder, until = None, 0
            else:
                out.append((task, r.holder, "refused"))
    if holder is None:
        if state.exists:
            state.remove()
    else:
        state.update((holder, int(until)))
        mark = state.getCurrentWatermarkMs()
        if until > mark:
            state.setTimeoutTimestamp(int(until))
    yield pd.DataFrame(out, columns=["task", "holder", "state"])


def leases(requests: DataFrame) -> DataFrame:
    """What becomes of claim, renew and release requests, and leases that run out.

    ``requests`` is a stream of task, holder, action, at (ms), lease (ms), ts with
    a watermark on ts; a lease expires when the watermark passes its end.
    """
    return requests.groupBy("task").applyInPandasWithState(_lease, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


RETRY_OUT = "job string, attempt int, due long, state string"
RETRY_STATE = "attempts int"


def backoff_ms(attempts: int) -> int:
    return min(300_000, 1000 * 2 ** min(attempts, 20))


def _retry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempts = state.get[0] if state.exists else 0
    out = []
    for batch in batches:
        for r in batch.sort_values("at").itertuples(index=False):
            if r.ok:
                out.append((key[0], attempts, int(r.at), "done"))
                attempts = 0
            else:
                attempts += 1
                dead = attempts >= 5
                out.append((key[0], attempts, int(r.at) + backoff_ms(attempts - 1), "dead" if dead else "waiting"))
    state.update((attempts,))
    yield pd.DataFrame(out, columns=["job", "attempt", "due", "state"])


def retries(results: DataFrame) -> DataFrame:
    """Next due time of each failed job, doubling up to five minutes; the fifth failure is the last."""
    return results.groupBy("job").applyInPandasWithState(_retry, RETRY_OUT, RETRY_STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count and sum per window and type; works on a stream and on a table alike."""
    w = F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    return events.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n")
