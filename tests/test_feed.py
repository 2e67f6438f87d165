from __future__ import annotations

import random

from graphloom.operators import feed, oplog
from graphloom.streaming import log as stream

OPS = "op_id string, seq long, hlc struct<ts: long, ctr: int>, site_id string, entity_id string, op string, field string, value string, arrived_at timestamp, clock string, part string"


def op(i, ts, site, entity, kind, field, value, ctr=0):
    return (i, 1, (ts, ctr), site, entity, kind, field, value, None, "clash", "clash")


def state(spark, ops):
    return sorted(tuple(r) for r in feed.current_state(spark.createDataFrame(ops, OPS)).drop("what").collect())


def test_golden(spark):
    ops = [
        op("s1:1", 5, "s1", "e", "set", "a", "1"), op("s2:1", 5, "s2", "e", "set", "a", "2"), op("s3:1", 4, "s9", "e", "set", "a", "9", 7),
        op("s1:2", 1, "s1", "e", "inc", "n", "3"), op("s1:3", 2, "s1", "e", "inc", "n", "2"), op("s2:2", 1, "s2", "e", "inc", "n", "4"),
        op("t1", 1, "s1", "e|r|f", "edge_add", "r", '{"tag": "t1"}'), op("t2", 2, "s1", "e|r|f", "edge_add", "r", '{"tag": "t2"}'), op("d1", 3, "s1", "e|r|f", "edge_del", "r", '{"tags": ["t1"]}'),
        op("u1", 9, "s1", "e|r|g", "edge_add", "r", '{"tag": "u1"}'), op("d2", 1, "s1", "e|r|g", "edge_del", "r", '{"tags":["u1"]}'),
        op("v1", 9, "s1", "e|r|gone", "edge_add", "r", '{"tag": "v1"}'), op("p1", 1, "s1", "gone", "purge", "", "null"), op("w1", 99, "s1", "gone", "set", "a", "1"),
        op("n1", 3, "s1", "e", "set", "b", None),
    ]
    want = [("e", "a", "s2:1"), ("e", "b", "n1"), ("e", "n", "7"), ("e|r|f", "r", "t2")]
    assert state(spark, ops) == want
    rng = random.Random(1)
    for _ in range(3):
        again = ops + rng.sample(ops, 6)
        rng.shuffle(again)
        assert state(spark, again) == want


def test_nulls_malformed_and_empty(spark):
    assert state(spark, []) == []
    ops = [
        op(None, 1, "s", "e", "set", "a", "1"), op("x", None, None, None, None, None, None), op("i", 1, "s", "e", "inc", "n", "many"),
        op("g", 1, "s", "e|r|f", "edge_add", "r", "{broken"), op("h", 1, "s", "e|r|f", "edge_del", "r", "{broken"), op("k", 1, "s", "e", "set", None, "1"),
    ]
    assert state(spark, ops) == [("e", "", "k"), ("e|r|f", "r", "g")]


def test_replicas_join_as_one_log(spark, small):
    ops = spark.read.parquet(f"{small}/oplog.parquet")
    whole = {tuple(r) for r in oplog.replica(ops).collect()}
    a, b, c = (oplog.replica(ops.where(f"abs(hash(op_id)) % 3 = {i}")) for i in range(3))
    assert {tuple(r) for r in oplog.joined(oplog.joined(a, b), c).collect()} == whole == {tuple(r) for r in oplog.joined(c, oplog.joined(b, a)).collect()}


def test_stream_in_pieces_is_the_batch(spark, small, tmp_path):
    ops = spark.read.parquet(f"{small}/oplog.parquet")
    ops.repartition(5).write.parquet(str(tmp_path / "ops"))
    got = stream.merged(spark, str(tmp_path / "ops"), "test", stream.merge_registers)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in oplog.replica(ops).collect()}
    parked = stream.merged(spark, str(tmp_path / "ops"), "parked", stream.merge_parked).where("parked")
    assert {r[0] for r in parked.select("op_id").collect()} == {r[0] for r in oplog.parked(ops).select("op_id").collect()}


def test_clock():
    assert oplog.ticked([(10, None), (10, None), (9, None), (12, (20, 3)), (12, None), (12, (12 + 900_000, 1))]) == [(10, 0), (10, 1), (10, 2), (20, 4), (20, 5), (12 + oplog.SKEW_MS, 1)]


def test_stream_goes_on_after_a_restart(spark, small, tmp_path):
    ops = spark.read.parquet(f"{small}/oplog.parquet").repartition(4)
    ops.where("seq % 2 = 0").write.mode("append").parquet(str(tmp_path / "ops"))
    for half in (None, "seq % 2 = 1"):
        if half:
            ops.where(half).write.mode("append").parquet(str(tmp_path / "ops"))
        table = stream.StateTable(spark, "again", f"file://{tmp_path}")
        stream.run(stream.source(spark, str(tmp_path / "ops")), table.fold(stream.merge_registers), f"file://{tmp_path}/checkpoint")
    last = table.version
    table.fold(stream.merge_registers)(ops.limit(0), last)
    assert last > 0 and {tuple(r) for r in table.read().collect()} == {tuple(r) for r in oplog.replica(ops).collect()}
