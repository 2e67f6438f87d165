from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import survivors as sv

NODE = "id string, scope string, kind string, content_hash string, attrs string, updated_at long, deleted_at long, hlc long, site_id string, field string, value string, n string"


def rows(spark, data):
    return spark.createDataFrame([(i, "s", "note", h, a, u, d, hlc, site, "clash", "clash", "clash") for i, h, a, u, d, hlc, site in data], NODE)


def found(spark, data):
    return {(r["content_hash"], r["field"]): r["id"] for r in sv.last_filled(rows(spark, data)).collect()}


def test_last_filler_of_each_key(spark):
    data = [
        ("a", "AB:x", '{"k": 1, "m": "TBD", "z": "x"}', 1_700_000_000, None, 1, "s"),
        ("b", "ab", '{"k": 2, "m": [], "n": ["q"], "z": " "}', 1_700_000_000_001, None, 1, "s"),
        ("c", "ab", '{"k": 3}', 1_700_000_000_001_999, None, 1, "s"),
        ("d", "ab", '{"k": 9, "dead": 1}', 1_800_000_000_000, 5, 1, "s"),
        ("e", "alone", '{"k": 9}', 1, None, 1, "s"),
        ("b", "ab", '{"old": 1}', 1_900_000_000_000, None, 0, "s"),
    ]
    assert found(spark, data * 2) == {("ab", "k"): "b", ("ab", "n"): "b", ("ab", "z"): "a"}


@pytest.mark.parametrize("value", [None, "", " ", "?", "-", "N/A", "n/a", "none", "null", "TBD", "unknown", [], {}])
def test_what_says_nothing(spark, value):
    data = [("a", "h", json.dumps({"k": value}), 9, None, 1, "s"), ("b", "h", '{"k": 0}', 1, None, 1, "s")]
    assert found(spark, data) == {("h", "k"): "b"}


def test_nulls_malformed_and_empty(spark):
    assert found(spark, []) == {}
    data = [("a", None, '{"k": 1}', 1, None, 1, "s"), ("b", "h", None, None, None, None, None), ("c", "h", "[1]", 1, None, 1, "s"), ("d", "h", "{bad", 1, None, 1, "s"), ("e", "h", '{"k": false}', None, None, 1, "s"), (None, "h", '{"k": 1}', 1, None, 1, "s")]
    assert found(spark, data) == {("h", "k"): "e"}


def test_record_is_put_together(spark):
    data = [("a", "h", '{"k": "q\\"uote", "o": {"x": [1]}}', 2, None, 1, "s"), ("b", "h", '{"k": "old", "t": true}', 1, None, 1, "s")]
    r = sv.surviving_records(rows(spark, data)).first()
    assert json.loads(r["attrs"]) == {"k": 'q"uote', "o": {"x": [1]}, "t": True} and r["givers"] == 2


def test_fusion_discounts_copies(spark):
    """Three independent good sources against four that copy one bad source."""
    rng = random.Random(6)
    data, truth = [], {}
    for g in range(80):
        truth[g] = f"t{g}"
        bad = f"f{g}-{rng.randrange(9)}" if rng.random() < 0.7 else truth[g]
        for s in range(3):
            v = truth[g] if rng.random() < 0.85 else f"e{g}-{s}-{rng.randrange(9)}"
            data.append((f"g{g}s{s}", f"h{g}", json.dumps({"k": v}), 1, None, 1, f"good{s}"))
        data += [(f"g{g}c{s}", f"h{g}", json.dumps({"k": bad}), 1, None, 1, f"copy{s}") for s in range(4)]
    got = sv.fused(rows(spark, data), rounds=4).select(F.col("content_hash").alias("h"), "value").collect()
    right = sum(json.loads(r["value"]) == truth[int(r["h"][1:])] for r in got)
    votes = 0
    for g in range(80):
        claims = [json.loads(a)["k"] for i, h, a, *_ in data if h == f"h{g}"]
        votes += max(sorted(set(claims)), key=claims.count) == truth[g]
    assert len(got) == 80 and right > votes and right >= 70
