from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing

SIZES = "doc_id long, source string, n_tokens long"
TARGET = "mix string, source string, weight double, max_repeats int, demand string"


@pytest.fixture
def sizes(spark):
    rows = [(i, "big", 50 + i % 40) for i in range(3000)] + [(10_000 + i, "small", 200) for i in range(40)] + [(20_000 + i, "unwanted", 9) for i in range(50)]
    return spark.createDataFrame(rows, SIZES)


def targets(spark, *rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGET)


def test_shares_repeats_and_order(spark, sizes):
    plans = mixing.plan(sizes, targets(spark, ("m", "BIG ", 3.0, 2), ("m", "small", 1.0, 4), ("m", "none", 1.0, 4), ("other", "big", 1.0, None)))
    uses = mixing.mixed(sizes, plans, bucket_rows=100).collect()
    got = {(r["mix"], r["source"]): r for r in mixing.shares(spark.createDataFrame(uses), plans).collect()}
    assert got["m", "big"]["actual_share"] == pytest.approx(0.75, abs=0.01) and got["m", "small"]["actual_share"] == pytest.approx(0.25, abs=0.01)
    assert got["m", "none"]["tokens"] == 0 and got["m", "none"]["target_share"] == pytest.approx(0.2)
    assert got["m", "small"]["repeats"] == 4 and got["m", "small"]["tokens"] == 4 * 40 * 200
    each = Counter((r["mix"], r["doc_id"]) for r in uses)
    assert max(v for (m, d), v in each.items() if d >= 10_000) == 4 and max(v for (m, d), v in each.items() if d < 10_000) <= 2
    assert not any(r["doc_id"] >= 20_000 for r in uses) and sum(r["mix"] == "other" for r in uses) == 3000
    order = [(r["mix"], r["position"], r["doc_id"], r["use"]) for r in uses]
    assert order == sorted(order) and all(0 <= r["position"] <= 1 for r in uses)


def test_budget_beyond_the_cap(spark, sizes):
    plans = mixing.plan(sizes, targets(spark, ("m", "big", 1.0, 1), ("m", "small", 1.0, 1)), budget=10**6)
    got = {r["source"]: r for r in mixing.shares(mixing.mixed(sizes, plans), plans).collect()}
    assert got["small"]["tokens"] == 8000 and got["big"]["used"] == 3000


def test_positions_follow_the_schedule(spark):
    """The share of a source up to time t is the integral of its schedule."""
    for slope in (-0.5, 0.0, 0.5):
        df = spark.range(1001).select((F.col("id") / 1000).alias("u")).select("u", mixing.training_time(F.col("u"), F.lit(slope)).alias("t"))
        assert all(abs(r["t"] + slope * (r["t"] - r["t"] ** 2) - r["u"]) < 1e-9 for r in df.collect())


def test_prefix_sums_do_not_depend_on_buckets(spark, sizes):
    a, b = ({r["doc_id"]: r["before"] for r in mixing._prefix_sums(sizes, n).collect()} for n in (7, 10**6))
    assert a == b
    of_big = sorted((a[r["doc_id"]], r["n_tokens"]) for r in sizes.where("source = 'big'").collect())
    assert all(x + n == y for (x, n), (y, _) in zip(of_big, of_big[1:], strict=False))


def test_documents_to_mix(spark):
    docs = spark.createDataFrame([(1, "some words", " Task", 1, 2.0), (2, None, "task", 1, 2.0), (3, "", "task", 1, 2.0), (4, "lost", None, 1, 2.0), (5, "x" * 50_000, "TASK", 1, 2.0)], "doc_id long, text string, source string, n_tokens int, weight double")
    sizes = mixing.sized(docs)
    assert {r["doc_id"] for r in sizes.collect()} == {1, 5}
    plans = mixing.plan(sizes, targets(spark, ("m", "task", 1.0, 2), ("m", None, 1.0, 2), ("n", "task", -1.0, 2), ("k", "task", None, None)))
    assert {r["mix"] for r in mixing.mixed(sizes, plans).collect()} == {"m"}
    assert mixing.mixed(sizes.where("false"), mixing.plan(sizes.where("false"), targets(spark, ("m", "task", 1.0, 2)))).count() == 0
