"""Quality, cost and comparison of attempts, and usage of tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Points of a verdict and what a caveat costs.
VERDICTS = {"accepted": 1.0, "rework": 0.5, "rejected": 0.0}
CAVEAT_COST = {"coordinator_fixed": 0.35, "tests_weak": 0.4, "report_inaccurate": 0.25, "scope_missed": 0.3}
FLOOR = 0.1
LEAST_ATTEMPTS = 3


def quality(verdict: Column, caveats: Column) -> Column:
    """Verdict points less each different known caveat's cost, at least the floor; rejected is 0, an unknown verdict null."""
    base = F.when(verdict == "accepted", 1.0).when(verdict == "rework", 0.5).when(verdict == "rejected", 0.0)
    cost = F.aggregate(
        F.array_distinct(F.coalesce(caveats, F.array().cast("array<string>"))),
        F.lit(0.0),
        lambda a, x: a + F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in CAVEAT_COST.items()), F.lit(0.0)),
    )
    return F.when(verdict == "rejected", 0.0).otherwise(F.greatest(F.lit(FLOOR), base - cost) + F.when(base.isNull(), F.lit(None)).otherwise(0.0))


_LANCZOS = (676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers, by Lanczos' series."""
    y = x - 1
    s = np.full_like(y, 0.99999999999980993)
    for i, c in enumerate(_LANCZOS):
        s = s + c / (y + i + 1)
    t = y + 7.5
    return 0.5 * np.log(2 * np.pi) + (y + 0.5) * np.log(t) - t + np.log(s)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 200):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + up / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    inside = np.clip(x, 1e-15, 1 - 1e-15)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    left = front * _fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, inside, 1 - inside)) / np.where(low, a, b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, left, 1 - left)))


def beta_quantile(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """By 60 bisections."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (low + high) / 2
        below = beta_share(a, b, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


@pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def credible(total: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Bounds that hold nine tenths of the belief about a mean quality."""
    a, b = 1 + total.to_numpy(float), 1 + n.to_numpy(float) - total.to_numpy(float)
    return pd.DataFrame({"low": beta_quantile(a, b, 0.05), "high": beta_quantile(a, b, 0.95)})


def arms(attempts: DataFrame) -> DataFrame:
    """Per class, model and effort: attempts, mean quality, costs, coverage and shares."""
    rows = attempts.withColumn("q", quality(F.col("verdict"), F.col("caveats")))
    return rows.groupBy("task_class", "model_id", "effort").agg(
        F.count("q").alias("n"), F.sum("q").alias("total"), F.avg("q").alias("mean"), F.avg("cost_usd").alias("mean_cost"), F.sum("cost_usd").alias("cost"),
        (F.count("cost_usd") / F.count("*")).alias("coverage"), F.avg(F.when(F.size(F.coalesce("caveats", F.array().cast("array<string>"))) == 0, 1.0).otherwise(0.0)).alias("clean"),
        F.count_if(F.col("verdict") == "accepted").alias("accepted"), F.count_if(F.col("verdict") == "rework").alias("rework"), F.count_if(F.col("verdict") == "rejected").alias("rejected"),
    )


def intervals(stats: DataFrame) -> DataFrame:
    return stats.withColumn("i", credible(F.col("total").cast("double"), F.col("n").cast("double"))).select("*", "i.low", "i.high").drop("i")


def decisions(bounded: DataFrame, least: int = LEAST_ATTEMPTS) -> DataFrame:
    """Per class what the attempts say about its arms (model and effort).

    Arms of fewer than ``least`` attempts don't take part.  The leader has the best
    mean (ties: the smaller model and effort); as good as it are arms whose bounds
    overlap its own; the cheapest is the cheapest of those with a known cost, and a
    separation is pending while its mean is below the leader's.  ``answer`` is ok,
    insufficient_attempts, single_arm or no_cost_data.
    """
    w = Window.partitionBy("task_class")
    lead = F.min(F.when(F.col("n") >= least, F.struct((-F.col("mean")).alias("m"), "model_id", "effort", "low", "high"))).over(w)
    rows = bounded.withColumn("lead", lead).withColumn("fit", F.col("n") >= least)
    equal = F.col("fit") & (F.col("high") >= F.col("lead.low")) & (F.col("lead.high") >= F.col("low"))
    priced = F.when(equal & F.col("mean_cost").isNotNull(), F.struct("mean_cost", "model_id", "effort", "mean"))
    per = rows.groupBy("task_class").agg(F.first("lead").alias("lead"), F.count("*").alias("arms"), F.count_if("fit").alias("fit"), F.count_if(equal).alias("equal"), F.min(priced).alias("cheap"))
    answer = F.when(F.col("fit") == 0, "insufficient_attempts").when(F.col("fit") == 1, "single_arm").when(F.col("cheap").isNull(), "no_cost_data").otherwise("ok")
    ok = F.col("answer") == "ok"
    return per.withColumn("answer", answer).select(
        "task_class", "answer", F.col("lead.model_id").alias("leader"), "arms", "fit", "equal", F.when(ok, F.col("cheap.model_id")).alias("cheapest"),
        (ok & (F.col("cheap.mean") < -F.col("lead.m") - 1e-9)).alias("separation_pending"),
    )


def usage(messages: DataFrame, key: str, fields: tuple[str, ...], since: Column | None = None) -> DataFrame:
    """One row: each field's greatest value of every message, summed.

    Copies of a message repeat with growing counts, so the greatest holds.  A
    message without the first field is an error that the row counts.
    """
    rows = messages if since is None else messages.where(since)
    top = rows.groupBy(key).agg(*(F.max(f).alias(f) for f in fields))
    return top.agg(F.count("*").alias("messages"), F.count_if(F.col(fields[0]).isNull()).alias("broken"), *(F.sum(f).alias(f) for f in fields))


def agreement(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Compared, same class and same scope of ``class:scope`` texts; null and unknown ones are skipped."""
    both = rows.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull() & (F.col(predicted) != "unknown") & (F.col(actual) != "unknown"))

    def part(c: str, i: int) -> Column:
        return F.split_part(F.col(c), F.lit(":"), F.lit(i))

    return both.agg(F.count("*").alias("compared"), F.count_if(part(predicted, 1) == part(actual, 1)).alias("same_class"), F.count_if(part(predicted, 2) == part(actual, 2)).alias("same_scope"))
