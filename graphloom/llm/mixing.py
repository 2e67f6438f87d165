"""Mixing sources to target weights along a time-varying curriculum.

In each mix a source has a share w and a weight schedule w(t) over training
time t in [0, 1], here w * (1 + tilt * z * (1 - 2t)), where z says how much
shorter than the mix's mean the source's documents are: short sources lead,
long ones follow, and the integral of w(t) is w.  A document's place in its
source's cumulative token demand, inverted through the integral of w(t), is its
training position; the result is range-sorted by position.

The total of a mix is the greatest one at which every source that has documents
meets its share with at most ``max_repeats`` uses of a document.  A greater
``budget`` may be asked for; sources at their cap then fall short, which the
shares report shows.

Prefix sums don't bring a source to one task: documents are put in pseudo-random
order, cut into buckets of about ``bucket_rows``, summed per bucket, and only the
bucket totals are accumulated per source.

Defined results: sources are compared without letter case and surrounding
blanks; documents without source or with a source without target are not used;
empty and null texts have no tokens and are not used; a target source without
documents is reported with 0 tokens, and the others share by their weights; a
null or negative weight counts as 0, a null max_repeats as 1; of targets given
twice the weights add up and the greater max_repeats holds; documents of equal
position are ordered by doc_id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import VOCABULARY_FOLDER, count_table
from graphloom.staging import stage

#: Plans of up to so many rows (a mix and a source each) are broadcast.
_PLAN_ROWS = 10_000


def source_name(c: Column) -> Column:
    name = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(name != "", name)


def sized(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that have tokens and a source, staged."""
    counted = count_table(documents.select("doc_id", source_name(F.col("source")).alias("source"), "text"), ["doc_id", "source"], "text", vocabulary, folder)
    return stage(counted.where("source is not null and n_tokens > 0"), "sizes")


def plan(sizes: DataFrame, targets: DataFrame, budget: int | None = None, tilt: float = 0.5) -> DataFrame:
    """Per mix and source: share, available and wanted tokens, and the slope of its schedule."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("documents"))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)
    wanted = (
        targets.select("mix", source_name(F.col("source")).alias("source"), weight.cast("double").alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        .where("source is not null")
        .groupBy("mix", "source")
        .agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    )
    mix = Window.partitionBy("mix")
    p = wanted.join(have, "source", "left").fillna(0, ["available", "documents"])
    p = p.withColumn("target_share", F.col("weight") / F.sum("weight").over(mix))
    usable = F.when((F.col("available") > 0) & (F.col("weight") > 0) & (F.col("max_repeats") > 0), F.col("weight"))
    p = p.withColumn("w", F.coalesce(usable / F.sum(usable).over(mix), F.lit(0.0)))
    most = F.col("available") * F.col("max_repeats")
    p = p.withColumn("total", F.lit(float(budget)) if budget else F.min(F.when(F.col("w") > 0, most / F.col("w"))).over(mix))
    p = p.withColumn("demand", F.when(F.col("w") > 0, F.least(F.col("w") * F.col("total"), most.cast("double"))).otherwise(0.0))
    p = p.withColumn("mean_tokens", F.when(F.col("documents") > 0, F.col("available") / F.col("documents")).otherwise(0.0))
    p = p.withColumn("lead", F.when(F.col("w") > 0, F.sum(F.col("w") * F.col("mean_tokens")).over(mix) - F.col("mean_tokens")).otherwise(0.0))
    top = F.max(F.abs(F.col("lead"))).over(mix)
    return p.withColumn("slope", F.when(top > 0, F.lit(float(tilt)) * F.col("lead") / top).otherwise(0.0)).drop("lead", "w", "total")


def training_time(place: Column, slope: Column) -> Column:
    """The t at which a share ``place`` of the demand is met: t + slope * (t - t^2) = place."""
    root = F.sqrt(F.greatest((1 + slope) * (1 + slope) - 4 * slope * place, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, place).otherwise(((1 + slope) - root) / (2 * slope))


def _prefix_sums(sizes: DataFrame, bucket_rows: int) -> DataFrame:
    """``sizes`` with the tokens that come before each document in its source's order."""
    buckets = max(1, -(-sizes.count() // bucket_rows))
    order = F.xxhash64("doc_id")
    at = F.floor((order.cast("double") / 2.0**64 + 0.5) * buckets).cast("int")
    rows = sizes.withColumns({"place": order, "bucket": F.least(at, F.lit(buckets - 1))})
    totals = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("run", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return run.join(offsets, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("offset") + F.col("run")).alias("before"))


def mixed(sizes: DataFrame, plans: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """(mix, source, doc_id, use, n_tokens, position) of every use of a document, by position."""
    small = plans.where("demand > 0").select("mix", "source", "available", "demand", "max_repeats", "slope")
    if plans.limit(_PLAN_ROWS + 1).count() <= _PLAN_ROWS:
        small = F.broadcast(small)
    rows = _prefix_sums(sizes, bucket_rows).join(small, "source")
    rounds = F.floor(F.col("demand") / F.col("available"))
    rest = F.col("demand") - rounds * F.col("available")
    uses = F.least(rounds + F.when(F.col("before") + F.col("n_tokens") / 2 < rest, 1).otherwise(0), F.col("max_repeats").cast("long"))
    used = rows.withColumn("uses", uses.cast("int")).where("uses > 0").withColumn("use", F.explode(F.sequence(F.lit(1), "uses")))
    place = F.least(((F.col("use") - 1) * F.col("available") + F.col("before") + F.col("n_tokens") / 2) / F.col("demand"), F.lit(1.0))
    out = used.select("mix", "source", "doc_id", "use", "n_tokens", training_time(place, F.col("slope")).alias("position"))
    return out.orderBy("mix", "position", "doc_id", "use")


def shares(uses: DataFrame, plans: DataFrame) -> DataFrame:
    """Per mix and source the target share, what was reached, and how."""
    got = uses.groupBy("mix", "source").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("used"), F.max("use").alias("repeats"))
    both = plans.select("mix", "source", "target_share", "available").join(got, ["mix", "source"], "left").fillna(0, ["tokens", "used", "repeats"])
    total = F.sum("tokens").over(Window.partitionBy("mix"))
    return both.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))
