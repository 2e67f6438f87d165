"""Best representative of each group of records of one fact.

Two operators.  :func:`last_filled` gives the survivor that the data's owners
ask for: each attribute from the member that fills it and was updated last.
:func:`fused` is Bayesian fusion with copy detection, for sources of unequal
trust: source accuracies, dependence from shared false values, discounted votes
and the value of maximum posterior.

A group is two or more live ids of equal scope, kind and content hash, where the
hash counts up to a colon and without letter case.

Defined results: records without hash are in no group, null scopes (kinds) count
as equal; repeated rows and older states of an id don't count; an attrs that is
null or no JSON object fills nothing; an attribute that no member fills is left
out; updated_at is compared in whole milliseconds, null lowest; equal instants
go to the smaller id; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.staging import release, stage

#: Texts that stand for "not known", without letter case.
STAND_INS = ("", "-", "--", "?", "??", "n/a", "na", "nan", "nil", "none", "null", "not known", "tba", "tbd", "undefined", "unknown", "unset")

GROUP = ["scope", "kind", "content_hash"]


def in_milliseconds(c: Column) -> Column:
    """An epoch time in seconds, milli-, micro- or nanoseconds as whole milliseconds."""
    size = F.abs(c)
    return (
        F.when(size < 100_000_000_000, c * 1000)
        .when(size < 100_000_000_000_000, c)
        .when(size < 100_000_000_000_000_000, F.floor(c / F.lit(1000).cast("decimal(20,0)")).cast("long"))
        .otherwise(F.floor(c / F.lit(1_000_000).cast("decimal(20,0)")).cast("long"))
    )


def tells(value: Column) -> Column:
    """Whether the JSON text of a value says anything."""
    inner = F.lower(F.regexp_replace(F.regexp_replace(value, r'^"|"$', ""), r"(?U)^(\s|\\[nrtf])+|(\s|\\[nrtf])+$", ""))
    return ~inner.isin(*STAND_INS) & ~F.regexp_replace(value, r"\s", "").isin("[]", "{}", "null")


def members(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The row of each live id with its group and instant."""
    columns = ["scope", "kind", "content_hash", "attrs", "updated_at", "deleted_at", *keep]
    columns = list(dict.fromkeys(columns))
    newest = nodes.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("hlc", "site_id")).alias("r")).where("r.deleted_at is null")
    code = F.lower(F.substring_index("r.content_hash", ":", 1))
    rows = newest.select(
        "id", "r.scope", "r.kind", code.alias("content_hash"), "r.attrs", in_milliseconds(F.col("r.updated_at")).alias("instant"), *(f"r.{c}" for c in keep)
    )
    return rows.where("content_hash <> ''")


def _fields(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per member and filled attribute; ``value`` is JSON text."""
    each = rows.select(*GROUP, "id", "instant", *keep, F.explode(F.from_json("attrs", "map<string,variant>")).alias("field", "v"))
    return each.withColumn("value", F.coalesce(F.to_json("v"), F.lit("null"))).drop("v").where(tells(F.col("value")))


def last_filled(nodes: DataFrame) -> DataFrame:
    """(scope, kind, content_hash, field, id, value): who gives each attribute of each group.

    Members of a hot group are reduced before they move: a group's size and its
    last filler of each attribute are maxima and counts.
    """
    rows = members(nodes)
    marks = rows.select(*GROUP, F.lit(None).cast("string").alias("field"), "id", "instant", F.lit(None).cast("string").alias("value"))
    both = _fields(rows).select(*GROUP, "field", "id", "instant", "value").unionByName(marks)
    last = both.groupBy(*GROUP, "field").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "value"), F.struct(-F.coalesce("instant", F.lit(-(2**62))), "id")).alias("w"))
    size = F.max(F.when(F.col("field").isNull(), F.col("n"))).over(Window.partitionBy(*GROUP))
    return last.withColumn("size", size).where("size >= 2 and field is not null").select(*GROUP, "field", "w.id", "w.value")


def surviving_records(nodes: DataFrame) -> DataFrame:
    """One record per group: its attrs put together, and how many members gave a field."""
    entry = F.concat(F.to_json(F.array("field")).substr(F.lit(2), F.length(F.to_json(F.array("field"))) - 2), F.lit(":"), "value")
    return last_filled(nodes).groupBy(*GROUP).agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("attrs"), F.count_distinct("id").alias("givers")
    )


def _dependence(pairs: DataFrame, n_false: int, copy_rate: float, prior: float) -> DataFrame:
    """(a, b, dep): the probability that one of two sources copies from the other.

    Shared true values say little, shared false ones much: ``same_true``,
    ``same_false`` and ``other`` are the expected numbers of each kind.
    """
    true, false = F.col("acc_a") * F.col("acc_b"), (1 - F.col("acc_a")) * (1 - F.col("acc_b")) / n_false
    mean = (F.col("acc_a") + F.col("acc_b")) / 2

    def ratio(copied: Column, alone: Column) -> Column:
        return F.log(copy_rate * copied / alone + (1 - copy_rate))

    gain = F.sum(F.col("same_true") * ratio(mean, true) + F.col("same_false") * ratio((1 - mean), false) + F.col("other") * F.log(F.lit(1 - copy_rate)))
    odds = F.lit(prior / (1 - prior)) * F.exp(F.least(gain, F.lit(50.0)))
    return pairs.groupBy("a", "b").agg((odds / (1 + odds)).alias("dep"))


def fused(nodes: DataFrame, source: str = "site_id", rounds: int = 4, n_false: int = 10, copy_rate: float = 0.8, prior: float = 0.2) -> DataFrame:
    """(scope, kind, content_hash, field, value, posterior) of maximum posterior.

    One claim counts per item (group and attribute) and source, its latest, so an
    item has at most as many claims as there are sources, however many members
    the group has; pairs are pairs of sources of one item.  The first round finds
    dependence by agreement alone, as it can't tell true from false yet, the second votes without copies,
    and only then accuracies are learned; so at least two rounds are needed.
    """
    rows = members(nodes, (source,))
    key = F.to_json(F.struct(*GROUP)).alias("group")  # one key that isn't null, so that joins keep null scopes and kinds
    item = ["group", "field"]
    size = rows.groupBy(key).agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    claims = _fields(rows, source).where(F.col(source).isNotNull()).groupBy(key, "field", F.col(source).alias("source")).agg(F.min_by("value", F.struct(-F.coalesce("instant", F.lit(-(2**62))), "id")).alias("value"))
    claims = stage(claims.join(size, "group", "left_semi"), "claims")
    trust = claims.select("source").distinct().withColumn("acc", F.lit(0.8))
    dep = None
    judged, old, last_trust = None, None, None
    for turn in range(rounds):
        known = claims.join(trust, "source")
        power = F.log(F.lit(float(n_false)) * F.col("acc") / (1 - F.col("acc")))
        if dep is None:
            weighed = known.withColumn("free", F.lit(1.0))
        else:
            earlier = known.select(*item, "value", F.col("source").alias("other"), F.col("acc").alias("other_acc"))
            first = (F.col("other_acc") > F.col("acc")) | ((F.col("other_acc") == F.col("acc")) & (F.col("other") < F.col("source")))
            copied = (
                known.join(earlier, [*item, "value"])
                .where(first)
                .withColumns({"a": F.least("source", "other"), "b": F.greatest("source", "other")})
                .join(dep, ["a", "b"])
                .groupBy(*item, "source")
                .agg(F.exp(F.sum(F.log(1 - F.lit(copy_rate) * F.least("dep", F.lit(0.999))))).alias("free"))
            )
            weighed = known.join(copied, [*item, "source"], "left").fillna(1.0, ["free"])
        votes = weighed.groupBy(*item, "value").agg(F.sum(power * F.col("free")).alias("score"), F.collect_set("source").alias("sources"))
        each = Window.partitionBy(*item)
        top = F.max("score").over(each)
        unseen = F.greatest(F.lit(n_false + 1) - F.count("*").over(each), F.lit(0)) * F.exp(-top)
        mass = F.exp(F.col("score") - top)
        judged = stage(votes.withColumn("posterior", mass / (F.sum(mass).over(each) + unseen)).drop("score"), "judged")
        if turn == rounds - 1:
            break
        by_source = judged.select(*item, "value", "posterior", F.explode("sources").alias("source"))
        if turn:  # accuracies judged by copied votes would confirm the copies
            trust = stage(by_source.groupBy("source").agg(F.least(F.greatest(F.avg("posterior"), F.lit(0.05)), F.lit(0.95)).alias("acc")), "trust")
        a = by_source.join(trust, "source").select(*item, F.col("source").alias("a"), F.col("value").alias("va"), F.col("acc").alias("acc_a"), "posterior")
        b = by_source.join(trust, "source").select(*item, F.col("source").alias("b"), F.col("value").alias("vb"), F.col("acc").alias("acc_b"))
        same = F.col("va") == F.col("vb")
        told = F.col("posterior") if turn else F.lit(1.0)
        pairs = a.join(b, item).where("a < b").select(
            "a", "b", "acc_a", "acc_b",
            F.when(same, told).otherwise(0.0).alias("same_true"), F.when(same, 1 - told).otherwise(0.0).alias("same_false"), F.when(same, 0.0).otherwise(1.0).alias("other"),
        )
        last_dep, dep = dep, stage(_dependence(pairs, n_false, copy_rate, prior), "dependence")
        release(old, last_dep, last_trust if turn else None)
        old, last_trust = judged, trust
    release(claims, dep, trust, old)
    best = F.row_number().over(Window.partitionBy(*item).orderBy(F.desc("posterior"), "value"))
    return judged.withColumn("best", best).where("best = 1").select(*(F.get_json_object("group", f"$.{c}").alias(c) for c in GROUP), "field", "value", "posterior")
