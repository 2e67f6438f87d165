"""Connected components of an undirected graph of any shape.

Alternating large-star and small-star rounds: each round moves ids to smaller
neighbours, and a round that changes nothing ends it; the number of rounds grows
with the logarithm of the diameter.  Neighbourhoods are only ever reduced to
their minimum (map-side), never gathered, so that a hub is no problem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.staging import release, stage


def connected_components(pairs: DataFrame) -> DataFrame:
    """(id, comp) of every id in the two columns of ``pairs``; comp is the smallest id.

    Loops, repeated pairs and either direction are allowed; a null end drops its
    pair; no pairs give no rows.
    """
    first, second = pairs.columns[:2]
    whole = pairs.select(F.col(first).alias("u"), F.col(second).alias("v")).where("u is not null and v is not null")
    ids = stage(whole.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")
    links = stage(whole.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    seen = None
    while True:
        ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        step = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "star")
        now = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(links)
        links = step
        if now == seen:
            break
        seen = now
    return ids.join(links.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
