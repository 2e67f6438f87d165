"""As-of and interval joins without cross products.

Time joins put both sides in one sorted stream per key and carry the last value
forward; spans are cut into cells of a fixed width and joined by equal cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], fallback: bool = False, cells: int = 64) -> DataFrame:
    """``left`` with the values of the latest row of ``right`` at or before its time.

    No pair of rows is ever formed: both sides go through one sorted stream that
    carries the last value forward.  A hot key is no single stream, as time is cut
    into ``cells``; what a cell starts with comes from the last values of the
    cells before, of which there are at most ``cells`` per key.  With
    ``fallback`` rows before the first value take the earliest one.
    """
    low, high = right.agg(F.min(right_time), F.max(right_time)).first()
    width = max(1, -(-(high - low + 1) // cells)) if low is not None else 1

    def cell(c: Column) -> Column:
        at = F.floor((c - F.lit(low if low is not None else 0)) / width)
        return F.greatest(F.lit(0), F.least(F.lit(cells), at)).cast("int")

    packed = F.struct(F.col(right_time).alias("_rt"), *values)
    kind = right.select(packed.alias("v")).schema["v"].dataType
    l = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_v": F.lit(None).cast(kind)})
    r = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_cell", cell(F.col("_t")))
    w = Window.partitionBy(key, "_cell").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    ends = both.groupBy(key, "_cell").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"), F.min_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_first"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    carried = ends.select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), F.last("_last", ignorenulls=True).over(before).alias("_held"), F.first("_first", ignorenulls=True).over(after).alias("_next"))
    out = within.join(carried, within[key].eqNullSafe(F.col("_k")) & (F.col("_cell") == F.col("_c")), "left")
    parts = [F.col("_v"), F.col("_held"), *([F.col("_next")] if fallback else [])]
    out = out.withColumn("_v", F.coalesce(*parts))
    return out.select(*left.columns, F.col("_v._rt").alias(f"asof_{right_time}"), *(F.col(f"_v.{v}").alias(f"asof_{v}") for v in values))


def overlapping(left: DataFrame, right: DataFrame, key: str, start: str, end: str, cell: int = 64) -> DataFrame:
    """Pairs of rows of one key whose closed spans overlap, each once.

    Columns of ``right`` get the prefix ``o_``.
    """
    def cells(df: DataFrame) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))

    r = cells(right).select(F.col(key).alias("_k"), F.col("_cell").alias("_c"), *(F.col(c).alias(f"o_{c}") for c in right.columns))
    l = cells(left)
    pairs = l.join(r, (l[key] == r["_k"]) & (l["_cell"] == r["_c"]) & (l[start] <= r[f"o_{end}"]) & (r[f"o_{start}"] <= l[end]))
    first = F.greatest(F.floor(F.col(start) / cell), F.floor(F.col(f"o_{start}") / cell))
    return pairs.where(F.col("_cell") == first).drop("_cell", "_c", "_k")


def containing(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, cell: int = 64) -> DataFrame:
    """Pairs of a point and each span that holds it."""
    s = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    p = points.withColumn("_cell", F.floor(F.col(point) / cell))
    return p.join(s, [key, "_cell"]).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end))).drop("_cell")


def smallest_containing(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, cell: int = 64) -> DataFrame:
    """Each point with the shortest span that holds it; of equal ones the later."""
    pairs = containing(points, spans, key, point, start, end, cell)
    w = Window.partitionBy(*points.columns).orderBy(F.col(end) - F.col(start), F.desc(start))
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
