"""Quantised vectors, exact nearest neighbours and reranking.

Neighbours are found in two steps: the int8 codes of all rows against a block
of queries by matrix products per partition, of which each partition sends on
its best k, and the float vectors of the candidates.  More queries than a block
holds take several passes; the rows are all rows in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass over the rows.
BLOCK = 4096


def quantised(v: Column) -> Column:
    """round(127 * v / max |v|), halves up, between -127 and 127; not-finite values give null."""
    top = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(v, lambda x: F.when(top > 0, F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / top * 127 + 0.5)))).otherwise(0).cast("int"))
    return F.when(~bad, q)


def dequantised(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale / 127)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0; vectors of unequal length give null."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(0.0))


def normalised(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def _blocks(queries: DataFrame, key: str, columns: list[Column], block: int, known: int | None = None) -> Iterator[pa.Table]:
    """The queries in tables of at most ``block`` rows, split by a hash of their key until they fit."""
    n = queries.count() if known is None else known
    if n <= block:
        if n:
            yield queries.select(*columns).orderBy(key).toArrow()
        return
    parts = -(-n // block) + 1
    sized = queries.withColumn("_part", F.pmod(F.xxhash64(F.lit(n), F.col(key)), F.lit(parts)).cast("int"))
    for row in sized.groupBy("_part").count().orderBy("_part").collect():  # a count per block
        yield from _blocks(sized.where(F.col("_part") == row["_part"]).drop("_part"), key, columns, block, row["count"])


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the wanted width as rows, and which of the column they are."""
    sizes = np.diff(column.offsets.to_numpy())
    fit = (sizes == width) & ~np.asarray(column.is_null())
    flat = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width), np.flatnonzero(fit)


def _distances(m: np.ndarray, squares: np.ndarray, x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(squares[:, None] * (x * x).sum(1)[None])
    return 1 - np.divide(m @ x.T, norm, out=np.zeros((len(m), len(x))), where=norm > 0)


def nearest(rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 200, block: int = BLOCK) -> DataFrame:
    """(query, id, distance): the k nearest rows of each query by int8 cosine distance.

    Ties are broken by the smaller id.  Any number of queries; each ``block`` of
    them is one pass over the rows.
    """
    coded = rows.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v"))
    asked = queries.select(F.col(key).cast("long").alias("q"), quantised(F.col(vector)).alias("v")).where("v is not null")
    out = None
    for table in _blocks(asked, "q", [F.col("q"), F.col("v")], block):
        found = _nearest_block(coded, table, k)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else coded.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("distance")).where("false")


def _nearest_block(coded: DataFrame, table: pa.Table, k: int) -> DataFrame:
    matrix = np.array(table["v"].to_pylist(), np.float64)
    shared = coded.sparkSession.sparkContext.broadcast((matrix, (matrix * matrix).sum(1), table["q"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, squares, qs = shared.value
        best_d, best_i = np.full((len(qs), 0), 0.0), np.zeros((len(qs), 0), np.int64)
        for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
            x, at = _matrix(batch.column(1), m.shape[1])
            if not len(at):
                continue
            d = _distances(m, squares, x)
            best_d, best_i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(batch.column(0).to_numpy()[at], d.shape)])
            order = np.lexsort((best_i, best_d))[:, :k]
            best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
        n = best_d.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, n)), pa.array(best_i.ravel()), pa.array(best_d.ravel())], ["query", "id", "distance"])

    found = coded.mapInArrow(run, "query long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def nearest_in(rows: DataFrame, queries: DataFrame, scopes: list[str], layers: tuple[int, int], **options: object) -> DataFrame:
    """:func:`nearest` among the rows of some scopes and a range of layers, which the scan filters.

    No scopes, or layers from a greater to a smaller one, are a ValueError.
    """
    if not scopes:
        raise ValueError("vector search needs at least one scope")
    if layers[0] > layers[1]:
        raise ValueError(f"no layers between {layers[0]} and {layers[1]}")
    return nearest(rows.where(F.col("scope").isin(*scopes) & F.col("layer").between(*layers)), queries, **options)


def separation(rows: DataFrame, queries: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, best, near, far, better): cosines of each query to other rows of its label and of others.

    ``best`` and ``near`` are the greatest and mean cosine within the label, ``far`` the
    mean without, ``better`` how many rows without it beat ``best``.  Sums are taken
    within the products, first for the means, then for the rank; no pair is emitted.
    """
    coded = rows.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), F.col(label).cast("string").alias("l")).where("l is not null")
    asked = queries.select(F.col(key).cast("long").alias("q"), quantised(F.col(vector)).alias("v"), F.col(label).cast("string").alias("l")).where("v is not null and l is not null")
    out = None
    for table in _blocks(asked, "q", [F.col("q"), F.col("v"), F.col("l")], block):
        matrix, qs, ls = np.array(table["v"].to_pylist(), np.float64), table["q"].to_numpy(), np.array(table["l"].to_pylist(), object)
        shared = coded.sparkSession.sparkContext.broadcast((matrix, (matrix * matrix).sum(1), qs, ls))

        def passes(bests: np.ndarray | None, shared=shared) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                m, squares, names, own = shared.value
                total = np.zeros((5, len(names)))
                total[4] = -np.inf
                for batch in (whole.slice(at, 2000) for whole in batches for at in range(0, whole.num_rows, 2000)):
                    x, at = _matrix(batch.column(1), m.shape[1])
                    if not len(at):
                        continue
                    cos = 1 - _distances(m, squares, x)
                    near = own[:, None] == np.array(batch.column(2).to_pylist(), object)[at][None]
                    self_ = names[:, None] == batch.column(0).to_numpy()[at][None]
                    near, far = near & ~self_, ~near
                    if bests is None:
                        total[:4] += [np.where(near, cos, 0).sum(1), near.sum(1), np.where(far, cos, 0).sum(1), far.sum(1)]
                        total[4] = np.maximum(total[4], np.where(near, cos, -np.inf).max(1))
                    else:
                        total[0] += (far & (cos > bests[:, None])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(t) for t in total)], ["query", "a", "b", "c", "d", "e"])

            sums = coded.mapInArrow(run, "query long, a double, b double, c double, d double, e double")
            return sums.groupBy("query").agg(*(F.sum(x).alias(x) for x in "abcd"), F.max("e").alias("e"))

        first = passes(None).orderBy("query").toArrow()  # a row per query of the block
        order = np.searchsorted(first["query"].to_numpy(), qs)
        bests = np.where(first["b"].to_numpy() > 0, first["e"].to_numpy(), np.inf)[order]
        means = coded.sparkSession.createDataFrame(first.to_pandas())
        ranks = passes(bests).select("query", F.col("a").cast("long").alias("better"))
        part = means.join(ranks, "query").select("query", F.when(F.col("b") > 0, F.col("e")).alias("best"), F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("near"), F.when(F.col("d") > 0, F.col("c") / F.col("d")).alias("far"), "better")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query long, best double, near double, far double, better long")


def reranked(candidates: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Candidates with the float distance where both vectors exist, else the int8 one, and the new rank."""
    v = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    both = candidates.join(v, "id", "left").join(v.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query", "left")
    exact = F.coalesce(1 - cosine(F.col("v"), F.col("qv")), F.col("distance"))
    out = both.select("query", "id", exact.alias("distance"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id")))


def confidence(found: DataFrame) -> DataFrame:
    """``found`` with z = (mean - distance) / std over a query's candidates; null under three or without spread."""
    w = Window.partitionBy("query")
    mean, std, n = F.avg("distance").over(w), F.stddev_pop("distance").over(w), F.count("*").over(w)
    return found.withColumn("z", F.when((n >= 3) & (std > 0), (mean - F.col("distance")) / std))
