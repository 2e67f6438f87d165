"""Streaming twins of the log merges.

State lives in tables: each micro-batch is merged into the last version of its
table and written as the next, keyed by the batch's number, so that a batch that
is run again after a failure writes the same version.  As all merges are
commutative and idempotent, late, repeated and out-of-order operations need no
watermark and are never dropped for lateness.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import oplog
from graphloom.staging import _fs, discard_at_exit, shared_root

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Operations as they arrive in the files of ``path``, ``files`` at a time."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    fs, target = _fs(spark, path)
    if fs.getFileStatus(target).isFile():
        reader, path = reader.option("pathGlobFilter", target.getName()), str(target.getParent())
    return reader.parquet(path)


class StateTable:
    """Versions of a table under a folder that all executors share.

    With a ``name`` that was used before, the last complete version is taken up
    again, so that a stream goes on after its driver was lost.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None) -> None:
        self.spark = spark
        self.path = f"{root or shared_root(spark)}/stream-{name}"
        self.version = max(self._complete(), default=-1)

    def _complete(self) -> list[int]:
        fs, folder = _fs(self.spark, self.path)
        if not fs.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
        found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return [v for v in found if fs.exists(_fs(self.spark, f"{self.path}/v{v}/_SUCCESS")[1])]

    def read(self) -> DataFrame | None:
        return None if self.version < 0 else self.spark.read.parquet(f"{self.path}/v{self.version}")

    def fold(self, merge: Merge) -> Callable[[DataFrame, int], None]:
        """A sink that merges each batch; the version before is kept until the next is written."""

        def write(batch: DataFrame, number: int) -> None:
            if number <= self.version:
                return
            merge(self.read(), batch).write.mode("overwrite").parquet(f"{self.path}/v{number}")
            self.version = number
            for old in self._complete():
                if old < number - 1:
                    fs, folder = _fs(self.spark, f"{self.path}/v{old}")
                    fs.delete(folder, True)

        return write


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there, batch by batch, and end."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def merge_registers(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Last writers with their clocks."""
    new = oplog.replica(batch)
    return new if state is None else oplog.joined(state, new)


def merge_counters(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Greatest total of each site, from which a counter is a sum."""
    new = batch.where("op = 'inc'").groupBy("entity_id", "field", "site_id").agg(F.max(F.expr("try_cast(value AS BIGINT)")).alias("v"))
    return new if state is None else state.unionByName(new).groupBy("entity_id", "field", "site_id").agg(F.max("v").alias("v"))


def merge_watermarks(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Greatest packed clock of each site; unknown sites simply appear."""
    new = oplog.watermarks(batch)
    return new if state is None else state.unionByName(new).groupBy("site_id").agg(F.max("hlc").alias("hlc"))


def merge_unique(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The op_ids seen; each counts once however often it arrives."""
    new = batch.select("op_id")
    return (new if state is None else state.unionByName(new)).distinct()


def merge_parked(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Operations and whether their entity exists by now.

    An operation on an entity that nothing has created yet is parked; the batch
    that creates the entity releases all that wait for it, in whatever order they
    came.
    """
    new = batch.where("op in ('set', 'inc')").select("op_id", "entity_id", ((F.col("op") == "set") & (F.col("field") == "kind")).alias("creates"))
    every = (new if state is None else state.drop("parked").unionByName(new)).groupBy("op_id", "entity_id").agg(F.bool_or("creates").alias("creates"))
    born = every.where("creates").select("entity_id").distinct().withColumn("born", F.lit(True))
    return every.join(born, "entity_id", "left").select("op_id", "entity_id", "creates", F.col("born").isNull().alias("parked"))


def merge_delta(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The union of what two sides push to each other, each operation once."""
    return oplog.unique(batch if state is None else state.unionByName(batch))


def merged(spark: SparkSession, path: str, name: str, merge: Merge) -> DataFrame:
    """The table after streaming all of ``path`` through ``merge``."""
    table = StateTable(spark, f"{name}-{uuid.uuid4().hex}")
    discard_at_exit(spark, table.path)
    run(source(spark, path), table.fold(merge), f"{table.path}/checkpoint")
    out = table.read()
    return out if out is not None else merge(None, spark.read.parquet(path))
