"""Cutting lineage with tables in the folder all executors share.

Loops and tables that are read more than once are written here.  The folder
is ``spark.checkpoint.dir``; a local session without that setting gets a
temporary folder, a cluster without it is refused, as a folder of one machine
is lost with that machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):  # not local-cluster, which has several executors
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return _LOCAL[sc.applicationId]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of files when the session ends."""
    fs, target = _fs(spark, path)
    fs.deleteOnExit(target)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with no lineage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/graphloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    discard_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that a later staged table has replaced."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            fs, target = _fs(df.sparkSession, path)
            fs.delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores.

    For steps that need much computing per byte: a small compressed file would
    otherwise be one task.  Inputs of enough partitions, as any large one, aren't
    moved.
    """
    plan = df._jdf.queryExecution()
    if plan.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df  # it has shuffles; asking for its partitions would run them
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
