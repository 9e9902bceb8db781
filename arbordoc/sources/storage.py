"""The shared folder, and tables that are written once to be read several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "/tmp/arbordoc-shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Estimated bytes below which a table stays in the pieces it lies in.
SMALL = 64 << 10


def spread(df: DataFrame) -> DataFrame:
    """df in pieces for all cores before Python works on its rows, where a scan gives fewer.

    Files are split by bytes and row groups, but rows that compress to a few bytes take as long as others: a million rows of a
    table in 5 MB were the work of two tasks. What comes from a shuffle, a stream, a small or a large table stays as it is.
    """
    if df.isStreaming:
        return df
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    if size < SMALL or size > cores << 28 or "Exchange" in plan.executedPlan().toString():
        return df
    return df.repartition(4 * cores)


#: Bytes of a plan's files that one task of a shuffle gets.
PIECE = 4 << 20


def pieces(df: DataFrame) -> int:
    """How many partitions to deal df to before Python works on it: four a core, and more as the files behind it grow."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    most = 50_000 if size < 1 << 60 else 0  # a size that Spark does not know says nothing
    return max(4 * cores, min(most, -(-size // PIECE)))


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df written and read again: what several branches of a plan need is parsed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
