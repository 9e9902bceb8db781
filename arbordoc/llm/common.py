"""Shared folder, lineage cuts, column hygiene and connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Source rows are handed to Python code in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local master may go without it; there a folder below /tmp is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/arbordoc-shared"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: its lineage is cut, and a lost executor costs nothing.

    Shuffle files go when the driver's JVM finds their plans unused, so it is told to look once a table is written: what
    earlier steps shuffled does not lie on the executors' disks until the end. The plan that ran last is held until
    another one runs, so an empty one does.
    """
    spark, schema, path = df.sparkSession, df.schema, shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    del df
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As saved, dealt into files by key: a join on the key then moves the other side alone. Its table is dropped when Python ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    named = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(named)
    atexit.register(_drop, spark, named)
    return spark.table(named)


def _drop(spark: SparkSession, named: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {named}")


def tree_sum(vectors: DataFrame, widths: tuple[int, ...] = (64, 8, 1)) -> np.ndarray | None:
    """The sum of all rows of vectors (part long, x binary: doubles of one length), by steps of so many tasks; None without rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(1):
                v = np.frombuffer(x.as_buffer(), np.float64)
                total = v.copy() if total is None else np.add(total, v, out=total)
        if total is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "x"])

    rows = vectors.select("part", "x")
    for width in widths:
        rows = rows.repartitionById(width, F.col("part").cast("int")).mapInArrow(add, "part long, x binary")
    got = rows.collect()
    return np.frombuffer(got[0]["x"], np.float64) if got else None


def file_bytes(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """A vocabulary file that the driver has, for all tasks: a few MB whatever the input."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `most` bytes of the named column, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = size = 0
        for i, n in enumerate(pc.binary_length(column).to_pylist()):
            if size and size + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over text-sized slices; make() runs once in each task and returns the work for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in slices(batches, text):
            out = work(piece)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


#: So many links (16 bytes each) one task may connect.
ONE_TASK = 500_000


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b: long) reaches.

    Alternates large-star and small-star steps, each one a map-side combined minimum and a join on unique
    keys, until the edges are stars; where no more than `one_task` of them are left, one task ends the work. Roots and
    nodes without edges are not returned. Nothing is collected but a count and a checksum per round.
    """
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = saved(ends.distinct(), "edges")
    state = _state(now)
    while state[0] > one_task:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(moved.unionByName(lowest.withColumnRenamed("m", "b")).where("a <> b").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1) for b in batches]
        found = stars(np.concatenate(pairs)) if pairs else np.zeros((0, 2), np.int64)
        yield pa.record_batch([pa.array(found[:, 1]), pa.array(found[:, 0])], ["node", "component"])

    return now.coalesce(1).mapInArrow(connect, "node long, component long")


def stars(pairs: np.ndarray) -> np.ndarray:
    """As few links that connect the same ids: from the least id of each component to its others."""
    ids, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        least = np.minimum(root[a], root[b])
        for side in (root[a], root[b]):  # roots too, so that chains shrink by halves
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[root[moved]], ids[moved]], axis=1)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
