"""The streaming front end: files or messages in, parsed tables out, each micro-batch on its own.

Parsing has no state, so every function of sources.documents works on a stream as it does on a table. What does keep
state here is the newest version of each source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(source_id, text) of whole text files as they arrive."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.col("_metadata.file_path").alias("source_id"), F.col("value").alias("text"))


def stream_table(spark: SparkSession, path: str, schema: str, text: str = "text", key: str = "source_id") -> DataFrame:
    """(source_id, text) of Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path).select(F.col(key).cast("string").alias("source_id"), F.col(text).alias("text"))


def write_stream(parsed: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends every micro-batch's rows to a Parquet table once; recovery goes by the checkpoint."""
    return parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def for_each_batch(parsed: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return parsed.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_errors(errors: DataFrame) -> DataFrame:
    """Running counts of errors by code, for the update or complete mode. The state is one row a code."""
    return errors.groupBy("code").agg(F.count("*").alias("n"))
