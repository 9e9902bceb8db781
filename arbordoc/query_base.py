"""What all modules of queries share: their registry, and documents made from tables by column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import canonical
from .operators.assign import assign
from .plans.compose import compose
from .plans.schema import META, Schema, construct
from .sources.parser import PRAGMA, parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@cache
def schema_of(text: str) -> Schema:
    """A schema from its own document, layers applied."""
    doc = parse(text)
    root, errors = assign(doc, META)
    schema, faults = compose(construct(root))
    if doc.errors or errors or faults:
        raise ValueError(f"bad schema: {doc.errors} {errors} {faults}")
    return schema


def body(name: str, *fields: str, before: str = "") -> Schema:
    lines = "\n".join(f"  {x}" for x in fields)
    return schema_of(f"{PRAGMA} 1.0\n\nname {name}\n{before}\ndocument\n{lines}\n")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(keyword: str, value: Column, depth: int = 0) -> Column:
    """A member's lines; null where the value is null."""
    return F.when(value.isNotNull(), canonical.lines_of(F.lit("  " * depth), F.lit(keyword), value.cast("string")))


def as_documents(df: DataFrame, key: str, *lines: Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("source_id"), F.concat(F.concat_ws("\n", F.lit(f"{PRAGMA} 1.0"), *lines), F.lit("\n")).alias("text"))


def grouped(df: DataFrame, key: str, line: Column, *order: str) -> DataFrame:
    """(source_id, text): one document per key, its rows' lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    text = F.concat(F.lit(f"{PRAGMA} 1.0\n"), F.array_join(F.transform(lines, lambda x: x["_line"]), "\n"), F.lit("\n"))
    return df.groupBy(key).agg(text.alias("text")).select(F.col(key).cast("string").alias("source_id"), "text")


def key_of(name: str) -> Column:
    return F.col("source_id").cast("long").alias(name)


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd")
