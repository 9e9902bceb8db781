"""Exact top-k inner products by columnar branch-and-bound.

Candidates are sorted by norm, the longest first, and lie in blocks, dimension by dimension. Scores are accumulated a few
dimensions at a time, those with most energy first. What the remaining dimensions can still add is at most the product of
the remaining norms; a candidate whose score plus that bound stays below what a query already has, or below the
k-th best score minus its bound, is dropped, and the survivors are moved together before the next dimensions are read.

Every query first meets one block, which gives it a least score. Then groups of queries meet parts of the candidates, a
cell of both at a time; a cell whose longest candidate cannot reach any query's least score is left out, a block likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

K, EVERY, SCALE = 20, 20, 64
#: Vectors in a block at most, its bytes as doubles at most; dimensions in a step; queries that share the dense steps.
BLOCK, BLOCK_BYTES, STEP, TILE = 8192, 8 << 20, 8, 64
#: Least and greatest number of candidates in a part and of queries in a group.
PART, GROUP = (8192, 1 << 19), (1024, 1 << 16)


def whole_numbers(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """(key, v array<double>) with floor(scale * x); rows null or with null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them all."""
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, x.astype(kind).tobytes()


def blocks(vectors: DataFrame) -> DataFrame:
    """(part, ids, rows, dims, kind, data, most): the vectors (id, row, v) of each partition in blocks; shorter vectors are filled up with zeros."""
    names = ["part", "ids", "rows", "dims", "kind", "data", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, width = TaskContext.get().partitionId(), [], 0, 1

        def give() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("v").combine_chunks()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int)
            data = np.zeros((len(size), size.max(initial=0)))
            data[np.arange(data.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            kind, raw = packed(data)
            most = float(np.sqrt((data**2).sum(1).max(initial=0.0)))
            row = [part, t.column("id").to_numpy().tobytes(), t.column("row").to_numpy().tobytes(), data.shape[1], kind, raw, most]
            return pa.record_batch([pa.array([x], y) for x, y in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.float64()), strict=True)], names)

        for batch in batches:
            while batch.num_rows:
                ahead = pc.max(pc.list_value_length(batch.column(2))).as_py() or 1
                width = max(width, ahead)
                room = max(1, min(BLOCK, BLOCK_BYTES // (8 * width)) - n)
                held.append(batch.slice(0, room))
                n += held[-1].num_rows
                batch = batch.slice(room)
                if n >= min(BLOCK, BLOCK_BYTES // (8 * width)):
                    yield give()
                    held, n = [], 0
        if n:
            yield give()

    return vectors.select("id", "row", "v").mapInArrow(run, "part long, ids binary, rows binary, dims int, kind string, data binary, most double")


class Block:
    """Vectors in columns, dimensions of most energy first, with the norms of what follows each step."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, data: np.ndarray):
        self.ids, self.rows, self.data = ids, rows, data

    @classmethod
    def of(cls, row: dict) -> Block:
        ids, rows = (np.frombuffer(row[k], np.int64) for k in ("ids", "rows"))
        return cls(ids, rows, np.frombuffer(row["data"], row["kind"]).reshape(len(ids), row["dims"]).astype(np.float64))


def tails(x: np.ndarray) -> np.ndarray:
    """Norms of each row's rest behind each step, a little enlarged against rounding."""
    tail = np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([tail[:, STEP::STEP], np.zeros((len(x), 1))], axis=1)) * (1 + 1e-9)


class Best:
    """The k best (score, id) found so far for each query; least: what a candidate needs at least, ties included."""

    def __init__(self, queries: Block, k: int, least: np.ndarray | None = None):
        self.queries, self.k = queries, k
        n = len(queries.ids)
        self.least = np.full(n, -np.inf) if least is None else least.copy()
        self.norms = np.sqrt((queries.data**2).sum(1)) * (1 + 1e-9)
        self.scores: list[np.ndarray] = [np.zeros(0)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def meet(self, block: Block) -> None:
        """All queries against a block, a tile of queries at a time."""
        most = float(np.sqrt((block.data**2).sum(1).max(initial=0.0))) * (1 + 1e-9)
        own = np.flatnonzero(self.norms * most >= self.least)  # for the others no candidate here is long enough
        if not len(own) or not len(block.ids):
            return
        dims = max(block.data.shape[1], self.queries.data.shape[1])
        data, asked = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (block.data, self.queries.data[own]))
        order = np.argsort(-(data**2).sum(0), kind="stable")
        columns, asked = np.ascontiguousarray(data[:, order].T), asked[:, order]
        columns_left, asked_left = tails(columns.T).T, tails(asked)
        for t in range(0, len(own), TILE):
            some = own[t : t + TILE]
            self._tile(block, some, asked[t : t + TILE], asked_left[t : t + TILE], columns, columns_left)

    def _tile(self, block: Block, some: np.ndarray, q: np.ndarray, q_left: np.ndarray, columns: np.ndarray, columns_left: np.ndarray) -> None:
        k, kept = self.k, np.arange(len(block.ids))  # candidates that some query of the tile still needs
        score = np.where(self.queries.rows[some][:, None] == block.rows, -np.inf, 0.0)
        alive = np.isfinite(score)
        for step, at in enumerate(range(0, len(columns), STEP)):
            score += q[:, at : at + STEP] @ columns[at : at + STEP, kept]
            room = q_left[:, step, None] * columns_left[step, kept]
            least = self.least[some]
            if len(kept) > k and (step < 2 or not np.isfinite(least).all()):  # later on the scores found before are as good
                least = np.maximum(least, np.partition(score - room, len(kept) - k, axis=1)[:, len(kept) - k])
            alive = (score + room >= least[:, None]) & np.isfinite(score)
            used = alive.any(axis=0)
            if used.mean() < 0.75:
                kept, score, alive = kept[used], score[:, used], alive[:, used]
            if not len(kept):
                return
        for i, n in enumerate(some.tolist()):
            found = np.flatnonzero(alive[i])
            if not len(found):
                continue
            scores = np.concatenate([self.scores[n], score[i, found]])
            ids = np.concatenate([self.ids[n], block.ids[kept[found]]])
            best = np.lexsort((ids, -scores))[:k]
            self.scores[n], self.ids[n] = scores[best], ids[best]
            if len(best) == k:
                self.least[n] = max(self.least[n], scores[best[-1]])

    def table(self) -> pa.Table:
        counts = [len(x) for x in self.ids]
        columns = [np.repeat(self.queries.rows, counts), np.repeat(self.queries.ids, counts), np.concatenate([np.zeros(0, np.int64), *self.ids]), np.concatenate([np.zeros(0), *self.scores]).astype(np.int64)]
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), columns, strict=True)))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every` its k best other rows.

    Null keys take no part. Rows that repeat a key are queries and candidates one by one, each with its own ranks; ties go to the
    smaller key. Scores are exact while they stay below 2^53. Other columns are not read, whatever their names. No valid
    vector, no rows.

    A cell of a part and a group is one task's work and returns k rows a query at most; parts and groups grow with the input
    up to what a task holds, so that vectors travel as seldom as that allows.
    """
    whole = saved(whole_numbers(vectors, scale, key, vector).withColumn("row", F.monotonically_increasing_id()), "whole")
    count, n_queries = whole.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    part = min(PART[1], max(PART[0], count // 64))
    group = min(GROUP[1], max(GROUP[0], n_queries // 16))
    parts, groups = max(1, -(-count // part)), max(1, -(-n_queries // group))
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    long_first = whole.withColumn("norm", norm).repartitionByRange(parts, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    candidates = saved(blocks(long_first), "candidates")
    first = [r.asDict() for r in candidates.orderBy("part", F.desc("most")).limit(1).collect()]  # BLOCK_BYTES at most
    seed = whole.sparkSession.sparkContext.broadcast(first)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block.of(seed.value[0])
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                best = Best(Block.of(row), k)
                best.meet(block)
                need = np.where(best.norms > 0, best.least / np.maximum(best.norms, 1e-300), -np.inf)
                values = [row[c] for c in ("part", "ids", "rows", "dims", "kind", "data")]
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.float64())
                yield pa.record_batch([pa.array([v], t) for v, t in zip([*values, best.least.tobytes(), float(need.min())], types, strict=True)], ["group", "ids", "rows", "dims", "kind", "data", "least", "need"])

    asked = blocks(whole.where(F.col("id") % every == 0).repartition(groups, "row"))
    asked = saved(asked.mapInArrow(started, "group long, ids binary, rows binary, dims int, kind string, data binary, least binary, need double"), "queries")
    longest = candidates.groupBy("part").agg(F.max("most").alias("most"))
    cells = asked.groupBy("group").agg(F.min("need").alias("need")).select("group", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    cells = saved(cells.join(longest, "part").where(F.col("most") * (1 + 1e-9) + 1e-9 >= F.col("need")).select("part", "group"), "cells")

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        rows = sorted(two.to_pylist(), key=lambda r: -r["most"])
        found = []
        for row in one.to_pylist():
            best = Best(Block.of(row), k, np.frombuffer(row["least"]))
            for other in rows:
                best.meet(Block.of(other))
            found.append(best.table())
        return pa.concat_tables(found) if found else Best(Block(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))), k).table()

    left = cells.join(asked, "group").select(F.col("part").alias("x"), F.col("group").alias("y"), *asked.columns[1:])
    right = cells.join(candidates, "part").select(F.col("part").alias("c"), F.col("group").alias("q"), *candidates.columns[1:])
    found = left.groupBy("x", "y").cogroup(right.groupBy("c", "q")).applyInArrow(cell, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.r, a.vec_id AS query_id, b.vec_id, list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS score
    FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 20
"""
