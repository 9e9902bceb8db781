"""Near copies among vectors, by an epsilon grid order join.

Vectors of length one are closer than epsilon = sqrt(2 - 2c) where their cosine exceeds c. They are sorted by label
and by the cells, epsilon wide, of their leading principal coordinates, and lie in blocks of that order. Intervals of
the order are joined recursively: two whose boxes are further apart than epsilon are skipped, others are halved; inside
two blocks the recursion goes on down to small tiles, which are compared in full.

Equal vectors of a label are one class with a count. A class gets its number of links as a sum of counts, and of the
links themselves only a spanning forest of each pair of blocks is handed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, saved, stars, table, tree_sum

COSINE, LEADING = 0.93, 6
#: Rows of a block and of a tile; blocks of a part of the order, which one task forms; children of an interval.
BLOCK, TILE, BLOCKS, CHILDREN = 1024, 128, 32, 8
#: Parts of the order at most; beyond that a part has more blocks.
PARTS = 50_000
#: Cosines this close to the threshold are computed again, exactly rounded.
DOUBT = 1e-9


def usable(vector: str):
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def rows_of(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of doubles, filled up with zeros to `dims`."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(int)
    out = np.zeros((len(n), dims))
    out[np.arange(dims) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither huge nor tiny components leave the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal(classes: DataFrame, dims: int, leading: int) -> np.ndarray:
    """The leading principal directions of all unit vectors; sums of products are added up by Spark, in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = unit(rows_of(batch.column(0), dims))
            total += x.T @ x
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "x"])

    total = tree_sum(classes.select("v").mapInArrow(run, "part long, x binary"))
    values, vectors = np.linalg.eigh(total.reshape(dims, dims))
    return np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")[:leading]])


def apart(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], epsilon: float) -> bool:
    """Whether two boxes (low, high) are provably further apart than epsilon; their first side is the label and must meet."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return gap[0] > 0 or float(gap[1:] @ gap[1:]) > epsilon**2


def join_intervals(low: np.ndarray, high: np.ndarray, epsilon: float, leaf: int = 1) -> list[tuple[int, int, int, int]]:
    """Pairs of intervals [a, b) and [c, d), c >= a, of at most `leaf` boxes that may hold neighbours."""
    out, work = [], [(0, len(low), 0, len(low))] if len(low) else []
    while work:
        a, b, c, d = work.pop()
        if (a, b) != (c, d) and apart((low[a:b].min(0), high[a:b].max(0)), (low[c:d].min(0), high[c:d].max(0)), epsilon):
            continue
        if b - a <= leaf and d - c <= leaf:
            out.append((a, b, c, d))
        elif (a, b) == (c, d):
            m = (a + b) // 2
            work += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            work += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            work += [(a, b, c, m), (a, b, m, d)]
    return out


class Block:
    def __init__(self, row: dict):
        self.ids, self.n, self.label, self.size = (np.frombuffer(row[k], np.int64) for k in ("ids", "n", "labels", "sizes"))
        self.x = np.frombuffer(row["data"]).reshape(len(self.ids), -1)
        self.box = np.frombuffer(row["coordinates"]).reshape(len(self.ids), -1)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum((a * b).tolist()) / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist())))


def compare(one: Block, two: Block | None, cosine: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, their numbers of links here, edges of a spanning forest) of two blocks, or within one.

    Links are counted tile by tile and of each tile only what connects is kept, so a dense block costs no more memory.
    """
    ids, n = one.ids, one.n
    x, box, label, size = unit(one.x), one.box, one.label, one.size
    m = len(ids)
    if two:
        ids, n, box, label, size = (np.concatenate([getattr(one, k), getattr(two, k)]) for k in ("ids", "n", "box", "label", "size"))
        x = np.concatenate([x, unit(two.x)])
    low = np.concatenate([label[:, None].astype(float), box], axis=1)
    raw = np.concatenate([one.x, two.x]) if two else one.x
    links = np.zeros(len(ids), np.int64)
    kept = [np.zeros((0, 2), np.int64)]
    for a, b, c, d in tiles(low, m, bool(two), epsilon):
        s = x[a:b] @ x[c:d].T
        for i, j in np.argwhere(np.abs(s - cosine) < DOUBT).tolist():
            s[i, j] = exact_cosine(raw[a + i], raw[c + j])
        hit = (s >= cosine) & (label[a:b, None] == label[c:d]) & (size[a:b, None] == size[c:d])
        if (a, b) == (c, d):
            hit &= np.arange(a, b)[:, None] < np.arange(c, d)
        if hit.any():
            links[a:b] += hit @ n[c:d]
            links[c:d] += n[a:b] @ hit
            kept.append(stars(np.argwhere(hit) + [a, c]))
    p = stars(np.concatenate(kept))
    return ids, links, np.stack([ids[p[:, 1]], ids[p[:, 0]]], axis=1)


def tiles(low: np.ndarray, m: int, two: bool, epsilon: float) -> Iterator[tuple[int, int, int, int]]:
    if not two:
        yield from join_intervals(low, low, epsilon, TILE)
        return
    edges = [list(range(a, b, TILE)) + [b] for a, b in ((0, m), (m, len(low)))]
    for a, b in zip(edges[0][:-1], edges[0][1:], strict=True):
        box = low[a:b].min(0), low[a:b].max(0)
        for c, d in zip(edges[1][:-1], edges[1][1:], strict=True):
            if not apart(box, (low[c:d].min(0), low[c:d].max(0)), epsilon):
                yield a, b, c, d


def met_blocks(blocks: DataFrame, sides: int, parts: int, epsilon: float) -> DataFrame:
    """(one, two): the pairs of blocks, one <= two, whose boxes are not provably apart.

    The order's parts are the leaves of a tree of intervals, CHILDREN to a node. Starting from the whole order joined with
    itself, each step joins a pair of intervals to the pairs of their children and drops those that are apart.
    """
    corner = lambda f, c: [f(F.col(c)[i]).alias(f"{c}{i}") for i in range(sides)]
    every = [f"{c}{i}" for c in ("low", "high") for i in range(sides)]
    boxes = saved(blocks.groupBy("part").agg(*corner(F.min, "low"), *corner(F.max, "high")), "boxes")
    leaves = boxes.select(F.col("part").alias("node"), *every)
    own = blocks.select("part", F.col("block").alias("node"), *(F.col(c)[i].alias(f"{c}{i}") for c in ("low", "high") for i in range(sides)))
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"x_low{i}") - F.col(f"y_high{i}"), F.col(f"y_low{i}") - F.col(f"x_high{i}"))
    near = (gap(0) == 0) & (sum((gap(i) * gap(i) for i in range(1, sides)), F.lit(0.0)) <= epsilon**2)

    def refined(pairs: DataFrame, children: DataFrame) -> DataFrame:
        """pairs (one, two) of intervals -> pairs of their children (parent, node, box)."""
        side = lambda p, name: children.select(F.col("parent").alias(name), F.col("node").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in every))
        both = pairs.join(side("x", "one"), "one").join(side("y", "two"), "two")
        return both.where(((F.col("one") != F.col("two")) | (F.col("x") <= F.col("y"))) & near).select(F.col("x").alias("one"), F.col("y").alias("two"))

    depth = 0
    while CHILDREN**depth < parts:
        depth += 1
    pairs = blocks.sparkSession.range(1).select(F.col("id").alias("one"), F.col("id").alias("two"))
    for level in range(depth - 1, -1, -1):
        width = CHILDREN**level
        merged = leaves.groupBy((F.floor(F.col("node") / width)).alias("node")).agg(*(F.min(c).alias(c) for c in every if c.startswith("low")), *(F.max(c).alias(c) for c in every if c.startswith("high")))
        pairs = saved(refined(pairs, merged.withColumn("parent", F.floor(F.col("node") / CHILDREN))), "intervals")
    return refined(pairs, own.withColumnRenamed("part", "parent"))


def link_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Links join rows of one label (not null) and one number of dimensions whose cosine is at least `cosine`. Vectors that are
    null, zero or hold null or non-finite components, and rows without key or label, link with nothing and stand alone.
    Repeated rows of a key count as vectors of their own; ties need no order. Other columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.col(label).cast("long").alias("g"))
    rows = rows.withColumn("ok", usable("v") & F.col("g").isNotNull() & F.col("key").isNotNull())
    classes = saved(rows.where("ok").groupBy("g", "v").agg(F.min("key").alias("id"), F.count("*").alias("n")), "classes")
    count, dims = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    shared = spark.sparkContext.broadcast(principal(classes, dims, min(LEADING, dims)))
    leading = min(LEADING, dims)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = unit(rows_of(batch.column(1), dims)) @ shared.value
            cells = np.floor(at / epsilon).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(at.tolist(), pa.list_(pa.float64())), *(pa.array(c) for c in cells.T)], [*batch.schema.names, "at", *(f"c{i}" for i in range(leading))])

    cells = [f"c{i}" for i in range(leading)]
    placed = classes.select("g", F.col("v").cast("array<double>").alias("v"), "id", "n").mapInArrow(place, "g long, v array<double>, id long, n long, at array<double>, " + ", ".join(f"{c} int" for c in cells))
    order = ["g", *cells, "id"]
    parts = min(PARTS, max(1, count // (BLOCKS * BLOCK)))
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def give(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: t.column(name).combine_chunks()
            v = column("v")
            at = rows_of(column("at"), leading)
            g = column("g").to_numpy()
            low, high = ([float(f(g)), *f(at, axis=0).tolist()] for f in (np.min, np.max))
            sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
            data = [x.tobytes() for x in (column("id").to_numpy(), column("n").to_numpy(), g, sizes, at, rows_of(v, dims))]
            return pa.record_batch([pa.array([part], pa.int64()), pa.array([part << 33 | number], pa.int64()), pa.array([low]), pa.array([high]), *(pa.array([x], pa.binary()) for x in data)], ["part", "block", "low", "high", "ids", "n", "labels", "sizes", "coordinates", "data"])

        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, BLOCK - n)
                batch = batch.slice(head.num_rows)
                held.append(head)
                n += head.num_rows
                if n == BLOCK:
                    yield give(held, seq)
                    seq, held, n = seq + 1, [], 0
        if n:
            yield give(held, seq)

    blob = "part long, block long, low array<double>, high array<double>, ids binary, n binary, labels binary, sizes binary, coordinates binary, data binary"
    blocks = saved(ordered.mapInArrow(block, blob), "blocks")
    pairs = met_blocks(blocks, leading + 1, parts, epsilon)
    names = ["ids", "n", "labels", "sizes", "coordinates", "data"]
    side = lambda p, k: blocks.select(F.col("block").alias(k), F.struct(*names).alias(p))
    both = pairs.join(side("x", "one"), "one").join(side("y", "two"), "two").select("one", "two", "x", "y")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                alone = batch.column(0)[i] == batch.column(1)[i]
                ids, links, edges = compare(Block(batch.column(2)[i].as_py()), None if alone else Block(batch.column(3)[i].as_py()), cosine, epsilon)
                some = np.flatnonzero(links)
                yield pa.record_batch([pa.array(np.concatenate([ids[some], edges[:, 0]])), pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)])), pa.array([None] * len(some) + edges[:, 1].tolist(), pa.int64())], ["id", "links", "to"])

    found = saved(both.mapInArrow(meet, "id long, links long, to long"), "links")
    links = found.where("to IS NULL").groupBy("id").agg(F.sum("links").alias("links"))
    reached = connected_components(found.where("to IS NOT NULL").select(F.col("id").alias("a"), F.col("to").alias("b")))
    known = classes.join(links, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(F.col("g").alias("_g"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    joined = rows.join(known, F.col("ok") & (F.col("g") == F.col("_g")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "key")
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))


def op10_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
