"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints within the limit, one segment differs by one
bit at most. Variants of a segment leave one bit open; two segments that differ by one bit at most share the variant
that leaves that bit open. Each distinct fingerprint is indexed under every variant of every segment (a row a bit), rows
are joined by equality of the variant and each meeting is verified by the full distance.

The join streams through sorted variants. A group that is small is compared pair by pair. A large one is joined again
by the variants of its other bits, which may differ by as much, and only what meets there is compared; of groups
that stay large a spanning forest is sought. Only links that connect are handed on. A variant with more
fingerprints than one task should hold is dealt by those second variants before it reaches a task.

Fingerprints are distinct before they are indexed, so copies cost nothing here.

near_copies decides by the exact similarity of shingle sets. What fingerprints link is compared first. Of two sets at 0.8
some 10 of 64 bits differ, which no such index reaches, so bands of least hashes lead to the pairs beyond the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, map_texts, saved, stars, table, text_of

BITS, SHINGLE, LIMIT, SEED = 64, 4, 4, 42
#: Groups up to SMALL are compared by shifted rows at once, those beyond LARGE are joined again by their other bits.
SMALL, LARGE = 32, 512
#: Indexed rows in a task, while there are no more than TASKS; fingerprints of a variant beyond which it is dealt by second variants.
DEALT, TASKS, HOT = 400_000, 50_000, 500_000
#: Least hashes that tell which shingle sets are compared, in bands of ROWS: a pair at 0.8 is passed over with a chance of (1 - 0.8 ** 5) ** 40.
BANDS, ROWS = 40, 5
MULTIPLY = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingle sets, and distinct shingles of them, that one task compares with each other at once.
SETS, SHINGLES = 1024, 2_000_000


def fingerprints(texts: list[str], shingle: int, seed: int) -> np.ndarray:
    """A 64-bit number for each text: a bit is set if over half of the shingles' hashes have it set.

    Lower-cases A-Z only. A text of fewer words is one shingle, one without words is zero.
    """
    out = np.zeros(len(texts), np.uint64)
    for row, text in enumerate(texts):
        found = text.encode().lower().split()
        if not found:
            continue
        line = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(found) - shingle + 1)
        h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 4096):
            ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[row] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long): the fingerprint's bits as a signed number. Null texts are empty; other columns are not read."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist(), shingle, seed).view(np.int64))], [key, "fp"])

        return work

    return map_texts(docs.select(F.col(key).cast("long").alias(key), text_of(text).alias("text")), "text", make, f"{key} long, fp long")


def segments_of(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of n nearly equal segments."""
    edges = [i * bits // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def variants(value: np.ndarray, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(segment, keys) for each segment and each of its bits left open; a key tells segment, open bit and the other bits."""
    for i, (first, n) in enumerate(cuts):
        part = value >> np.uint64(first) & np.uint64((1 << n) - 1)
        for bit in range(n):
            yield i, (part & np.uint64(~(1 << bit) & ((1 << n) - 1)) | np.uint64((i << 6 | bit) << 44)).view(np.int64)


def others(fp: np.ndarray, first: int, n: int) -> np.ndarray:
    """The fingerprints' bits outside a segment, moved together."""
    low = fp & np.uint64((1 << first) - 1)
    return low if first + n == BITS else fp >> np.uint64(first + n) << np.uint64(first) | low


def index(fps: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """(variant, id, fp): each fingerprint under all variants of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys in variants(batch.column(1).to_numpy().view(np.uint64), cuts):
                yield pa.record_batch([pa.array(keys), batch.column(0), batch.column(1)], ["variant", "id", "fp"])

    return fps.select("id", "fp").mapInArrow(run, "variant long, id long, fp long")


def second(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """(variant, other, id, fp): rows of index under the variants of the bits outside the segment, too."""
    n_segments = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            variant, fp = batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            for i, (first, n) in enumerate(cuts):
                own = np.flatnonzero(variant >> 50 == i)
                for _, keys in variants(others(fp[own], first, n), segments_of(BITS - n, n_segments)) if len(own) else ():
                    yield pa.record_batch([pa.array(variant[own]), pa.array(keys), batch.column(1).take(pa.array(own)), batch.column(2).take(pa.array(own))], ["variant", "other", "id", "fp"])

    return rows.select("variant", "id", "fp").mapInArrow(run, "variant long, other long, id long, fp long")


def links(keys: np.ndarray, ids: np.ndarray, fp: np.ndarray, limit: int, cuts: list[tuple[int, int]], again: bool = True) -> list[np.ndarray]:
    """Links (id, id) within the limit that connect what rows of equal, adjoining keys connect; again: join large groups once more."""
    found = []
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([starts, [len(keys)]]))
    small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for d in range(1, int(size[size <= SMALL].max(initial=1))):
        a = small[small + d < len(keys)]
        a = small = a[keys[a] == keys[a + d]]
        near = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= limit]
        found.append(np.stack([ids[near], ids[near + d]], axis=1))
    for g in np.flatnonzero(size > SMALL).tolist():
        rows = np.arange(starts[g], starts[g] + size[g])
        if size[g] <= LARGE or not again:
            found.append(forest(ids[rows], fp[rows], limit))
            continue
        first, n = cuts[int(keys[rows[0]]) >> 50]
        for _, value in variants(others(fp[rows], first, n), segments_of(BITS - n, len(cuts))):
            order = np.argsort(value, kind="stable")
            found.append(stars(np.concatenate([np.zeros((0, 2), np.int64), *links(value[order], ids[rows[order]], fp[rows[order]], limit, cuts, again=False)])))
    return found


def forest(ids: np.ndarray, fp: np.ndarray, limit: int) -> np.ndarray:
    """A spanning forest of the rows within the limit: each point reached looks only at those not yet reached."""
    rest, out = np.argsort(ids, kind="stable"), []
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            at = reached.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= limit
            new = rest[near]
            out.append(np.stack([np.full(len(new), ids[at]), ids[new]], axis=1))
            reached += new.tolist()
            rest = rest[~near]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def met(rows: DataFrame, keys: list[str], limit: int, cuts: list[tuple[int, int]], n_parts: int) -> DataFrame:
    """(a, b): links among rows of equal keys, which stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, want = 0, 200_000

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, want
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            column = lambda name: t.column(name).to_numpy()
            each = [column(k) for k in keys]
            new = np.concatenate([[True], *([np.any([k[1:] != k[:-1] for k in each], axis=0)] if t.num_rows else [])])
            cut = t.num_rows if last else int(np.flatnonzero(new)[-1])  # the last group may go on
            group = each[0] if len(each) == 1 else each[0] >> 50 << 50 | np.cumsum(new)
            found = links(group[:cut], column("id")[:cut], column("fp").view(np.uint64)[:cut], limit, cuts, again=len(keys) == 1)
            pairs = stars(np.concatenate([np.zeros((0, 2), np.int64), *found]))
            for at in range(0, len(pairs), 100_000):
                yield pa.record_batch([pa.array(pairs[at : at + 100_000, i]) for i in (0, 1)], ["a", "b"])
            held = t.slice(cut).to_batches()
            n = t.num_rows - cut
            want = 200_000 + n

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > want:
                yield from give(False)
        yield from give(True)

    return rows.repartition(n_parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def components(prints: DataFrame, limit: int, n_segments: int, key: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(key, fp, component_id): the smallest key that each document reaches over links of at most `limit` bits.

    Texts without words share the fingerprint zero and are linked like any other; repeated rows and ties are one
    fingerprint. Null keys stay out of groups: their component is null unless a copy of their text has a key. Very long
    texts are read whole, other columns are not read, whatever their names, and an empty table gives no rows.
    """
    if n_segments < limit // 2 + 1:
        raise ValueError(f"{n_segments} segments miss pairs that differ by {limit} bits")
    prints = saved(prints, "prints")
    distinct = saved(prints.groupBy("fp").agg(F.min(key).alias("id")).where("id IS NOT NULL"), "distinct")
    rows = distinct.count()
    cuts = segments_of(BITS, n_segments)
    indexed = index(distinct, cuts)
    n_parts = min(TASKS, max(8, BITS * rows // DEALT))
    crowded = saved(_crowded(distinct, cuts, hot), "crowded") if rows > hot else None
    if crowded is not None and crowded.count():
        usual = met(indexed.join(crowded, "variant", "left_anti"), ["variant"], limit, cuts, n_parts)
        split = second(indexed.join(crowded, "variant", "left_semi"), cuts)
        edges = usual.unionByName(met(split, ["variant", "other"], limit, cuts, n_parts))
    else:
        edges = met(indexed, ["variant"], limit, cuts, n_parts)
    reached = connected_components(edges)
    of_fp = distinct.join(reached, distinct["id"] == reached["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(of_fp, "fp", "left").select(key, "fp", "component_id")


def _crowded(distinct: DataFrame, cuts: list[tuple[int, int]], hot: int) -> DataFrame:
    """(variant): all variants of the segments' values that so many fingerprints have that a variant may have over `hot`."""
    parts = [F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("fp", first).bitwiseAND((1 << n) - 1).alias("value")) for i, (first, n) in enumerate(cuts)]
    often = distinct.select(F.explode(F.array(*parts)).alias("part")).groupBy("part").count().where(F.col("count") * 2 > hot).select("part.segment", "part.value")
    every = None
    for i, (_, n) in enumerate(cuts):
        keys = F.array(*(F.col("value").bitwiseAND(~(1 << bit) & ((1 << n) - 1)).bitwiseOR((i << 6 | bit) << 44) for bit in range(n)))
        own = often.where(F.col("segment") == i).select(F.explode(keys).alias("variant"))
        every = own if every is None else every.unionByName(own)
    return every.distinct()


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(fingerprint_documents(table(spark, sf_dir, "documents")), LIMIT, 3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; words and short texts as in fingerprints."""
    found = text.encode().lower().split()
    n = max(1, len(found) - shingle + 1) if found else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i : i + shingle])) for i in range(n)), np.uint64, n))


def print_of(shingles: np.ndarray) -> int:
    """The fingerprint of a shingle set, as a signed number: bits that over half of its hashes have."""
    ones = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def node_of(shingles: np.ndarray) -> int:
    """The number that texts of equal shingle sets share."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """BANDS numbers; of two sets with Jaccard similarity s each is equal with a chance of s ** ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        mixed = shingles[at : at + 1024] * MULTIPLY[:, None]
        np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(1), out=least)
    rows = least.reshape(BANDS, ROWS).astype("<u8")
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest (index, index) of the sets, by their exact Jaccard similarity."""
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    parts = np.split(at, np.cumsum(size)[:-1])
    rest, out = np.arange(len(sets)), []
    mark = np.zeros(len(ids), np.int64)
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            a = reached.pop()
            rest_size = size[rest]
            fit = np.minimum(size[a], rest_size) >= similarity * np.maximum(size[a], rest_size) - 1e-9
            near = np.zeros(len(rest), bool)
            if fit.any():
                mark[parts[a]] = 1
                both = np.add.reduceat(mark[np.concatenate([parts[b] for b in rest[fit]])], np.cumsum(rest_size[fit]) - rest_size[fit])
                mark[parts[a]] = 0
                near[fit] = both >= similarity * (size[a] + rest_size[fit] - both) - 1e-9
            out += [(a, b) for b in rest[near].tolist()]
            reached += rest[near].tolist()
            rest = rest[~near]
    return out


def _forests(groups: DataFrame, by: list[str], nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(a, b): keys of nodes that exact similarity links within each group (groups: by, node); groups of equal members are one."""
    members = groups.groupBy(*by).agg(F.array_sort(F.collect_set("node")).alias("members")).where(F.size("members") > 1).select("members").distinct()
    asked = members.select(F.xxhash64("members").alias("part"), F.explode("members").alias("node"))
    rows = asked.join(nodes.select("node", "key"), "node").join(texts, "key").select("part", "node", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, keys = None, {}, {}

        def found() -> Iterator[pa.RecordBatch]:
            if len(own) > 1 and (pairs := alike(list(own.values()), similarity)):
                ids = np.array([keys[node] for node in own])
                yield pa.record_batch([pa.array(ids[[p[i] for p in pairs]]) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for part, node, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    yield from found()
                    now, own, keys = part, {}, {}
                if node not in own and node_of(x := shingle_set(t, shingle)) == node:  # a key may have other texts
                    own[node], keys[node] = x, k
        yield from found()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long")


def _compared(groups: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int, most: int, known: DataFrame | None = None) -> DataFrame:
    """(a, b): known links, and those that connect what exact similarity links within each group (groups: band, node, n, c).

    c: the component of a node by known links; a group of one component has nothing to add. A group with more than `most`
    texts is cut into slices. First each slice is compared within itself, and with the first text of the next one, which
    connects copies of one text. Where that leaves several components in a group, those outside its largest one are compared
    with all slices. So no task holds a whole group, and no link between components is lost.
    """
    slices = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / SHINGLES)).alias("p")
    often = groups.groupBy("band").agg(F.count("*").alias("members"), slices, (F.min("c") != F.max("c")).alias("apart")).where("apart").drop("apart")
    crowd = saved(groups.join(often, "band").select("band", "node", "members", "p", F.expr("pmod(xxhash64(node), p)").alias("s")), "crowd")
    wide = crowd.where("p > 1")
    heads = wide.groupBy("band", "p", "s").agg(F.min("node").alias("node")).select("band", F.expr("pmod(s - 1, p)").alias("s"), "node")
    edges = _forests(crowd.select("band", "s", "node").unionByName(heads), ["band", "s"], nodes, texts, similarity, shingle)
    edges = saved(edges if known is None else edges.unionByName(known), "links")
    if not wide.limit(1).count():
        return edges
    placed = wide.join(nodes.select("node", "key"), "node").join(connected_components(edges).withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
    main = placed.groupBy("band", "c").count().groupBy("band").agg(F.max_by("c", F.struct("count", "c")).alias("main"), (F.sum("count") - F.max("count")).alias("loose")).where("loose > 0")
    loose = saved(placed.join(main, "band").withColumn("q", F.expr("CAST(ceil(loose * p / members) AS BIGINT)")).select("band", "node", "p", "s", "q", (F.col("c") != F.col("main")).alias("out"), F.expr("pmod(xxhash64(node, 1), q)").alias("t")), "loose")
    every = loose.select("band", "s", F.explode(F.expr("sequence(0L, q - 1)")).alias("t"), "node")
    out = loose.where("out").select("band", F.explode(F.expr("sequence(0L, p - 1)")).alias("s"), "t", "node")
    return saved(edges.unionByName(_forests(every.unionByName(out), ["band", "s", "t"], nodes, texts, similarity, shingle)), "links")


def near_copies(docs: DataFrame, similarity: float, shingle: int, text: str = "text", key: str = "doc_id", most: int = SETS) -> DataFrame:
    """(key, component_id): the smallest key that a text reaches over pairs of at least that Jaccard similarity of shingle sets.

    Texts that SimHash fingerprints connect (LIMIT bits, by the index of deletion variants) are compared, each with each up to
    what a spanning forest needs, by their whole sets. Then texts that agree in a band are, where a band holds more than one
    of the components found so far: pairs whose fingerprints differ by more bits. See _compared.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            bands = pa.array([bands_of(x) if len(x) else [] for x in sets], pa.list_(pa.int64()))
            numbers = (pa.array([f(x) for x in sets], pa.int64()) for f in (node_of, len, print_of))
            return pa.record_batch([batch.column(0), *numbers, bands], ["key", "node", "n", "fp", "bands"])

        return work

    prints = saved(map_texts(texts, "text", make, "key long, node long, n long, fp long, bands array<long>"), "prints")
    first = [F.first(c).alias(c) for c in ("n", "fp", "bands")]
    nodes = saved(prints.where("key IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"), *first), "nodes")
    filled = nodes.where("n > 0").select("node", "n", F.col("key").alias("c"), "fp")
    linked = components(filled.select("c", "fp"), LIMIT, 3, key="c").select("c", F.col("component_id").alias("band"))
    edges = _compared(filled.join(linked, "c").select("band", "node", "n", "c"), nodes, texts, similarity, shingle, most)
    reached = connected_components(edges).withColumnRenamed("node", "key")
    banded = nodes.join(reached, "key", "left").select("node", "n", F.coalesce("component", "key").alias("c"), F.explode("bands").alias("band"))
    reached = connected_components(_compared(banded, nodes, texts, similarity, shingle, most, edges))
    of_node = nodes.select("node", F.col("key").alias("first")).join(reached.withColumnRenamed("node", "first"), "first", "left")
    return prints.select("key", "node").join(of_node, "node", "left").select(F.col("key").alias(key), F.coalesce("component", "first").alias("component_id"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, key: str = "doc_id") -> DataFrame:
    """docs without all but the first document of each group of near copies.

    Pairs of at least the given Jaccard similarity of shingle sets are linked, and no others. SimHash leads to those within
    its limit, bands to the rest: at 0.8 a pair has no band in common, and is missed, with a chance of one in eight million. Texts without words are copies of each other, null ones
    too. Rows with a null key are kept; rows that repeat a key go or stay together. Very long texts are compared whole;
    other columns stay as they are, whatever their names. An empty table gives no rows.
    """
    name = "gone"
    while name in (c.lower() for c in docs.columns):
        name += "_"
    gone = near_copies(docs, similarity, shingle, key=key).where(F.col("component_id") != F.col(key)).select(F.col(key).alias(name)).distinct()
    return docs.join(gone, docs[key].cast("long") == gone[name], "left_anti")
