"""Removal of passages that repeat from an earlier document, by merged Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

1. Documents lie in chunks. In every string of `length` bytes, the 16 bytes with the least hash are its anchor, so equal
   strings have equal anchors. Anchors' hashes are dealt by hash; one that two documents have is shared, one with very many
   contexts is hot.
2. What stands around a shared anchor (the bytes of all strings that it is the anchor of, 84 at most) is a
   context. A chunk's distinct contexts, each with its least document id, are dealt by the anchor's hash: equal
   strings meet in one bucket. A context of a hot anchor is cut in two, the strings that begin well before the anchor and
   the others, each dealt by the bytes before or behind the anchor, too: all its strings have them.
3. A bucket's contexts form shards. Each shard is sorted on its own and gives its Burrows-Wheeler transform, up
   to four bytes a step. The transforms are merged by refining the interleave: knowing which shard each rank
   comes from when suffixes are ordered by their first h bytes, a stable distribution of the ranks by the k bytes
   before them gives the same for h + k. Where neighbours part for the first time, their common prefix ends. Intervals that have
   not parted after `length` bytes are the repeated strings; each has a least document id. No suffix is sorted again.
   Before that, contexts are cut to the strings whose hashes more than one context has.
4. Each context gets back the least ids of its strings, and the chunks mark what is to go.

An exact string comparison decides (contexts travel as bytes); hashes only choose candidates, and a collision adds
candidates at most. Nothing reaches the driver but the count of bytes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, saved, slices, table

LENGTH, GRAM = 50, 16
#: Bytes of text whose anchors make a bucket; contexts in a bucket, those of copies included; bytes of contexts in a shard.
BUCKET, CONTEXTS, SHARD = 16 << 20, 1 << 16, 1 << 19
#: Buckets of contexts that are dealt together: a chunk sends one row to each such deal, so that rows stay few.
DEAL = 4
PRIME = 0x100000001B3
#: Starts of strings whose anchors are sought at once.
PIECE = 1 << 16
#: Contexts of an anchor beyond which they are dealt by more than the anchor.
HOT = 4096
END = 0xFF  # ends a context; no UTF-8 text holds this byte
NO_ID = np.iinfo(np.int64).max


def chunked(docs: DataFrame, text: str) -> DataFrame:
    """(chunk, n_bytes, rows): documents in slices of a few MB, as compressed Arrow streams with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(slices(batches, text)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 2))) as out:
                out.write_batch(batch)
            n = batch.column(batch.schema.get_field_index(text)).nbytes
            yield pa.record_batch([pa.array([part << 33 | i], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_bytes", "rows"])

    return docs.mapInArrow(run, "chunk long, n_bytes long, rows binary")


class Chunk:
    """A chunk's texts as one byte array, with the anchors of all its strings where they are asked for."""

    def __init__(self, rows: bytes, key: str, text: str, length: int, anchors: bool = True):
        self.batch = pa.ipc.open_stream(rows).read_next_batch()
        self.length = length
        ids = self.batch.column(self.batch.schema.get_field_index(key)).to_pylist()
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.data, ends = bytes_of(self.batch.column(self.batch.schema.get_field_index(text)))
        self.sizes = np.diff(ends)
        self.begins = ends[:-1]
        if anchors:
            self._anchors()

    def _anchors(self) -> None:
        """Runs of strings with one anchor: first and last start, the anchor's hash, the row."""
        span = self.length - GRAM + 1
        data = np.frombuffer(self.data, np.uint8)
        self.first = self.last = self.row = self.at = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        full = self.sizes >= self.length
        if not full.any():
            return
        at, h = anchors_of(data, span)
        begins, counts = self.begins[full], self.sizes[full] - self.length + 1
        starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        anchor = at[starts]
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        self.first = starts[new]
        self.last = starts[np.concatenate([new[1:], [len(starts)]]) - 1]
        self.at = anchor[new].astype(np.int64)
        self.hash = h[self.at] & ~np.uint64(1)
        self.row = np.searchsorted(self.begins, self.first, side="right") - 1
        # rows without text share a begin with the next one; the last of them is the one that holds it

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, whose lowest bit tells whether two of the chunk's documents have it, and their runs (255 at most)."""
        if not len(self.hash):
            return self.hash, np.zeros(0, np.uint8)
        order = np.argsort(self.hash, kind="stable")
        h, ids = self.hash[order], self.ids[self.row[order]]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        runs = np.diff(np.concatenate([starts, [len(h)]]))
        return h[starts] | (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)).astype(np.uint64), np.minimum(runs, 255).astype(np.uint8)

    def contexts(self, shared: list[dict], buckets: int, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs with shared anchors, hot ones in two: their first strings, rows and contexts' numbers; the distinct contexts, their least and greatest ids and buckets.

        buckets: those that anchors were dealt to; fine: those of contexts.
        """
        wide, one = np.uint64(40), np.uint64(1)
        keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.uint64(x["bucket"]) << wide | unpacked(x["shared"]) for x in shared)]))
        own = bucket_of(self.hash, buckets).astype(np.uint64) << wide | self.hash & LOW
        at = np.searchsorted(keys, own)
        found = keys[np.minimum(at, len(keys) - 1)] if len(keys) else np.zeros(len(own), np.uint64)
        is_shared = (found & ~one == own) & (len(keys) > 0)
        runs = np.flatnonzero(is_shared)
        first, last, row, bucket = self.first[runs], self.last[runs], self.row[runs], bucket_of(self.hash[runs], fine)
        if (hot := np.flatnonzero(found[runs] & one)).size:
            half = (self.length - GRAM) // 2
            data = np.frombuffer(self.data, np.uint8)
            anchor = self.at[runs[hot]]
            before, behind = first[hot] <= anchor - half, last[hot] > anchor - half

            def spread(h: np.ndarray, at: np.ndarray) -> np.ndarray:
                """Buckets by an anchor's hash and the `half` bytes from `at` on."""
                for k in range(half):
                    h = (h ^ data[at + k]) * np.uint64(PRIME)
                return bucket_of(h ^ h >> np.uint64(29), fine)

            a, b = hot[before], hot[behind]
            cool = np.setdiff1d(np.arange(len(runs)), hot)
            p, q = anchor[before], anchor[behind]
            parts = [(first[cool], last[cool], row[cool], bucket[cool]), (first[a], np.minimum(last[a], p - half), row[a], spread(self.hash[runs[a]], p - half)), (np.maximum(first[b], q - half + 1), last[b], row[b], spread(self.hash[runs[b]], q + GRAM))]
            first, last, row, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        seen: dict[bytes, int] = {}  # equal contexts have one anchor, are cut alike and so are in one bucket
        which = np.array([seen.setdefault(self.data[a:b], len(seen)) for a, b in zip(first.tolist(), (last + self.length).tolist(), strict=True)], np.int64)
        least, most, buckets_of = np.full(len(seen), NO_ID), np.full(len(seen), -1 - NO_ID), np.zeros(len(seen), np.int64)
        np.minimum.at(least, which, self.ids[row])
        np.maximum.at(most, which, self.ids[row])
        buckets_of[which] = bucket
        return first, row, which, list(seen), least, most, buckets_of


def anchors_of(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the gram of least hash stands among the `span` grams from each byte on, the first of equal ones; all grams' hashes).

    A piece at a time, so that what a piece needs stays in the processor's caches.
    """
    n = len(data) - GRAM + 1
    at, h = np.empty(n - span + 1, np.int32), np.empty(n, np.uint64)
    low = np.uint64(20)  # bits for the place within a piece; the others decide
    for begin in range(0, len(at), PIECE):
        end = min(begin + PIECE, len(at))
        own = _rolling(data[begin : end + span + GRAM - 2], GRAM)
        own ^= own >> np.uint64(32)
        own *= np.uint64(0x9E3779B97F4A7C15)
        own ^= own >> np.uint64(29)
        h[begin : begin + len(own)] = own
        least = (own >> low << low) | np.arange(len(own), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at[begin:end] = (least & np.uint64((1 << 20) - 1)).astype(np.int32) + begin
    return at, h


def bytes_of(column: pa.StringArray) -> tuple[bytes, np.ndarray]:
    """All texts of a column as one string of bytes, and where each begins and the last ends; nulls are empty."""
    column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return data[int(ends[0]) : int(ends[-1])].to_pybytes() if data else b"", ends - ends[0]


def _rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n bytes; by doubling, and a byte more where n's binary form has a one."""
    h = one = data.astype(np.uint64)
    width = 1
    for bit in bin(n)[3:]:
        h = h[:-width] * np.uint64(pow(PRIME, width, 1 << 64)) + h[width:]
        width *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(PRIME) + one[width:]
            width += 1
    return h


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


LOW = np.uint64((1 << 40) - 1)


def packed(h: np.ndarray) -> bytes:
    """The low 40 bits of each hash; with the bucket they tell anchors apart well enough for candidates."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition that is sorted by its first column, a group at a time."""
    rows = ((b.column(0)[i].as_py(), b, i) for b in batches for i in range(b.num_rows))
    for k, same in itertools.groupby(rows, key=lambda r: r[0]):
        yield k, [{n: b.column(n)[i].as_py() for n in b.schema.names} for _, b, i in same]


def transform(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a shard's rotations in order (by 72 bytes), and the four bytes before each as a number."""
    text = np.frombuffer(b"".join(c + b"\xff" for c in contexts), np.uint8)
    sizes = np.array([len(c) + 1 for c in contexts], np.int64)
    size = np.repeat(sizes, sizes)
    at = np.arange(len(text))
    end = np.repeat(np.cumsum(sizes), sizes)

    def ahead(k: int) -> np.ndarray:
        """The position k bytes on in the same rotation."""
        if k >= sizes.min():
            return end - size + (at - end + size + k) % size
        p = at + k
        return np.where(p >= end, p - size, p)

    one, two, four = (ahead(k) for k in (1, 2, 4))
    pair = text.astype(np.uint32) << np.uint32(8) | text[one]
    quad = pair << np.uint32(16) | pair[two]
    value = quad.astype(np.uint64) << np.uint64(32) | quad[four]
    bits = np.uint64(21)
    for k in (8, 24):
        if len(text) >= 1 << 21:
            raise ValueError("shard too large")
        rank = dense(value)
        value = rank << bits + bits | rank[ahead(k)] << bits | rank[ahead(2 * k)]
    order = np.argsort(value)
    before = np.empty(len(text), np.uint32)
    before[four] = quad
    return order, before[order]


def dense(value: np.ndarray) -> np.ndarray:
    """Ranks of values, equal ones alike."""
    order = np.argsort(value)
    new = np.concatenate([[False], value[order[1:]] != value[order[:-1]]]) if len(value) else np.zeros(0, bool)
    out = np.empty(len(value), np.uint64)
    out[order] = np.cumsum(new).astype(np.uint64)
    return out


def widest(four: np.ndarray, two: np.ndarray) -> tuple[int, np.ndarray]:
    """The most bytes, of four, three or two, whose values 16 bits can number, and their numbers in order."""
    values, number = np.unique(four, return_inverse=True)
    if len(values) <= 1 << 16:
        return 4, number.astype(np.uint16)
    values, number = np.unique(four & np.uint32(0xFFFFFF), return_inverse=True)
    return (3, number.astype(np.uint16)) if len(values) <= 1 << 16 else (2, two)


def merge(transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(merged rank of each shard's ranks, one shard after another; common prefixes with the rank before).

    A round prepends as many bytes as 16 bits can number in their order: four, three or two. A prefix is
    counted in whole rounds up to `length`; what is equal in all of them has `length`.
    """
    four = np.concatenate(transforms)
    two = (four & np.uint32(0xFFFF)).astype(np.uint16)
    wide, number = widest(four, two)
    many = (length // wide) - (length // wide * wide - length) % 2  # what is left must be whole pairs
    rounds = [2] * ((length - many * wide) // 2) + [wide] * many
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16 if len(transforms) > 256 else np.uint8), [len(t) for t in transforms])
    n = len(four)
    place = np.arange(n)
    block = np.zeros(n, np.int32)
    prefix = np.full(n, length, np.int16)
    parted = np.zeros(n, bool)
    parted[:1] = True
    prefix[:1] = 0
    before = np.empty(n, np.uint16)
    depth = 0
    for step in rounds:
        before[place] = number if step == wide else two
        order = np.argsort(before, kind="stable")
        shard, block, ordered = shard[order], block[order], before[order]
        now = np.ones(n, bool)
        now[1:] = (ordered[1:] != ordered[:-1]) | (block[1:] != block[:-1])
        prefix[now & ~parted] = depth
        depth += step
        parted = now
        block = np.cumsum(now, dtype=np.int32)
        place = np.argsort(shard, kind="stable")
    return place, prefix


def least_ids(shards: list[list[bytes]], least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all contexts, shard after shard, runs of strings with one least id: (runs in each context, their lengths, ids)."""
    sorted_shards = [transform(s) for s in shards]
    place, prefix = merge([t for _, t in sorted_shards], length)
    sizes = np.array([len(c) for s in shards for c in s], np.int64)
    base = np.cumsum([0, *(len(o) for o, _ in sorted_shards)])
    position = np.empty(len(place), np.int64)
    position[place] = np.concatenate([o + b for (o, _), b in zip(sorted_shards, base[:-1].tolist(), strict=True)])
    context = np.repeat(np.arange(len(sizes)), sizes + 1)
    starts = np.flatnonzero(prefix < length)  # where an interval of equal strings begins
    best = np.minimum.reduceat(least[context[position]], starts)
    at = np.empty(len(place), np.int64)
    at[position] = np.repeat(best, np.diff(np.concatenate([starts, [len(place)]])))
    ends = np.cumsum(sizes + 1) - sizes - 1
    strings = sizes - length + 1
    where = np.repeat(ends - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
    ids, owner = at[where], np.repeat(np.arange(len(sizes)), strings)
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])]))
    lengths = np.diff(np.concatenate([new, [len(ids)]]))
    return np.bincount(owner[new], minlength=len(sizes)), lengths, ids[new]


def repeated(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last string of each context whose hash another context has too; first > last where none has."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    h = _rolling(data, length)
    strings = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), strings)
    offset = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    h = h[np.repeat(np.cumsum(sizes) - sizes, strings) + offset]
    order = np.argsort(h)
    starts = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
    size = np.diff(np.concatenate([starts, [len(h)]]))
    some = np.zeros(len(h), bool)
    some[order] = np.repeat(np.minimum.reduceat(owner[order], starts) != np.maximum.reduceat(owner[order], starts), size)
    first, last = strings.copy(), np.full(len(sizes), -1)
    np.minimum.at(first, owner[some], offset[some])
    np.maximum.at(last, owner[some], offset[some])
    return first, last


def answer(contexts: list[bytes], least: np.ndarray, several: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As least_ids, for a bucket's contexts. several: which of them more than one document has.

    Contexts are cut to the strings that may repeat before their transforms are built; what is cut off keeps the
    context's own least id.
    """
    strings = np.array([len(c) for c in contexts], np.int64) - length + 1
    first, last = repeated(contexts, length)
    first, last = np.where(several, 0, first), np.where(several, strings - 1, last)
    number: dict[bytes, int] = {}
    kept = np.flatnonzero(first <= last)
    cut = np.array([number.setdefault(contexts[i][a : b + length], len(number)) for i, a, b in zip(kept.tolist(), first[kept].tolist(), last[kept].tolist(), strict=True)], np.int64)
    shards, size = [[]], 0
    for c in number:
        if size > SHARD:
            shards.append([])
            size = 0
        shards[-1].append(c)
        size += len(c) + 1
    own = np.full(len(number), NO_ID)
    np.minimum.at(own, cut, least[kept])
    counts, lengths, values = least_ids(shards, own, length) if number else (np.zeros(0, np.int64),) * 3
    # a run before, the runs of the part that was kept, a run behind
    n = np.full(len(contexts), 2)
    n[kept] += counts[cut]
    begins = np.cumsum(n) - n
    out_lengths, out_values = np.zeros(n.sum(), np.int64), np.repeat(least, n)
    out_lengths[begins] = np.where(first <= last, first, strings)
    out_lengths[begins[kept] + n[kept] - 1] = strings[kept] - 1 - last[kept]
    m = counts[cut]
    steps = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    to = np.repeat(begins[kept] + 1, m) + steps
    source = np.repeat((np.cumsum(counts) - counts)[cut], m) + steps
    out_lengths[to], out_values[to] = lengths[source], values[source]
    return n, out_lengths, out_values


def in_groups(bucket: np.ndarray, together: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """Each group of so many buckets that follow each other, and where they stand, bucket after bucket."""
    order = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[order] // together, return_index=True)
    return zip(used.tolist(), np.split(order, starts[1:]), strict=False)  # without buckets there is one part, an empty one


def _binary(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def find_repeats(docs: DataFrame, finish: Callable[[Chunk, np.ndarray], pa.RecordBatch], schema: str | T.StructType, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """finish(chunk, removed) for each chunk of docs, where removed marks the bytes of its texts that go.

    length: even, and at least 18. Null and empty texts lose nothing; a null id is larger than any other; rows
    that repeat an id do not repeat each other. An empty table gives an empty result.
    """
    if length % 2 or length < GRAM + 2:
        raise ValueError("length must be even and at least 18")
    chunks = bucketed(chunked(docs, text), "chunks", "chunk")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = total // BUCKET + 8

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, runs = Chunk(batch.column(1)[i].as_py(), key, text, length).hashes()
                used, data = [], []
                for bucket, own in in_groups(bucket_of(h, buckets)):
                    used.append(bucket)
                    data.append(packed(h[own]) + runs[own].tobytes())
                yield pa.record_batch([pa.array(used, pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(used), pa.int64()), pa.array(data, pa.binary())], ["bucket", "chunk", "hashes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groups(batches):
            one = np.uint64(1)
            each = [unpacked(r["hashes"][: len(r["hashes"]) // 6 * 5]) for r in rows]
            runs = np.concatenate([np.frombuffer(r["hashes"][len(x) * 5 :], np.uint8) for r, x in zip(rows, each, strict=True)])
            h = np.concatenate(each)
            keys, at, n = np.unique(h >> one, return_inverse=True, return_counts=True)
            several = np.zeros(len(keys), bool)
            several[at[h & one == one]] = True
            is_shared, is_hot = several | (n > 1), np.bincount(at, runs, len(keys)) > HOT
            mark = keys << one | is_hot.astype(np.uint64)
            cuts = np.cumsum([len(x) for x in each])[:-1]
            found = [mark[k][is_shared[k]] for k in np.split(at, cuts)]
            several_runs = np.add.reduceat(np.where(is_shared[at], runs, 0).astype(np.int64), np.concatenate([[0], cuts]).astype(np.int64))
            yield pa.record_batch([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array(several_runs), pa.array(map(packed, found), pa.binary())], ["chunk", "bucket", "runs", "shared"])

    dealt = chunks.select("chunk", "rows").mapInArrow(anchors, "bucket long, chunk long, hashes binary").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(meet, "chunk long, bucket long, runs long, shared binary").where(F.octet_length("shared") > 0)
    shared = saved(shared.groupBy("chunk").agg(F.sum("runs").alias("runs"), F.collect_list(F.struct("bucket", "shared")).alias("shared")), "shared")
    deals = (shared.agg(F.sum("runs")).first()[0] or 0) // (CONTEXTS * DEAL) + 8
    joined = chunks.select("chunk", "rows").join(shared.select("chunk", "shared"), "chunk")

    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's contexts by deal, each with how many its buckets have, and in bucket -1 where they stand: what is marked later without another search."""
        quick, small = zstandard.ZstdCompressor(1), zstandard.ZstdCompressor(3)
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("chunk")[i].as_py()
                chunk = Chunk(batch.column("rows")[i].as_py(), key, text, length)
                first, row, which, contexts, least, most, bucket = chunk.contexts(batch.column("shared")[i].as_py() or [], buckets, deals * DEAL)
                out: list[tuple] = [(-1, number, quick.compress(_binary(first.astype("<i4"), row.astype("<i4"), which.astype("<i4"))), quick.compress(bucket.tobytes()))]
                for deal, own in in_groups(bucket, DEAL):
                    sizes = np.bincount(bucket[own] % DEAL, minlength=DEAL)
                    out.append((deal, number, quick.compress(b"\xff".join([contexts[j] for j in own.tolist()])), small.compress(_binary(sizes, least[own], most[own]))))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "chunk", "contexts", "least"])

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, opened = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for deal, rows in groups(batches):
            held, out = [], [[] for _ in rows]
            for r in rows:
                data = np.frombuffer(opened.decompress(r["least"]), np.int64)
                held.append((opened.decompress(r["contexts"]).split(b"\xff"), np.cumsum([0, *data[:DEAL]]).tolist(), data[DEAL:].reshape(2, -1)))
            for k in range(DEAL):
                number: dict[bytes, int] = {}
                which = [np.array([number.setdefault(c, len(number)) for c in contexts[ends[k] : ends[k + 1]]], np.int64) for contexts, ends, _ in held]
                if not number:
                    continue
                ids = np.concatenate([own[:, ends[k] : ends[k + 1]] for _, ends, own in held], axis=1)
                least, most = np.full(len(number), NO_ID), np.full(len(number), -1 - NO_ID)
                np.minimum.at(least, np.concatenate(which), ids[0])
                np.maximum.at(most, np.concatenate(which), ids[1])
                counts, lengths, values = answer(list(number), least, most > least, length)
                begins = np.cumsum(counts) - counts
                for parts, own in zip(out, which, strict=True):
                    n = counts[own]
                    runs = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    parts.append((n.astype(np.uint8), lengths[runs].astype(np.uint8), values[runs]))
            data = [small.compress(_binary(*itertools.chain(*zip(*parts, strict=True)))) for parts in out]
            yield pa.record_batch([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([deal] * len(rows), pa.int64()), pa.array([x[1][-1] for x in held], pa.int32()), pa.array(data, pa.binary())], ["chunk", "bucket", "n", "answer"])

    placed = saved(joined.mapInArrow(around, "bucket long, chunk long, contexts binary, least binary"), "contexts", compression="uncompressed")
    met = placed.where("bucket >= 0").repartitionById(deals, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    answers = met.mapInArrow(repeats, "chunk long, bucket long, n int, answer binary")
    answers = saved(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "answer")).alias("answers")), "answers")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column("rows")[i].as_py(), key, text, length, anchors=False)
                runs, of = (b"" if batch.column(k)[i].as_py() is None else opened.decompress(batch.column(k)[i].as_py()) for k in ("runs", "of"))
                first, row, which = np.frombuffer(runs, "<i4").reshape(3, -1).astype(np.int64)
                bucket = np.frombuffer(of, np.int64)
                counts = np.zeros(len(bucket), np.int64)
                parts, places = {}, dict(in_groups(bucket, DEAL))
                for a in batch.column("answers")[i].as_py() or []:
                    own = places[a["bucket"]]
                    data, n = opened.decompress(a["answer"]), a["n"]
                    counts[own] = np.frombuffer(data, np.uint8, n)
                    m = int(counts[own].sum())
                    parts[a["bucket"]] = own, np.frombuffer(data, np.uint8, m, n), np.frombuffer(data[n + m :], np.int64)
                begins = np.cumsum(counts) - counts
                lengths, ids = np.zeros(counts.sum(), np.int64), np.zeros(counts.sum(), np.int64)
                for own, l, v in parts.values():
                    n = counts[own]
                    to = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    lengths[to], ids[to] = l, v
                after = np.cumsum(lengths)
                change = np.zeros(len(chunk.data) + 1, np.int32)
                if len(first):
                    n = counts[which]
                    at = np.repeat(begins[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    head = after[begins[which]] - lengths[begins[which]]  # strings before the context's first run
                    start = np.repeat(first - head, n) + after[at] - lengths[at]
                    gone = ids[at] < np.repeat(chunk.ids[row], n)
                    np.add.at(change, start[gone], 1)
                    np.add.at(change, start[gone] + lengths[at][gone] - 1 + length, -1)
                yield finish(chunk, np.cumsum(change[:-1]) > 0)

    # a chunk without shared anchors has no row in placed or answers
    runs = placed.where("bucket = -1").select("chunk", F.col("contexts").alias("runs"), F.col("least").alias("of"))
    marked = chunks.select("chunk", "rows").join(runs.join(answers, "chunk"), "chunk", "left").select("rows", "runs", "of", "answers")
    return marked.mapInArrow(mark, schema)


def report(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def finish(chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        data = np.frombuffer(chunk.data, np.uint8)
        rows = []
        for a, n in zip(chunk.begins.tolist(), chunk.sizes.tolist(), strict=True):
            gone = removed[a : a + n]
            lost = int(gone.sum())
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if lost else 0
            kept = data[a : a + n][~gone].tobytes() if lost else chunk.data[a : a + n]
            rows.append((n, lost, spans, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.record_batch([chunk.batch.column(chunk.batch.schema.get_field_index(key)), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names)

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return find_repeats(rows, finish, f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, text, key)


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", counted: str = "n_chars") -> DataFrame:
    """docs with what repeats taken out of their texts, and the count of characters made anew.

    A character that loses one of its bytes goes as a whole. Rows whose texts end up empty stay.
    """

    def finish(chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        batch = chunk.batch
        i = batch.schema.get_field_index(text)
        data, texts = np.frombuffer(chunk.data, np.uint8), batch.column(i).to_pylist()
        changed = set()
        for r, (a, n) in enumerate(zip(chunk.begins.tolist(), chunk.sizes.tolist(), strict=True)):
            gone = removed[a : a + n]
            if gone.any():
                texts[r] = data[a : a + n][~gone].tobytes().decode("utf-8", "ignore")
                changed.add(r)
        batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
        if (j := batch.schema.get_field_index(counted)) >= 0:
            counts = [len(texts[r]) if r in changed else c for r, c in enumerate(batch.column(j).to_pylist())]
            batch = batch.set_column(j, batch.schema.field(j), pa.array(counts, batch.schema.field(j).type))
        return batch

    return find_repeats(docs, finish, docs.schema, length, text, key)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
