"""Best-fit decreasing packing of tokenised documents into sequences.

Lengths are integers up to the capacity, so best-fit decreasing over all documents needs only how many
pieces there are of each length: the driver packs that histogram (at most `capacity` rows, whatever the
input) with a segment tree over remaining capacities, and gets runs "pieces number a to b of length L go to
sequences s, s+1, ... at offset o". Each piece then finds its run by its number among the pieces of its
length. The result is what packing one document at a time, longest first, gives.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_bytes, map_texts, saved, table, text_of

CAPACITY, END = 1024, 2
KEPT, LONGEST = 400_000, 48

# The byte-level pre-tokenizer's letters, numbers and white space below U+0250 (fixed values of Unicode).
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t\n\v\f\r \x85\xa0"
PLAIN = re.compile("[\t\n\v\f\r -~\x85\xa0-ɏ]*")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


#: Where one of these stands in a text, or a space at its ends, the text must not be cut at its spaces.
LOOSE = tuple({pair for x in _S for pair in (x + " ", " " + x)})


def _bytes_of(tokenizer) -> dict[bytes, int] | None:
    """The vocabulary as byte strings with their ranks, where ids order the merges; else None."""
    model = json.loads(tokenizer.to_str())["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
    merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or model["type"] != "BPE":
        return None
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Ids:
    """Ids as little-endian 32-bit bytes, through tables of distinct chunks and distinct pre-tokens.

    A text without loose white space is cut at its spaces, which pre-tokens only begin with; other plain
    texts are cut into pre-tokens; texts beyond U+024F or with special tokens go to the tokenizer whole.
    """

    def __init__(self, tokenizer: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer.decode())
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.piece = None
        if ranks := _bytes_of(self.tokenizer):
            import tiktoken

            self.piece = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            found = array("I", self.piece(word.encode())).tobytes() if self.piece else self.whole(word)
            if len(word) <= LONGEST:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        if (found := self.chunks.get(chunk)) is None:
            found = b"".join(map(self.word, WORDS.findall(chunk)))
            if len(chunk) <= LONGEST:
                if len(self.chunks) >= KEPT:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or self.special and self.special.search(text):
            return self.whole(text)
        if any(x in text for x in LOOSE) or text[:1] == " " or text[-1:] == " ":
            return b"".join(map(self.word, WORDS.findall(text)))
        first, *others = text.split(" ")
        return self.chunk(first) + b"".join([self.chunk(x) for x in map(" ".__add__, others)])


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, task, number): whole documents up to the capacity; longer ones cut into full pieces, a shorter one first.

    number counts a task's pieces of one length from 0; the result must be written before the numbers are used.
    """
    names = [key, "piece", "start", "length", "ids_crc32", "task", "number"]
    last = np.array([end], "<u4").tobytes()
    shared = file_bytes(docs.sparkSession, tokenizer)

    def make():
        ids = Ids(shared.value)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], []]
            for k, data in zip(batch.column(0).to_pylist(), map(ids.encode, batch.column(1).to_pylist()), strict=True):
                data += last
                n = len(data) // 4
                at, size, piece = 0, n % capacity or capacity, 0
                while at < n:
                    for column, v in zip(out, (k, piece, at, size, zlib.crc32(memoryview(data)[4 * at : 4 * (at + size)]), seen[size]), strict=True):
                        column.append(v)
                    seen[size] += 1
                    at, size, piece = at + size, capacity, piece + 1
            return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:5]), pa.array([task] * len(out[0]), pa.int64()), pa.array(out[5], pa.int64())], names)

        return work

    schema = f"{key} long, piece int, start long, length long, ids_crc32 long, task long, number long"
    return map_texts(docs.select(F.col(key).cast("long"), text_of(text).alias("text")), "text", make, schema)


class OpenBins:
    """Open sequences by remaining capacity: a segment tree of counts finds the tightest that fits in log time."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, how many)

    def add(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.ranges[left].append((first, n))
            self._count(left, n)

    def _count(self, left: int, n: int) -> None:
        i = self.size + left
        while i:
            self.tree[i] += n
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least length that an open sequence has."""
        i = self.size + length
        if not self.tree[i]:
            while i > 1 and (i % 2 or not self.tree[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to most sequences of that remaining capacity, as one range."""
        first, n = self.ranges[left].pop()
        if n > most:
            self.ranges[left].append((first + most, n - most))
            n = most
        self._count(left, -n)
        return first, n


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, number from, to, first sequence, offset) and the count of sequences, for so many pieces of each length."""
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            left = bins.tightest(length)
            fit = (left or capacity) // length  # a sequence just used stays the tightest while it fits
            want = (total - done) // fit or 1
            if left is None:
                first, n, left = opened, want, capacity
                opened += n
            else:
                first, n = bins.take(left, want)
            each = min(fit, total - done)
            for layer in range(each):
                runs.append((length, done, done + n, first, capacity - left + layer * length))
                done += n
            bins.add(left - each * length, first, n)
    return np.array(runs, np.int64).reshape(-1, 5), opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset.

    A piece's number among all of its length is its number in its task plus the pieces of that length in the tasks
    before, so neither a frequent length nor a repeated key gathers anywhere. Repeated rows are packed as
    documents of their own; no rows give no rows.
    """
    spark = pieces.sparkSession
    pieces = saved(pieces, "pieces")
    sizes = saved(pieces.groupBy("length", "task").count(), "sizes")
    counts = sizes.groupBy("length").agg(F.sum("count").alias("count")).collect()  # at most `capacity` rows
    runs, _ = best_fit({r["length"]: r["count"] for r in counts}, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(bases.hint("merge"), ["length", "task"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("base")).alias("number"))
    shared = spark.sparkContext.broadcast(runs)  # bounded by the capacity, not by the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        stride = 1 + (int(table[:, 2].max()) if len(table) else 0)
        order = np.lexsort((table[:, 1], table[:, 0]))
        table = table[order]
        starts = table[:, 0] * stride + table[:, 1]
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = table[np.searchsorted(starts, length * stride + number, side="right") - 1]
            yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(run[:, 3] + number - run[:, 1]), pa.array(run[:, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document's pieces with their places in as few sequences as best-fit decreasing finds.

    A null or empty text is the end id alone; very long texts are cut as a whole. Null keys, repeated rows and ties are
    documents of their own; other columns are not read, whatever their names. An empty table gives no rows.
    """
    return pack(pieces_of(docs, tokenizer, capacity, end, text, key), capacity, key)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
