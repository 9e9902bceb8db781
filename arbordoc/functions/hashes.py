"""BLAKE3 hashes of many values at once, and stacked hash sequences.

BLAKE3 follows its published specification; chunks of all values go through the compression function together, as
NumPy lanes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from .letters import byte_values, from_byte_values

# Fixed values of the published algorithm.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
MIXES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _compress(chain: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values of n lanes; chain (8, n), block (16, n)."""
    n = chain.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8] = chain
    v[8:12] = IV[:4, None]
    v[12], v[13] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32)
    v[14], v[15] = length, flags
    m = block
    for r in range(7):
        for k, (a, b, c, d) in enumerate(MIXES):
            for word, (p, q) in ((m[2 * k], (16, 12)), (m[2 * k + 1], (8, 7))):
                v[a] += v[b] + word
                x = v[d] ^ v[a]
                v[d] = x >> np.uint32(p) | x << np.uint32(32 - p)
                v[c] += v[d]
                x = v[b] ^ v[c]
                v[b] = x >> np.uint32(q) | x << np.uint32(32 - q)
        if r < 6:
            m = m[ORDER]
    return v[:8] ^ v[8:]


def blake3_many(values: list[bytes]) -> list[bytes]:
    """The 32-byte hash of each value."""
    if not values:
        return []
    counts = np.array([max(1, -(-len(v) // CHUNK)) for v in values])
    owner = np.repeat(np.arange(len(values)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.minimum(CHUNK, np.array([len(v) for v in values])[owner] - number * CHUNK).clip(0)
    padded = b"".join(v.ljust(c * CHUNK, b"\0") for v, c in zip(values, counts.tolist(), strict=True))
    words = np.frombuffer(padded, "<u4").reshape(len(owner), CHUNK // BLOCK, 16)
    chain = np.repeat(IV[:, None], len(owner), axis=1)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    single = counts[owner] == 1
    for b in range(int(blocks.max())):
        lane = np.flatnonzero(blocks > b)
        last = blocks[lane] == b + 1
        flags = np.full(len(lane), CHUNK_START if b == 0 else 0) | np.where(last, CHUNK_END, 0) | np.where(last & single[lane], ROOT, 0)
        chain[:, lane] = _compress(chain[:, lane], np.ascontiguousarray(words[lane, b].T), number[lane].astype(np.uint64), np.minimum(BLOCK, sizes[lane] - b * BLOCK).astype(np.uint32), flags.astype(np.uint32))
    # neighbours of one value join level by level; an odd last one goes up as it is
    while len(owner) > len(values):
        left = counts[owner]
        first = (number % 2 == 0) & (number + 1 < left)
        a = np.flatnonzero(first)
        final = (left[a] == 2).astype(np.uint32) * ROOT
        joined = _compress(np.repeat(IV[:, None], len(a), axis=1), np.concatenate([chain[:, a], chain[:, a + 1]]), np.zeros(len(a), np.uint64), np.full(len(a), BLOCK, np.uint32), final | np.uint32(PARENT))
        chain[:, a] = joined
        keep = number % 2 == 0
        chain, owner, number = chain[:, keep], owner[keep], number[keep] // 2
        counts = (counts + 1) // 2
    return [c.astype("<u4").tobytes() for c in chain.T]


def blake3(value: bytes) -> bytes:
    return blake3_many([value])[0]


@F.pandas_udf(BinaryType())
def blake3_column(values: pd.Series) -> pd.Series:
    """Arrow-batched; null stays null."""
    have = values.notna()
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    out[have] = blake3_many([bytes(v) for v in values[have]])
    return out


# Hash sizes by index, fixed values of the format.
SIZES = (8, 10, 12, 16, 20, 24, 28, 32, 48, 64)
FIRST, NEXT = 4, 2
CADENCE = 0x79


def cadence_byte(first: int, following: int, size: int) -> int:
    if not (1 <= following <= 4 and 0 <= first - following <= 3 and size in SIZES):
        raise ValueError("no such cadence")
    return following - 1 | (first - following) << 2 | SIZES.index(size) << 4


def parameters(stack: bytes) -> tuple[int, int, int, int]:
    """(first step, later step, hash size, count) of a stacked sequence. ValueError where its length does not fit."""
    c = 0
    for b in stack:
        c ^= b
    following = (c & 3) + 1
    first = following + (c >> 2 & 3)
    if c >> 4 >= len(SIZES):
        raise ValueError("reserved hash size")
    size = SIZES[c >> 4]
    n = len(stack) - 1
    if n == size:
        return first, following, size, 1
    more, rest = divmod(n - size - first, following)
    if n < size + first or rest:
        raise ValueError("length does not fit the cadence")
    return first, following, size, more + 2


def offset(i: int, first: int = FIRST, following: int = NEXT) -> int:
    return 0 if i == 0 else first + (i - 1) * following


def stack_hashes(hashes: list[bytes], first: int = FIRST, following: int = NEXT) -> bytes:
    """Hashes XORed together at growing offsets, and a last byte that makes the XOR of all bytes the cadence byte."""
    if not hashes or len({len(h) for h in hashes}) > 1:
        raise ValueError("stacks hold at least one hash, all of one size")
    size = len(hashes[0])
    body = bytearray(size + offset(len(hashes) - 1, first, following))
    for i, h in enumerate(hashes):
        at = offset(i, first, following)
        for j, b in enumerate(h):
            body[at + j] ^= b
    last = cadence_byte(first, following, size)
    for b in body:
        last ^= b
    return bytes(body) + bytes([last])


class HashLibrary:
    """Known hashes by their prefixes."""

    def __init__(self, hashes=(), longest: int = 7):
        self.by_prefix: dict[bytes, list[bytes]] = {}
        self.longest = longest
        for h in hashes:
            self.add(h)

    def add(self, h: bytes) -> None:
        for k in range(1, self.longest + 1):
            own = self.by_prefix.setdefault(h[:k], [])
            if h not in own:
                own.append(h)

    def lookup(self, prefix: bytes) -> list[bytes]:
        return self.by_prefix.get(prefix, [])


def unstack(stack: bytes, library: HashLibrary) -> list[bytes] | None:
    """The stacked hashes by a search with return, or None where the library has no sequence that fits."""
    try:
        first, following, size, n = parameters(stack)
    except ValueError:
        return None
    work = [(int.from_bytes(stack[:-1]), ())]
    total = len(stack) - 1
    while work:
        body, found = work.pop()
        i = len(found)
        if i == n:
            if body == 0:
                return list(found)
            continue
        at, k = offset(i, first, following), following if i else first
        prefix = body.to_bytes(total)[at : at + k]
        for h in reversed([h for h in library.lookup(prefix) if len(h) == size]):
            work.append((body ^ int.from_bytes(h) << 8 * (total - at - size), (*found, h)))
    return None


def stack_column(hashes: Column, first: int = FIRST, following: int = NEXT, size: int = 32) -> Column:
    """binary of an array<binary> column of hashes of that size, by built-in functions."""
    n = F.size(hashes)
    total = F.lit(size) + F.when(n > 1, F.lit(first) + (n - 2) * following).otherwise(0)
    at = lambda i: F.when(i == 0, 0).otherwise(F.lit(first) + (i - 1) * following)
    zeros = F.array_repeat(F.lit(0), total)
    padded = F.transform(hashes, lambda h, i: F.concat(F.array_repeat(F.lit(0), at(i)), byte_values(h), F.array_repeat(F.lit(0), total - at(i) - size)))
    body = F.aggregate(padded, zeros, lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))
    last = F.aggregate(body, F.lit(cadence_byte(first, following, size)), lambda a, b: a.bitwiseXOR(b))
    return from_byte_values(F.concat(body, F.array(last)))


def is_compatible(consumer: Column, document: Column) -> Column:
    """Whether a consumer's hash sequence is a subsequence of a document's; both array<binary>."""
    matched = F.aggregate(document, F.lit(0), lambda k, h: k + F.when((k < F.size(consumer)) & (F.get(consumer, k) == h), 1).otherwise(0))
    return matched == F.size(consumer)


def with_unstacked(df: DataFrame, stack: str, out: str, library: HashLibrary) -> DataFrame:
    """df with an array<binary> column of each stacked sequence, null where the library has none that fits.

    The library goes to every task; it is bounded by the known schemas.
    """
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(BinaryType()))])
    kind = pa.list_(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if v is None else unstack(v, library) for v in batch.column(batch.schema.get_field_index(stack)).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)
