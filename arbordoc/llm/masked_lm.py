"""Document scores by masked pseudo-likelihood.

A network sees the two words on either side of a masked word and predicts it. Words are numbered over the
whole corpus: the most frequent ones get numbers of their own, all others share buckets by hash. A number has two
digits; the network predicts the first digit, then the second one given the first, so that a prediction
costs the root of the vocabulary. A document's score is the sum of the log-probabilities of all its words, each
given its neighbours.

The network gives the probability of a number; counts of all words and of all pairs of neighbours bring it down to the
single word. They grow with the corpus and are never on one machine: blocks of texts ask for the totals of their own
distinct words and pairs, tasks add what all blocks have of a range of hashes and answer each. See `mixed`.

Documents are dealt to blocks by a hash of key and text, in numbers that follow from the corpus's size alone, so neither
counts nor training depend on how the table lies. Every block trains the same starting network on its own texts, in
order; the results are averaged by the words they saw. This is one round of local training; `rounds` repeats it from the
average. Every word of every document is counted, trained on and scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table, text_of, tree_sum

BASE = 32  # digits; BASE * BASE numbers
OTHERS = 256  # numbers that rarer words share
EDGE = BASE * BASE  # the number of what lies beyond a document's ends
KNOWN = EDGE - OTHERS  # words with numbers of their own
WIDTH, SPAN = 16, 2
BATCH, RATE = 2048, 0.1
SHAPES = {"context": (2 * SPAN, EDGE + 1, WIDTH), "first": (WIDTH, BASE), "first_bias": (BASE,), "second": (WIDTH, BASE), "second_bias": (BASE, BASE)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
#: Bytes of the corpus for each range of hashes that a task adds up: some 3 million words.
RANGE = 16 << 20
#: Bytes of text in a block, which asks for its words and pairs at once; so many tasks deal and form blocks at most.
BLOCK, TASKS = 4 << 20, 50_000
#: Half an occurrence is given to every word of a bucket, so that a word seen nowhere else has a share.
HALF = 0.5


class Network:
    """Parameters as views of one flat array."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, seed: int = 11) -> Network:
        return cls(np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = np.take(self.context[0], around[:, 0], axis=0)
        for k in range(1, 2 * SPAN):
            h += np.take(self.context[k], around[:, k], axis=0)
        return np.tanh(h, out=h)

    def forward(self, around: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """What step needs: the hidden layer, both digits, and for each the exponentials of all its values with their sums."""
        h = self.hidden(around)
        a, b = word // BASE, word % BASE
        return h, a, b, *_exponentials(h @ self.first + self.first_bias), *_exponentials(h @ self.second + self.second_bias[a])

    def log_probability(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        _, a, b, p, all_p, q, all_q = self.forward(around, word)
        i = np.arange(len(word))
        return np.log(p[i, a] / all_p + 1e-30) + np.log(q[i, b] / all_q + 1e-30)

    def step(self, around: np.ndarray, word: np.ndarray, sums: Network) -> None:
        """One AdaGrad step; sums: the squared gradients so far."""
        h, a, b, p, all_p, q, all_q = self.forward(around, word)
        i, n = np.arange(len(word)), np.float32(len(word))
        p /= all_p[:, None]
        q /= all_q[:, None]
        p[i, a] -= 1
        q[i, b] -= 1
        p /= n
        q /= n
        back = (p @ self.first.T + q @ self.second.T) * (1 - h * h)
        _move(self.second_bias, sums.second_bias, *_added(a, q))
        for name, g in (("first", h.T @ p), ("first_bias", p.sum(0)), ("second", h.T @ q)):
            _move(getattr(self, name), getattr(sums, name), ..., g)
        for k in range(2 * SPAN):
            _move(self.context[k], sums.context[k], *_added(around[:, k], back))


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row's values, less its greatest one, and their sums; rows are short, so halves are compared and a product adds."""
    most = x
    while most.shape[1] > 1:
        half = most.shape[1] // 2
        most = np.maximum(most[:, :half], most[:, half:])
    x = x - most
    return np.exp(x, out=x), x @ np.ones(x.shape[1], x.dtype)


def _added(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sum of each one's rows."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.add.reduceat(np.take(rows, order, axis=0), starts)


def _move(value: np.ndarray, total: np.ndarray, where, g: np.ndarray) -> None:
    new = total[where] + g * g
    total[where] = new
    value[where] -= RATE * g / np.sqrt(new + 1e-8)


class Vocabulary:
    """Numbers of words by their hashes: the known ones' own, the others' buckets, with what is counted of each bucket."""

    def __init__(self, known: list[tuple[int, int]], sums: np.ndarray):
        """known: (hash, occurrences), the most frequent first; sums: occurrences and distinct words of all words by bucket."""
        hashes = np.array([h for h, _ in known], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int16)
        self.sums = sums.copy()
        for h, n in known:
            self.sums[:, h % OTHERS] -= (n, 1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = (KNOWN + (hashes % np.uint64(OTHERS)).astype(np.int64)).astype(np.int16)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            own = self.hashes[at] == hashes
            out[own] = self.numbers[at[own]]
        return out

    def share(self, number: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The share of its number that a word with n occurrences has, the one that is scored left out."""
        bucket = np.maximum(number.astype(np.int64) - KNOWN, 0)
        return np.where(number < KNOWN, 1.0, (n - 1 + HALF) / (self.sums[0, bucket] - 1 + HALF * self.sums[1, bucket]))


class Words:
    """The words of a block of texts: distinct ones by their hashes, and which one stands where."""

    def __init__(self, lengths: np.ndarray, keys: np.ndarray, word: np.ndarray):
        self.lengths, self.keys, self.word = lengths, keys, word
        self.text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        #: places of words that another word of the text follows
        self.left = np.flatnonzero(self.text[:-1] == self.text[1:])

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        split = [t.split() for t in texts]
        lengths = np.array([len(x) for x in split], np.int64)
        coded = pa.array([w for x in split for w in x], pa.large_string()).dictionary_encode()
        del split
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
        keys, at = np.unique(hashes, return_inverse=True)
        return cls(lengths, keys, at[coded.indices.to_numpy()].astype(np.int32) if len(hashes) else np.zeros(0, np.int32))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of neighbours by their hashes, which one stands at each place of left, and their numbers here."""
        a, b = self.keys[self.word[self.left]], self.keys[self.word[self.left + 1]]
        mixed = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ b >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.unique(mixed ^ mixed >> np.uint64(29), return_inverse=True, return_counts=True)

    def counts(self) -> np.ndarray:
        """Of each distinct word: occurrences, those before another word, those behind one."""
        return np.stack([np.bincount(self.word[at], minlength=len(self.keys)) for at in (slice(None), self.left, self.left + 1)], axis=1)

    def windows(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """(neighbours' numbers, number) of each word."""
        numbers = vocabulary.of(self.keys)[self.word]
        n = len(numbers)
        around = np.full((n, 2 * SPAN), EDGE, np.int16)
        for k, d in enumerate([*range(-SPAN, 0), *range(1, SPAN + 1)]):
            lo, hi = max(0, -d), min(n, n - d)
            if hi > lo:
                same = self.text[lo:hi] == self.text[lo + d : hi + d]
                around[lo:hi, k] = np.where(same, numbers[lo + d : hi + d], EDGE)
        return around, numbers


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte: the leading zeros stand together and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """The number of counts, a byte each, then those that need more than a byte in full."""
    flat = counts.ravel()
    return np.int64(len(flat)).tobytes() + np.minimum(flat, 255).astype(np.uint8).tobytes() + flat[flat >= 255].astype(np.int64).tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, offset=8 + n)
    return out


def packed_places(word: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte as the keys are."""
    return word.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def packed_rows(ids: pa.Array, lengths: np.ndarray) -> bytes:
    batch = pa.record_batch([ids, pa.array(lengths)], ["id", "length"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def block_of(rows: bytes, keys: bytes, words: bytes) -> tuple[pa.Array, Words]:
    """(ids, words) of a block."""
    t = pa.ipc.open_stream(zstandard.decompress(rows)).read_all()
    return t.column("id").combine_chunks(), Words(t.column("length").to_numpy(), unpacked_keys(zstandard.decompress(keys)), unpacked_places(zstandard.decompress(words)))


def mixed(words: Words, log_number: np.ndarray, share: np.ndarray, totals: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log P(word | neighbours) of each word of a block, from the corpus without the occurrence that is scored.

    log_number: log P(number | neighbours) by the network; share: each word's share of its number; totals: counts of the
    block's distinct words over the corpus; pairs: that of the pair at each place of words.left. Both together are a distribution q over all words. Of n other
    words seen beside a neighbour, c of them this word, its probability is (c + a q) / (n + a), a = n ** 0.75 (at
    least 1): words seen beside another grow by about that power. Both sides count alike; at an end of the text, q stands for its side.
    """
    q = np.exp(log_number) * share
    both = np.zeros(len(q))
    c = pairs - 1.0
    for at, neighbour, column in ((words.left + 1, words.left, 1), (words.left, words.left + 1, 2)):
        n = totals[words.word[neighbour], column] - 1.0
        a = np.maximum(1.0, n**0.75)
        side = q.copy()
        side[at] = (c + a * q[at]) / (n + a)
        both += side / 2
    return np.log(both)


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, n_bytes, rows, keys, words): rows (id, text) dealt by a hash of both, in its order, about BLOCK bytes of text to a block, split into words once."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names, types = ["block", "n_bytes", "rows", "keys", "words"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, number = TaskContext.get().partitionId(), [], 0, 0

        def give() -> pa.RecordBatch:
            one = pa.Table.from_batches(held)
            own = Words.of(one.column(1).to_pylist())
            data = [zstandard.compress(x, 1) for x in (packed_rows(one.column(0).combine_chunks(), own.lengths), packed_keys(own.keys), packed_places(own.word))]
            return pa.record_batch([pa.array([v], t) for v, t in zip((task << 32 | number, n, *data), types, strict=True)], names)

        for piece in slices(batches, "text", BLOCK):
            size = piece.column(1).nbytes
            if held and n + size > 1.5 * BLOCK:
                yield give()
                held, n, number = [], 0, number + 1
            held.append(piece)
            n += size
        if held:
            yield give()

    dealt = rows.withColumn("h", F.xxhash64("id", "text")).repartition(min(TASKS, max(1, total // BLOCK)), "h").sortWithinPartitions("h", "id", "text")
    return saved(dealt.select("id", "text").mapInArrow(run, "block long, n_bytes long, rows binary, keys binary, words binary"), "blocks")


def asked(blocks: DataFrame, n_ranges: int) -> DataFrame:
    """(block, kind, part, keys, counts): distinct words (kind 0) and pairs (1) of each block with its counts, by range of hashes."""
    edges = np.array([(i << 64) // n_ranges for i in range(1, n_ranges)], np.uint64)

    names, types = ["block", "kind", "part", "keys", "counts"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = block_of(*data)[1]
                pair_keys, _, pair_counts = words.pairs()
                for kind, keys, counts in ((0, words.keys, words.counts()), (1, pair_keys, pair_counts)):
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    rows = [(block, kind, i, packed_keys(keys[a:b]), packed_counts(counts[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                    if rows:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                del words, pair_keys, pair_counts, keys, counts, rows

    return blocks.mapInArrow(run, "block long, kind int, part int, keys binary, counts binary")


def answered(asked: DataFrame, n_ranges: int) -> DataFrame:
    """(block, kind, part, totals, hashes): the same keys' counts over all blocks.

    For each range there are also its KNOWN most frequent words (kind 2: occurrences and hashes) and what it has of each
    bucket (kind 3: occurrences, then distinct words).
    """
    names, types = ["block", "kind", "part", "totals", "hashes"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    row = lambda *values: pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for block, kind, part, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault((part, kind), []).append((block, keys, counts))
        while rows:
            (part, kind), found = rows.popitem()
            found = [(block, unpacked_keys(keys), unpacked_counts(counts)) for block, keys, counts in found]
            width = 1 if kind else 3
            every, at = np.unique(np.concatenate([x[1] for x in found]), return_inverse=True)
            counts = np.concatenate([x[2] for x in found]).reshape(-1, width)
            totals = np.stack([np.bincount(at, counts[:, i]).astype(np.int64) for i in range(width)], axis=1)
            start = 0
            for block, keys, _ in found:
                own = totals[at[start : start + len(keys)]]
                start += len(keys)
                yield row(block, kind, part, packed_counts(own), None)
            if kind == 0:
                top = np.lexsort((every, -totals[:, 0]))[:KNOWN]
                yield row(-1, 2, part, totals[top, 0].tobytes(), every[top].tobytes())
                bucket = (every % np.uint64(OTHERS)).astype(np.int64)
                sums = np.concatenate([np.bincount(bucket, totals[:, 0], OTHERS), np.bincount(bucket, minlength=OTHERS)])
                yield row(-1, 3, part, sums.astype(np.float64).tobytes(), None)

    return asked.repartitionById(n_ranges, "part").mapInArrow(run, "block long, kind int, part int, totals binary, hashes binary")


def count(blocks: DataFrame) -> DataFrame:
    """What answered gives, written: totals of all words and pairs over the whole corpus."""
    n_ranges = max(4, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // RANGE))
    return saved(answered(asked(blocks.select("block", "rows", "keys", "words"), n_ranges), n_ranges), "answers")


def vocabulary_of(answers: DataFrame) -> Vocabulary:
    """The KNOWN most frequent words of the corpus, ties by their hashes, and the buckets of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, h in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(h.as_buffer(), np.int64)), pa.array(np.frombuffer(n.as_buffer(), np.int64))], ["h", "n"])

    words = answers.where("kind = 2").select("totals", "hashes").mapInArrow(run, "h long, n long")
    top = words.orderBy(F.desc("n"), F.col("h").bitwiseXOR(F.lit(-(1 << 63)))).limit(KNOWN).collect()
    sums = tree_sum(answers.where("kind = 3").select(F.col("part").cast("long").alias("part"), F.col("totals").alias("x")))
    return Vocabulary([(r["h"] % (1 << 64), r["n"]) for r in top], np.zeros((2, OTHERS)) if sums is None else sums.reshape(2, OTHERS))


def train(blocks: DataFrame, vocabulary: Vocabulary, rounds: int = 1) -> np.ndarray:
    """The averaged parameters (a fixed number of floats). The starting network where there are no words."""
    sc = blocks.sparkSession.sparkContext
    flat = Network.start().flat
    words = sc.broadcast(vocabulary)  # fixed size, as the parameters are
    for _ in range(rounds):
        shared = sc.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(SIZE + 1)
            for batch in batches:
                for data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    around, word = block_of(*data)[1].windows(words.value)
                    net, sums = Network(shared.value.copy()), Network(np.zeros(SIZE, np.float32))
                    for at in range(0, len(word), BATCH):
                        net.step(around[at : at + BATCH], word[at : at + BATCH], sums)
                    total[:SIZE] += net.flat.astype(np.float64) * len(word)
                    total[SIZE] += len(word)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "x"])

        total = tree_sum(blocks.select("rows", "keys", "words").mapInArrow(run, "part long, x binary"))
        if total is not None and total[SIZE]:
            flat = (total[:SIZE] / total[SIZE]).astype(np.float32)
    return flat


def score(blocks: DataFrame, answers: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, n_words, log_probability, mean_log_probability); no words: 0 words, a sum of 0 and a null mean."""
    sc = blocks.sparkSession.sparkContext
    words, shared = sc.broadcast(vocabulary), sc.broadcast(flat)
    names = [key, "n_words", "log_probability", "mean_log_probability"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        got: tuple[list, list] = ([], [])
        for batch in batches:
            for at in range(batch.num_rows):
                kind = batch.column(1)[at].as_py()
                if kind < 2:
                    got[kind].append(unpacked_counts(batch.column(3)[at].as_py()))
                    continue
                ids, own = block_of(*(batch.column(k)[at].as_py() for k in (4, 5, 6)))
                around, number = own.windows(words.value)
                each = [net.log_probability(around[i : i + BATCH], number[i : i + BATCH]).astype(np.float64) for i in range(0, len(number), BATCH)]
                of_word, of_pair = (np.concatenate([np.zeros(0, np.int64), *x]) for x in got)
                of_word, of_pair = of_word.reshape(-1, 3), of_pair.reshape(-1, 1)
                got = ([], [])
                share = words.value.share(number, of_word[own.word, 0])
                total = np.concatenate([[0.0], np.cumsum(mixed(own, np.concatenate([[], *each]), share, of_word, of_pair[own.pairs()[1], 0] if len(of_pair) else of_pair[:, 0]))])
                ends = np.cumsum(own.lengths)
                sums = total[ends] - total[ends - own.lengths]
                mean = pa.array([s / n if n else None for s, n in zip(sums.tolist(), own.lengths.tolist(), strict=True)], pa.float64())
                yield pa.record_batch([ids, pa.array(own.lengths), pa.array(sums), mean], names)

    none = F.lit(None).cast("binary")
    rows = answers.where("kind < 2").select("block", "kind", "part", "totals", none.alias("rows"), none.alias("keys"), none.alias("words"))
    rows = rows.unionByName(blocks.select("block", F.lit(2).alias("kind"), F.lit(0).alias("part"), none.alias("totals"), "rows", "keys", "words"))
    dealt = rows.repartition(min(TASKS, max(8, blocks.select("block").count())), "block").sortWithinPartitions("block", "kind", "part")
    return dealt.mapInArrow(run, f"{key} long, n_words long, log_probability double, mean_log_probability double")


def score_corpus(docs: DataFrame, rounds: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, trains and scores over all rows: (key, n_words, log_probability, mean_log_probability).

    Null texts count as empty ones and score 0; null keys, repeated rows and ties are rows of their own; very long texts are
    scored whole; other columns are not read, whatever their names. An empty table gives no rows. The scores of a table
    do not depend on its partitions.
    """
    dealt = blocks(docs, key, text)
    answers = count(dealt)
    vocabulary = vocabulary_of(answers)
    return score(dealt, answers, vocabulary, train(dealt, vocabulary, rounds), key)


def op2_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))
