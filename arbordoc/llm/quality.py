"""Document quality by a factorisation machine.

Features are hashed words, statistics of a text's structure and its declared length. The machine adds to a
linear score the interactions of all pairs of features, of low rank: the factor vectors' pairwise products, summed
in linear time as half of (square of the sum minus sum of the squares).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table, text_of

WORDS = 1 << 13
STRUCTURE = 20
RANK, EPOCHS, BATCH, RATE, DECAY = 8, 6, 64, 0.03, 1e-4
#: Labelled rows to learn from at most: those with the smallest hash of their key.
MOST_LABELLED = 8_000

_LETTER = np.array([bytes([b]).isalpha() or b >= 0x80 for b in range(256)])
_SIGN = np.array([0x21 <= b < 0x7F and not bytes([b]).isalnum() for b in range(256)])


class Features:
    """A text's features: indices and values; word buckets are kept for the words seen last."""

    def __init__(self) -> None:
        self.buckets: dict[str, int] = {}

    def of(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.buckets) > 300_000:
            self.buckets = {}
        words = text.lower().split()
        count: Counter[int] = Counter()
        buckets = self.buckets
        for w, n in Counter(words).items():
            if (b := buckets.get(w)) is None:
                b = buckets[w] = zlib.crc32(w.encode()) % WORDS
            count[b] += n
        index = np.fromiter(count, np.int32, len(count))
        value = np.log1p(np.fromiter(count.values(), np.float32, len(count)))
        norm = float(np.sqrt((value**2).sum()))
        structure = self.structure(text, words, n_chars)
        return np.concatenate([index, np.arange(WORDS, WORDS + STRUCTURE, dtype=np.int32)]), np.concatenate([value / norm if norm else value, structure])

    @staticmethod
    def structure(text: str, words: list[str], n_chars: int | None) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        byte = np.bincount(data, minlength=256)
        n, n_words = max(1, len(data)), max(1, len(words))
        lines = [x for x in text.split("\n") if x.strip()]
        n_lines = max(1, len(lines))
        lengths = np.fromiter(map(len, words), np.float64, len(words))
        signs = byte * _SIGN
        return np.array(
            [
                np.log1p(len(text)),
                np.log1p(len(words)),
                np.log1p(len(lines)),
                len(set(words)) / n_words,
                len(set(lines)) / n_lines,
                lengths.mean() if len(words) else 0,
                lengths.std() if len(words) else 0,
                byte[_LETTER].sum() / n,
                byte[48:58].sum() / n,
                byte[65:91].sum() / n,
                byte[128:].sum() / n,
                signs.sum() / n,
                signs.max() / n,
                (byte[46] + byte[44]) / n,
                (byte[33] + byte[63] + byte[58] + byte[59]) / n,
                sum(x[-1:] in ".!?" for x in lines) / n_lines,
                np.log1p(len(words) / n_lines),
                sum(len(w) == 1 for w in words) / n_words,
                np.log1p(max(0, n_chars if n_chars is not None else len(text))),
                float(n_chars is not None and n_chars != len(text)),
            ],
            np.float32,
        )


@dataclass
class Machine:
    """Weights for standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def prepared(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = value.copy()
        out[-STRUCTURE:] = np.clip((value[-STRUCTURE:] - self.mean) / self.scale, -4, 4) / 4
        return out

    def margin(self, index: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[index] * x[:, None]
        total = v.sum(0)
        return self.bias + float(self.linear[index] @ x) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(index, self.prepared(index, value)), -30, 30))))


def untrained() -> Machine:
    n = WORDS + STRUCTURE
    return Machine(np.zeros(STRUCTURE, np.float32), np.ones(STRUCTURE, np.float32), 0.0, np.zeros(n, np.float32), np.zeros((n, RANK), np.float32))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, deterministic for the same rows in the same order. No rows: every score is 0.5."""
    model = untrained()
    if not rows:
        return model
    dense = np.array([value[-STRUCTURE:] for _, value, _ in rows])
    model.mean, model.scale = dense.mean(0), dense.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    model.factors = rng.normal(0, 0.02, model.factors.shape).astype(np.float32)
    index = [i for i, _, _ in rows]
    value = [model.prepared(i, v) for i, v, _ in rows]
    y = np.array([q for _, _, q in rows], np.float32)
    rate = min(max(float(y.mean()), 0.02), 0.98)
    model.bias = float(np.log(rate / (1 - rate)))
    bias_sum, linear_sum, factors_sum = 1e-6, np.full(len(model.linear), 1e-6, np.float32), np.full(model.factors.shape, 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            flat, x = np.concatenate([index[i] for i in batch]), np.concatenate([value[i] for i in batch])
            starts = np.cumsum([0, *(len(index[i]) for i in batch[:-1])])
            row = np.repeat(np.arange(len(batch)), [len(index[i]) for i in batch])
            v = model.factors[flat]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, starts)
            margin = model.bias + np.add.reduceat(model.linear[flat] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]) / len(batch)
            used, where = np.unique(flat, return_inverse=True)
            gx = g[row] * x
            gl = np.bincount(where, gx, len(used)).astype(np.float32) + DECAY * model.linear[used]
            each = gx[:, None] * (total[row] - vx)
            gf = np.stack([np.bincount(where, each[:, j], len(used)) for j in range(RANK)], axis=1).astype(np.float32) + DECAY * model.factors[used]
            linear_sum[used] += gl**2
            factors_sum[used] += gf**2
            model.linear[used] -= RATE * 3 * gl / np.sqrt(linear_sum[used])
            model.factors[used] -= RATE * gf / np.sqrt(factors_sum[used])
            bias_sum += float(g.sum()) ** 2
            model.bias -= RATE * float(g.sum()) / bias_sum**0.5
    return model


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, key: str = "doc_id", label: str = "quality") -> Machine:
    """The machine for labelled rows that are not held out: `most` of them at most, those with the smallest hash of their key.

    Rows whose label is neither 0 nor 1 are left out; a key labelled twice counts with its smaller label, one that
    several documents have with the least of their texts. No label or no document: the machine that scores 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("k")).agg(F.min(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(most)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.struct(text_of().alias("text"), F.col("n_chars").cast("long").alias("n")).alias("row"))
    rows = rows.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("row").alias("row"), F.min("y").alias("y"))

    def make():
        features = Features()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [features.of(t, n) for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            return pa.record_batch([batch.column(0), batch.column(3), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], ["k", "y", "i", "v"])

        return work

    got = map_texts(rows.select("k", "row.text", "row.n", "y"), "text", make, "k long, y int, i binary, v binary").collect()  # `most` rows at most, one a key
    got.sort(key=lambda r: r["k"])
    return train([(np.frombuffer(r["i"], np.int32), np.frombuffer(r["v"], np.float32), r["y"]) for r in got])


def _scored(docs: DataFrame, model: Machine, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """finish(rows, scores) over all of docs; columns are found by their place, so that no name clashes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size
    text, n_chars = docs.columns.index("text"), docs.columns.index("n_chars")

    def make():
        features, machine = Features(), shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(batch.column(text).to_pylist(), batch.column(n_chars).to_pylist(), strict=True)
            return finish(batch, np.array([machine.score(*features.of(t or "", n)) for t, n in rows]))

        return work

    return map_texts(docs, "text", make, schema)


def keep_good(docs: DataFrame, model: Machine, least: float = 0.5) -> DataFrame:
    """The rows of docs that score `least` or more, with all their columns, whatever the names.

    Null and empty texts are scored by their structure and declared length, repeated rows alike.
    """
    return _scored(docs, model, lambda rows, scores: rows.filter(pa.array(scores >= least)), docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of each row of docs.

    A null key is never held out; repeated rows score alike; null and empty texts are scored by their structure, very
    long ones whole. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    finish = lambda batch, scores: pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])
    scored = _scored(rows, fit(docs, labels, most, key), finish, f"{key} long, score double")
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
