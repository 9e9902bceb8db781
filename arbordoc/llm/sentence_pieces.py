"""Sentence-piece encoding and decoding through a table of distinct marked words.

The model marks each space with U+2581. Where no piece holds that mark behind another character, no piece
crosses from one marked word into the next, so each distinct marked word is segmented once and its ids are
joined back by position. A model for which this does not hold is refused.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_bytes, map_texts, table, text_of

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
#: Distinct words kept by a task; longer words than LONGEST are segmented each time.
KEPT, LONGEST = 200_000, 64


class WordTable:
    """word without its first mark -> (ids, those in decimal, what they decode to behind a word); begun anew at KEPT words."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        for i, piece in enumerate(pieces):
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} crosses a word mark; words cannot be segmented apart")
        self.mark_id = self.sp.piece_to_id(MARK)
        self.end = self.sp.eos_id()
        self.decimal = [str(i) for i in range(len(pieces))]
        self.seen: dict[str, tuple[list[int], str, str]] = {}

    def add(self, words: list[str]) -> dict[str, tuple[list[int], str, str]]:
        # the library puts one mark before a text: the one that words have lost here
        ids = [x if w else [self.mark_id] for w, x in zip(words, self.sp.encode([w.replace(MARK, " ") for w in words], num_threads=1), strict=True)]
        texts = self.sp.decode(ids, num_threads=1) if ids else []
        return {w: (x, " ".join([self.decimal[i] for i in x]), " " + t) for w, x, t in zip(words, ids, texts, strict=True)}

    def encode(self, texts: list[str]) -> list[list[tuple[list[int], str, str]]]:
        """The table's entries of each text's words, by position."""
        split = [words_of(t) for t in texts]
        wanted = set().union(*split)
        if len(self.seen) > KEPT:
            self.seen = {}
        seen = self.seen
        new = self.add([w for w in wanted if w not in seen])
        seen.update((w, x) for w, x in new.items() if len(w) <= LONGEST)
        new = {w: x for w, x in new.items() if len(w) > LONGEST}
        return [[seen.get(w) or new[w] for w in words] for words in split]


def words_of(text: str) -> list[str]:
    """A text's marked words, each without its first mark."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in WORDS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def encode_documents(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, decoded string) of every whole text; a null text counts as empty (the end id alone).

    model: a file that the driver reads; the tasks get its bytes. Odd rows as encode_digests says.
    """
    schema = f"{key} long, ids array<int>, decoded string"
    shared = file_bytes(docs.sparkSession, model)

    def make():
        words = WordTable(shared.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = words.encode(batch.column(1).to_pylist())
            ids = [[i for x in row for i in x[0]] + [words.end] for row in rows]
            return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(["".join(x[2] for x in row)[1:] for row in rows], pa.string())], [key, "ids", "decoded"])

        return work

    return map_texts(docs.select(F.col(key).cast("long"), text_of(text).alias("text")), "text", make, schema)


def encode_digests(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As encode_documents, with counts and digests in place of ids and texts.

    Nulls: a null text is empty, a null key stays null. Repeated rows give repeated results; very long texts are encoded
    whole; an empty table gives an empty result; other columns are not read, whatever their names.
    """
    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    shared = file_bytes(docs.sparkSession, model)

    def make():
        words = WordTable(shared.value)
        end = str(words.end)

        def digest(s: str) -> str:
            return hashlib.sha256(s.encode()).hexdigest()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = words.encode(batch.column(1).to_pylist())
            n = [sum(len(x[0]) for x in row) + 1 for row in rows]
            ids = [digest(" ".join([*(x[1] for x in row), end])) for row in rows]
            out = [digest("".join(x[2] for x in row)[1:]) for row in rows]
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_texts(docs.select(F.col(key).cast("long"), text_of(text).alias("text")), "text", make, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
