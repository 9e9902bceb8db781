"""The subpackage's queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, masked_lm, packing, quality, secret_scan, sentence_pieces, simhash, suffixes, topk, vector_copies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_masked_lm": masked_lm.op2_masked_lm,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op10_vector_copies": vector_copies.op10_vector_copies,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_warc": archives.op6_warc,
    "op7_simhash": simhash.op7_simhash,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_sentencepiece": sentence_pieces.op9_sentencepiece,
}

SQL: dict[str, str] = {
    "op5_exact_topk": topk.SQL,
    "op6_warc": archives.SQL,
    "op10_vector_copies": vector_copies.SQL,
}
