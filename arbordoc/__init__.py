"""Typed tree documents on Spark: parse, type, validate, query, encode and edit corpora."""
