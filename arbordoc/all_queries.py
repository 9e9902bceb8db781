"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import queries, queries_schemas, queries_texts
from .query_base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "queries", "queries_schemas", "queries_texts"]
