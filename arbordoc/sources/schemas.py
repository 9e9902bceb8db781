"""Schema sources as rows: their faults, hashes, compositions and relations, a registry of them, and documents typed by it.

A schema source is a row (source_id, text). Each function maps rows where they lie; nothing is collected but what a caller
loads into a Resolver, which goes to the tasks as the library that documents are typed by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.utils import AnalysisException

from ..functions.letters import to_letters
from ..functions.registry import Codecs
from ..operators.assign import Assigner, Element, assign
from ..operators.binary import component_hashes, encode_document, encode_root, self_contained_head, signature
from ..operators.reports import position
from ..plans.compose import compose, in_declaration_order, is_subtype
from ..plans.patterns import NotProven, contained
from ..plans.resolve import Identifier, Resolver, Unresolved
from ..plans.schema import META, Schema, check, construct
from .documents import ELEMENTS, element_rows
from .parser import Document, Error, parse, parse_stream
from .storage import spread

FAULTS = "source_id string, code string, about string"
MEMBERS = "source_id string, type_name string, member_ix int, kind string, keyword string, member_type string, required boolean, repeatable boolean, is_key boolean, default_text string"
SCALARS = "source_id string, name string, validators array<string>, patterns array<string>, encoding string"
HASHES = "source_id string, name string, ord int, layer string, hash binary, signature string"
BINARY = "source_id string, doc_ord int, data binary, failure string"
#: Schema sources whose answers a task keeps: rows repeat few of them, and each costs milliseconds.
KEPT = 512


def per_row(df: DataFrame, columns: list[str], ddl: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """rows(*values of columns) of each row, in Arrow batches."""
    kind = T._parse_datatype_string(ddl)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(*values)]
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return spread(df.select(*columns)).mapInArrow(run, kind)


def read_schema(text: str | None) -> tuple[Element, list[Error]]:
    """The root element of a schema source and what its parsing and typing found wrong."""
    doc = parse(text or "", META.admits)
    root, errors = assign(doc, META)
    return root, sorted([*doc.errors, *errors], key=lambda e: (e.start, e.end, e.code))


def schema_faults(df: DataFrame) -> DataFrame:
    """(source_id, code, about): errors of each schema source, of its declarations and of its layers' composition."""

    def rows(sid: str, text: str | None) -> Iterator[tuple]:
        yield from ((sid, *f) for f in _faults(text))

    return per_row(df, ["source_id", "text"], FAULTS, rows)


@lru_cache(maxsize=KEPT)
def _faults(text: str | None) -> tuple[tuple[str, str], ...]:
    root, errors = read_schema(text)
    schema = construct(root)
    found = [(e.code, f"{e.start}") for e in errors] + [(f.code, f.about) for f in (*check(schema), *(compose(schema)[1] if schema.layers else ()))]
    return tuple(dict.fromkeys(found))


def _composed(text: str | None, layers: list[str] | None) -> Schema:
    return _composition(text, None if layers is None else tuple(layers))


@lru_cache(maxsize=KEPT)
def _composition(text: str | None, layers: tuple[str, ...] | None) -> Schema:
    return compose(construct(read_schema(text)[0]), None if layers is None else list(layers))[0]


@lru_cache(maxsize=KEPT)
def _subtype(sub: str | None, sup: str | None) -> bool:
    return is_subtype(_composed(sub, None), _composed(sup, None))


def composed_members(df: DataFrame, layers: str | None = None) -> DataFrame:
    """Members of every struct of each schema with its layers applied: all, or those an array column names. The document's own type is ''."""

    def rows(sid: str, text: str | None, picked: list[str] | None = None) -> Iterator[tuple]:
        for s in _composed(text, picked).structs():
            for i, m in enumerate(s.members):
                yield sid, s.name, i, m.kind, m.keyword, m.type, m.is_required, m.is_repeatable, m.key, m.default

    return per_row(df, ["source_id", "text", *([layers] if layers else [])], MEMBERS, rows)


def composed_scalars(df: DataFrame, layers: str | None = None) -> DataFrame:
    def rows(sid: str, text: str | None, picked: list[str] | None = None) -> Iterator[tuple]:
        yield from ((sid, s.name, list(s.validators), list(s.patterns), s.encoding) for s in _composed(text, picked).scalars)

    return per_row(df, ["source_id", "text", *([layers] if layers else [])], SCALARS, rows)


def schema_hashes(df: DataFrame) -> DataFrame:
    """A row for the base (ord 0, no layer) and each layer of a schema: its hash, and the signature of the whole in letters."""

    def rows(sid: str, text: str | None) -> Iterator[tuple]:
        root, _ = read_schema(text)
        s, sign = construct(root), to_letters(signature(root))
        for i, h in enumerate(component_hashes(root)):
            yield sid, s.name, i, s.layers[i - 1].name if i else None, h, sign

    return per_row(df, ["source_id", "text"], HASHES, rows)


def subtypes(df: DataFrame, sub: str = "sub", sup: str = "sup") -> DataFrame:
    """(source_id, is_subtype) for two schema sources a row, composed."""
    return per_row(df, ["source_id", sub, sup], "source_id string, is_subtype boolean", lambda sid, a, b: iter([(sid, _subtype(a, b))]))


def patterns_contained(df: DataFrame, narrow: str = "narrow", wide: str = "wide") -> DataFrame:
    """(source_id, is_contained): whether all that one pattern matches another one does; null where that cannot be told."""

    def rows(sid: str, a: str, b: str) -> Iterator[tuple]:
        try:
            yield sid, contained([a], b)
        except (NotProven, ValueError):
            yield sid, None

    return per_row(df, ["source_id", narrow, wide], "source_id string, is_contained boolean", rows)


def positions(df: DataFrame, schema: Schema, offset: str = "offset") -> DataFrame:
    """(source_id, ranges, keywords, highlights, completions, description, definition) at an offset of each row's text; see reports.position."""
    ddl = "source_id string, ranges array<int>, keywords array<string>, highlights array<int>, completions array<string>, description string, definition int"
    return per_row(df, ["source_id", "text", offset], ddl, lambda sid, text, at: iter([(sid, *position(text or "", at or 0, schema))]))


def layers_in_order(df: DataFrame, schema: Schema, layers: str = "layers") -> DataFrame:
    """(source_id, in_order): whether each row's layer selection follows the schema's declarations (E124 where not)."""
    return per_row(df, ["source_id", layers], "source_id string, in_order boolean", lambda sid, picked: iter([(sid, in_declaration_order(schema, picked or []))]))


def add_schemas(df: DataFrame, path: str) -> None:
    """Adds schema sources (text) to a registry, a Parquet table, unless their text is there already."""
    new = df.select("text", F.sha2("text", 256).alias("digest")).dropDuplicates(["digest"])
    try:
        known = df.sparkSession.read.parquet(path).select("digest")
    except AnalysisException:
        known = None
    new = new if known is None else new.join(known, "digest", "left_anti")
    named = per_row(new.withColumn("source_id", F.col("digest")), ["source_id", "text"], "digest string, text string, name string", lambda digest, text: iter([(digest, text, construct(read_schema(text)[0]).name)]))
    named.write.mode("append").parquet(path)


def load_schemas(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, digest) of a registry."""
    return spark.read.parquet(path).select("name", "text", "digest")


def resolver_of(schemas: DataFrame, **more) -> Resolver:
    """A resolver with the schemas (text) of a registry as its library; sources that are no schemas are left out.

    This is the one place where rows reach the driver: the library is what a user chose to load, and goes to every task.
    """
    out = Resolver(**more)
    for r in schemas.select("text").orderBy("text").toLocalIterator():
        try:
            out.add(r["text"])
        except Unresolved:
            continue
    return out


def typed_documents(df: DataFrame, resolver: Resolver) -> DataFrame:
    """The elements of every document under the schema that its own pragma names, with resolution and the schema's name.

    A document without a schema, or whose schema is not found, has one row of kind untyped. A task resolves an identifier once.
    """
    answers: dict[Identifier, tuple[Schema | None, str]] = {}

    def rows(sid: str, text: str | None) -> Iterator[tuple]:
        for i, doc in enumerate(parse_stream(text or "")):
            wanted, schema, status = Identifier.of(doc.pragma), None, "untyped"
            if wanted is not None:
                if wanted not in answers:
                    if len(answers) >= KEPT:
                        answers.pop(next(iter(answers)))
                    try:
                        answers[wanted] = resolver.resolve(wanted), "resolved"
                    except Unresolved as e:
                        answers[wanted] = None, e.kind
                schema, status = answers[wanted]
            if schema is None:
                yield sid, i, 0, None, 0, 0, 0, None, None, None, "untyped", None, None, None, None, None, None, status
                continue
            if any(e.code == "E107" for e in doc.errors):  # indents are settled by the schema
                doc = next(d for k, d in enumerate(parse_stream(text or "", schema.admits)) if k == i)
            yield from ((sid, i, *r, schema.name, status) for r in element_rows(doc, schema))

    return per_row(df, ["source_id", "text"], ELEMENTS + ", schema_name string, resolution string", rows)


def binary_documents(df: DataFrame, schema_text: str, self_contained: bool = False, codecs: Mapping | None = None) -> DataFrame:
    """(source_id, doc_ord, data, failure): whole binary documents, signed by the schema's components, or with the schema inside."""
    root, faults = read_schema(schema_text)
    schema, more = compose(construct(root))
    if faults or more:
        raise ValueError(f"bad schema: {faults} {more}")
    head = self_contained_head(root) if self_contained else encode_document(Element("", None, None, "flag", ""), schema, signature(root))

    def rows(sid: str, text: str | None) -> Iterator[tuple]:
        for i, doc in enumerate(parse_stream(text or "", schema.admits)):
            yield sid, i, *_encoded(doc, schema, head, Codecs(codecs or {}))

    return per_row(df, ["source_id", "text"], BINARY, rows)


def _encoded(doc: Document, schema: Schema, head: bytes, codecs: Codecs) -> tuple[bytes | None, str | None]:
    a = Assigner(schema, None)
    top = a.assign(doc)
    if doc.errors or a.errors:
        return None, min(e.code for e in (*doc.errors, *a.errors))
    try:
        return head + encode_root(top, schema, codecs), None
    except ValueError as e:
        return None, str(e)


def save_binary(binary: DataFrame, path: str) -> None:
    """The documents that have a binary form, a Parquet row each."""
    binary.where("data IS NOT NULL").select("source_id", "doc_ord", "data").write.mode("append").parquet(path)
