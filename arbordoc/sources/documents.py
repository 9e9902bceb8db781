"""Tree documents as DataFrames: sources in, tables of documents, blocks, compounds, elements and errors out.

A source is one row of text or bytes; it is parsed where it lies, a row is the unit of parallelism, and no table here
needs a shuffle; a table that lies in fewer pieces than there are cores is dealt anew before its rows are read. Each function emits one table only, so a header costs no compound rows. Every row has explicit ordinals.
"""

from __future__ import annotations

from collections.abc import Callable, Container, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.hashes import blake3_many
from ..functions.registry import BUILT_IN_VALIDATORS, Codecs, Validator
from ..operators.assign import Assigner, walk
from ..operators.binary import BinaryError, decode_document, encode_root
from ..operators.canonical import canonical_text
from ..operators.edits import construct as edit_construct
from ..operators.reports import expand_last_atom, inline_first_child, model_of
from ..plans.paths import resolve
from ..plans.schema import Schema
from .parser import MESSAGES, Block, Document, Error, decode_bytes, parse, parse_stream, write
from .storage import spread

KEY = "source_id string, doc_ord int"
DOCUMENTS = KEY + ", directive string, ver_major int, ver_minor int, reference string, layers array<string>, signature string, sigil string, line_endings string"
BLOCKS = KEY + ", parent_id int, block_ix int, comments array<string>, tabulation struct<offsets:array<int>,headings:array<string>>, trailing_blank_lines int"
COMPOUNDS = KEY + ", node_id int, parent_id int, depth int, block_ix int, compound_ix int, keyword string, remark string, atoms array<struct<form:string,text:string,preceding_spaces:int,delimiter:string>>"
ELEMENTS = KEY + ", elem_id int, parent_id int, depth int, sib_ord int, source_ord int, member_ix int, keyword_ix int, keyword string, kind string, type_name string, parent_type string, text string, origin string, key_value string"
ERRORS = KEY + ", code string, span_start int, span_end int, message string"
BINARY = KEY + ", data binary, failure string"
PATHS = KEY + ", name string, status string, failed_component int, occurrence int, kind string, text string, key_value string"


def sources(df: DataFrame, text: str = "text", key: str = "source_id") -> DataFrame:
    """(source_id, text) of any table."""
    return df.select(F.col(key).cast("string").alias("source_id"), F.col(text).alias("text"))


def read_sources(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source_id, text binary) of the files below a path; bytes are repaired while they are parsed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source_id"), F.col("content").alias("text"))


def _documents(text: str | bytes | None, admits, single: bool) -> Iterator[tuple[int, Document, list[Error]]]:
    extra: list[Error] = []
    if isinstance(text, bytes):
        text, extra = decode_bytes(text)
    if text is None:
        return
    if single:
        yield 0, parse(text, admits), extra
        return
    for i, d in enumerate(parse_stream(text, admits)):
        yield i, d, extra if i == 0 else []


def _map(df: DataFrame, ddl: str, rows: Callable[[str, int, Document, list[Error]], Iterator[tuple]], schema: Schema | None = None, single: bool = False, then: tuple[Callable, T.StructType] | None = None) -> DataFrame:
    """then: what becomes of the batches in the same worker, and its type."""
    kind = T._parse_datatype_string(ddl)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        admits = schema.admits if schema else None
        for batch in batches:
            for part in parts(batch):
                out: list[tuple] = []
                for sid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, doc, extra in _documents(text, admits, single):
                        out += ((sid, i, *r) for r in rows(sid, i, doc, extra))
                    if len(out) > 20_000:
                        yield _batch(out, arrow)
                        out = []
                if out:
                    yield _batch(out, arrow)

    df = spread(df.select("source_id", "text"))
    return df.mapInArrow(lambda batches: then[0](run(batches)), then[1]) if then else df.mapInArrow(run, kind)


#: Bytes of a batch that are Python objects at a time; a single longer row goes alone.
PART = 2 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows that they have PART bytes on average."""
    step = max(1, batch.num_rows * PART // max(PART, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def documents(df: DataFrame, single: bool = False) -> DataFrame:
    """A row for each document of each source, in order; single: the first only, whatever follows its separator."""

    def rows(_, __, d: Document, ___):
        p = d.pragma
        v = p.version if p and p.version else (None, None)
        yield d.directive, *v, p and p.reference, p.layers if p else [], p and p.signature, d.sigil, d.line_endings

    return _map(df, DOCUMENTS, rows, single=single)


def _nodes(d: Document):
    """(compound, id, parent id, depth, block, place) of a document, parents first."""
    work, n = [(d.root, 0, 0, 0, 0)], 0
    while work:
        c, parent, depth, block, place = work.pop()
        yield c, n, parent, depth, block, place
        for b in range(len(c.blocks) - 1, -1, -1):
            own = c.blocks[b].compounds
            work += [(own[k], n, depth + 1, b, k) for k in range(len(own) - 1, -1, -1)]
        n += 1


def compounds(df: DataFrame, single: bool = False) -> DataFrame:
    def rows(_, __, d: Document, ___):
        for c, n, parent, depth, block, place in _nodes(d):
            if n:
                yield n, parent, depth - 1, block, place, c.keyword, c.remark, [{"form": a.form, "text": a.text, "preceding_spaces": a.spaces if a.form == "inline" else None, "delimiter": a.delimiter} for a in c.atoms]

    return _map(df, COMPOUNDS, rows, single=single)


def blocks(df: DataFrame, single: bool = False) -> DataFrame:
    def rows(_, __, d: Document, ___):
        for c, n, *_ in _nodes(d):
            for i, b in enumerate(c.blocks):
                yield n, i, b.comments, {"offsets": b.offsets, "headings": b.headings} if b.offsets else None, b.blanks

    return _map(df, BLOCKS, rows, single=single)


def parse_errors(df: DataFrame, single: bool = False) -> DataFrame:
    def rows(_, __, d: Document, extra: list[Error]):
        for e in sorted([*extra, *d.errors], key=lambda e: (e.start, e.end, e.code)):
            yield e.code, e.start, e.end, MESSAGES.get(e.code)

    return _map(df, ERRORS, rows, single=single)


def elements(df: DataFrame, schema: Schema, kinds: Container[str] | None = None) -> DataFrame:
    """The semantic elements of every document under a composed schema, in canonical order; a document's root is element 0.

    Compounds whose keyword their parent does not have appear with kind unknown and without a member. kinds: those that are
    wanted alone, numbered as among all.
    """

    if kinds is None:
        return _map(df, ELEMENTS, lambda _, __, d, ___: element_rows(d, schema), schema)
    return _map(df, ELEMENTS, lambda _, __, d, ___: (r for r in element_rows(d, schema) if r[KIND] in kinds), schema)


def struct_views(df: DataFrame, schema: Schema, type_name: str) -> DataFrame:
    """(source_id, doc_ord, elem_id, fields map<keyword, text>), as checks.struct_views, made where documents are typed."""

    def rows(_, __, d: Document, ___):
        for e, n, *_ in walk(Assigner(schema, None).assign(d)):
            if e.kind == "struct" and e.type == type_name:
                fields: dict[str, str] = {}
                for c in e.children:
                    if c.kind in ("scalar", "flag"):
                        fields.setdefault(c.keyword, c.text or "")
                if fields:
                    yield n, list(fields.items())

    return _map(df, KEY + ", elem_id int, fields map<string,string>", rows, schema)


#: The place of an element's kind in a row of element_rows.
KIND = 8


def element_rows(d: Document, schema: Schema) -> Iterator[tuple]:
    """A document's element rows without its key."""
    a = Assigner(schema, None)
    types = {}
    for e, n, parent, depth, order in walk(a.assign(d)):
        types[n] = e.type
        yield n, parent if n else None, depth, order, e.source_ord, e.member_ix, e.keyword_ix, e.keyword, e.kind, e.type, types.get(parent) if n else None, e.text, e.origin, a.key_of(e)


def paths(df: DataFrame, schema: Schema, wanted: Mapping[str, str]) -> DataFrame:
    """(source_id, doc_ord, name, status, failed_component, occurrence, kind, text, key_value) of several named paths, in one pass over the sources.

    A path that ends at a repeatable keyword has a row per occurrence, and one without occurrence where there is none.
    """

    def rows(_, __, d: Document, ___):
        a = Assigner(schema, None)
        root = a.assign(d)
        for name, path in wanted.items():
            found = resolve(path, schema, root)
            open_end = found.status == "occurrences"
            for i, e in enumerate(found.elements):
                yield name, found.status, None, i if open_end else None, e.kind, e.text, a.key_of(e)
            if not found.elements:
                yield name, found.status, found.component, None, None, None, None

    return _map(df, PATHS, rows, schema)


def rewritten(df: DataFrame, schema: Schema, change: str) -> DataFrame:
    """(source_id, doc_ord, changes, text): every compound's expand or inline refactor that keeps the model, applied in order; or construct, the document made anew from its elements."""

    def rows(_, __, d: Document, ___):
        n = 0
        if change == "construct":
            made = Document(pragma=d.pragma, sigil=d.sigil)
            made.root.blocks = [Block(compounds=[edit_construct(e, schema, d.sigil) for e in Assigner(schema, None).assign(d).children if e.origin != "default"])]
            yield 1, write(made)
            return
        offer = {"expand": expand_last_atom, "inline": inline_first_child}[change]
        seen, model = 0, model_of(write(d), schema)  # every change keeps the model
        while model is not None:
            every = [c for c, k, *_ in _nodes(d) if k]
            if seen >= len(every):
                break
            new = offer(d, every[seen], schema, model)
            if new is None:
                seen += 1
            else:
                d, n = new, n + 1
        yield n, write(d)

    return _map(df, KEY + ", changes int, text string", rows, schema)


def errors(df: DataFrame, schema: Schema, validators: Mapping[str, Validator] | None = BUILT_IN_VALIDATORS, codecs: Mapping | None = None) -> DataFrame:
    """Parsing and validation errors of every document, by document and span."""

    def rows(_, __, d: Document, extra: list[Error]):
        a = Assigner(schema, validators, Codecs(codecs) if codecs is not None else None)
        a.assign(d)
        for e in sorted([*extra, *d.errors, *a.errors], key=lambda e: (e.start, e.end, e.code)):
            yield e.code, e.start, e.end, MESSAGES.get(e.code)

    return _map(df, ERRORS, rows, schema)


def encode_documents(df: DataFrame, schema: Schema, codecs: Mapping | None = None) -> DataFrame:
    """The root encoding of every document that has one; failure says why another has none."""
    return _map(df, BINARY, _encoder(schema, codecs), schema)


def _encoder(schema: Schema, codecs: Mapping | None) -> Callable[[str, int, Document, list[Error]], Iterator[tuple]]:
    def rows(_, __, d: Document, ___):
        a = Assigner(schema, None)
        try:
            root = a.assign(d)
            yield (None, min(e.code for e in (*d.errors, *a.errors))) if a.errors or d.errors else (encode_root(root, schema, Codecs(codecs or {})), None)
        except ValueError as e:
            yield None, str(e)

    return rows


def hash_documents(df: DataFrame, schema: Schema, codecs: Mapping | None = None) -> DataFrame:
    """(source_id, doc_ord, hash, failure): the BLAKE3 hash of each root encoding, made where it is encoded."""
    kind = T._parse_datatype_string(KEY + ", hash binary, failure string")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                data = part.column(2)
                have = [i for i, v in enumerate(data) if v.is_valid]
                found: list[bytes | None] = [None] * part.num_rows
                for i, h in zip(have, blake3_many([data[i].as_py() for i in have]), strict=True):
                    found[i] = h
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.binary()), part.column(3)], schema=arrow)

    return _map(df, BINARY, _encoder(schema, codecs), schema, then=(run, kind))


def decode_documents(df: DataFrame, schema: Schema | None, codecs: Mapping | None = None, data: str = "data", key: str = "source_id") -> DataFrame:
    """Elements of whole binary documents of either mode, or one row with the failure's code in keyword and kind failure."""
    kind = T._parse_datatype_string(ELEMENTS)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for sid, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    root, _, composed = decode_document(value or b"", schema, Codecs(codecs or {}))
                except BinaryError as e:
                    out.append((sid, 0, 0, None, 0, 0, 0, None, None, e.code, "failure", None, None, None, None, None))
                    continue
                a, types = Assigner(composed, None), {}
                for e, n, parent, depth, order in walk(root):
                    types[n] = e.type
                    out.append((sid, 0, n, parent if n else None, depth, order, e.source_ord, e.member_ix, e.keyword_ix, e.keyword, e.kind, e.type, types.get(parent) if n else None, e.text, "compound", a.key_of(e)))
            if out:
                yield _batch(out, arrow)

    return spread(df.select(F.col(key).cast("string").alias("source_id"), F.col(data).alias("data"))).mapInArrow(run, kind)


def canonical_sources(df: DataFrame, schema: Schema, signature: bytes | None = None) -> DataFrame:
    """(source_id, doc_ord, text): canonical text in one pass over the sources."""

    def rows(_, __, d: Document, ___):
        yield (canonical_text(Assigner(schema, None).assign(d), signature),)

    return _map(df, KEY + ", text string", rows, schema)


def register_udtfs(spark: SparkSession) -> None:
    """SQL table functions parse_documents(text) and parse_compounds(text), for LATERAL joins."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="doc_ord int, directive string, reference string, layers array<string>, signature string, sigil string")
    class ParseDocuments:
        def eval(self, text: str):
            for i, d, _ in _documents(text, None, False):
                p = d.pragma
                yield i, d.directive, p and p.reference, p.layers if p else [], p and p.signature, d.sigil

    @udtf(returnType="doc_ord int, node_id int, parent_id int, depth int, keyword string, atoms array<string>")
    class ParseCompounds:
        def eval(self, text: str):
            for i, d, _ in _documents(text, None, False):
                for c, n, parent, depth, _, _ in _nodes(d):
                    if n:
                        yield i, n, parent, depth - 1, c.keyword, [a.text for a in c.atoms]

    spark.udtf.register("parse_documents", ParseDocuments)
    spark.udtf.register("parse_compounds", ParseCompounds)


def wide_type(schema: Schema, name: str = "", above: tuple[str, ...] = ()) -> T.StructType:
    """The typed form of a struct: members in order; arrays where repeatable, nulls where absent. ValueError for cycles."""
    if name in above:
        raise ValueError(f"{name} contains itself; use the elements table")
    fields = []
    for m in schema.struct(name).members:
        if m.kind == "select":
            inner = [("tag", T.StringType())] + [(v.keyword, _wide_leaf(schema, v.type, (*above, name))) for v in schema.select(m.type).variants]
            kind: T.DataType = T.StructType([T.StructField(k, t) for k, t in inner])
        else:
            kind = _wide_leaf(schema, m.type, (*above, name))
        fields.append(T.StructField(m.keyword or m.type, T.ArrayType(kind) if m.is_repeatable else kind))
    return T.StructType(fields)


def _wide_leaf(schema: Schema, name: str, above: tuple[str, ...]) -> T.DataType:
    kind = schema.kind(name)
    return wide_type(schema, name, above) if kind == "struct" else T.BooleanType() if kind == "flag" else T.StringType()


def _wide_value(schema: Schema, e) -> dict:
    out: dict = {}
    for i, m in enumerate(schema.struct(e.type).members):
        own = [_wide_child(schema, c) if m.kind == "field" else {"tag": c.keyword, c.keyword: _wide_child(schema, c)} for c in e.children if c.member_ix == i]
        out[m.keyword or m.type] = own if m.is_repeatable else next(iter(own), None)
    return out


def _wide_child(schema: Schema, e):
    return _wide_value(schema, e) if e.kind == "struct" else True if e.kind == "flag" else e.text


def wide(df: DataFrame, schema: Schema) -> DataFrame:
    """(source_id, doc_ord, a column per root member) for schemas without cycles: parsed and typed in one pass, no shuffle."""
    kind = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("doc_ord", T.IntegerType()), *wide_type(schema).fields])
    arrow = to_arrow_schema(kind)
    names = [f.name for f in kind.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, doc, _ in _documents(text, schema.admits, False):
                    value = _wide_value(schema, Assigner(schema, None).assign(doc))
                    out.append((sid, i, *(value[n] for n in names)))
            if out:
                yield _batch(out, arrow)

    return spread(df.select("source_id", "text")).mapInArrow(run, kind)
