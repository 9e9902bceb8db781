"""From a document's pragma to its composed schema: built in, cached, known components, fetched, or failed.

Resolution runs in tasks over the distinct identifiers of a corpus; the answers come back by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import HashLibrary, stack_hashes, unstack
from ..functions.letters import from_letters, to_letters
from ..operators.assign import Element, assign
from ..operators.binary import component_hashes, decode_document, encode_root, signature
from ..sources.parser import Pragma, is_signature, parse
from .compose import compose, in_declaration_order
from .schema import META, Layer, Schema, construct, without_layers


@dataclass(frozen=True)
class Identifier:
    reference: str | None = None
    layers: tuple[str, ...] = ()
    signature: str | None = None

    @classmethod
    def of(cls, pragma: Pragma | None) -> Identifier | None:
        if pragma is None or not (pragma.reference or pragma.signature):
            return None
        return cls(pragma.reference, tuple(pragma.layers), pragma.signature)

    @classmethod
    def parse(cls, phrase: str) -> Identifier:
        return cls(signature=phrase) if is_signature(phrase) else cls(reference=phrase)

    @property
    def name(self) -> str:
        """The last part of the reference, which is the name the schema declares."""
        return (self.reference or "").partition("/")[2].partition(":")[0].replace(".", "/").rsplit("/", 1)[-1]

    @property
    def selector(self) -> str | None:
        return (self.reference or "").partition(":")[2] or None


class Unresolved(LookupError):
    """kind: not-found, mismatch, unknown-layer, bad-body, undecodable or fetch-failed."""

    def __init__(self, kind: str, about: str = ""):
        super().__init__(f"{kind} {about}".strip())
        self.kind = kind


@dataclass
class Known:
    root: Element
    schema: Schema
    hashes: list[bytes]


class Resolver:
    """fetch: selector reference -> schema text or None; built_in: the references that stand for the schema of schemas."""

    def __init__(self, fetch: Callable[[str], str | None] | None = None, built_in: tuple[str, ...] = ()):
        self.fetch, self.built_in = fetch, built_in
        self.cache: dict[str, Schema] = {}
        self.known: list[Known] = []
        self.library = HashLibrary()

    def add(self, text: str) -> Known:
        """A schema source to the library. Unresolved where it is not a valid schema."""
        doc = parse(text)
        root, errors = assign(doc, META)
        if doc.errors or errors:
            raise Unresolved("bad-body", (doc.errors or errors)[0].code)
        return self.add_root(root)

    def add_binary(self, data: bytes) -> Known:
        """A schema in its binary form under the schema of schemas."""
        root, _, _ = decode_document(data, META)
        return self.add_root(root)

    def add_root(self, root: Element) -> Known:
        k = Known(root, construct(root), component_hashes(root))
        if all(k.hashes != o.hashes for o in self.known):
            self.known.append(k)
            for h in k.hashes:
                self.library.add(h)
        return k

    def meta_signature(self) -> bytes:
        from ..functions.hashes import blake3

        return stack_hashes([blake3(encode_root(self.meta_root, META))]) if self.meta_root else b""

    meta_root: Element | None = None

    def resolve(self, wanted: Identifier) -> Schema:
        if wanted.reference in self.built_in or wanted.signature and self.meta_root and from_letters(wanted.signature) == self.meta_signature():
            return META
        if wanted.signature in self.cache and not wanted.layers:  # listed layers are checked against the signature
            return self.cache[wanted.signature or ""]
        if wanted.signature:
            return self.by_signature(wanted)
        return self.by_reference(wanted)

    def identity(self, wanted: Identifier) -> str:
        """What a resolved identifier stands for: a signature's letters, or a built-in reference. Unresolved otherwise."""
        schema = self.resolve(wanted)
        if wanted.signature or schema is META:
            return wanted.signature or wanted.reference or ""
        return next(sign for sign, known in self.cache.items() if known is schema)

    def schema(self, identity: str) -> Schema:
        """The schema of an identity that this resolver, or one with the same library, gave."""
        return self.resolve(Identifier(reference=identity) if identity in self.built_in else Identifier(signature=identity))

    def by_signature(self, wanted: Identifier) -> Schema:
        stack = from_letters(wanted.signature or "")
        hashes = unstack(stack, self.library)
        if hashes is None and wanted.selector:
            self.fetched(wanted)
            hashes = unstack(stack, self.library)
        if hashes is None:
            raise Unresolved("undecodable", wanted.signature or "")
        schema, names = self.composed(hashes)
        if wanted.layers and list(wanted.layers) != names or wanted.reference and schema.name != wanted.name:
            raise Unresolved("mismatch", wanted.reference or "")
        self.cache[wanted.signature or ""] = schema
        return schema

    def composed(self, hashes: list[bytes]) -> tuple[Schema, list[str]]:
        """The base of the first hash with the layers of the others, from whichever known schema declares them."""
        base = next((k for k in self.known if k.hashes[0] == hashes[0]), None)
        layers: list[Layer] = []
        for h in hashes[1:]:
            found = next((layer for k in self.known for layer, x in zip(k.schema.layers, k.hashes[1:], strict=True) if x == h), None)
            if found is None:
                raise Unresolved("not-found", "layer")
            layers.append(found)
        if base is None:
            raise Unresolved("not-found", "base")
        schema, faults = compose(Schema(base.schema.name, base.schema.document, base.schema.records, base.schema.scalars, base.schema.selects, tuple(layers), base.schema.sigil))
        if faults:
            raise Unresolved("bad-body", faults[0].code)
        return schema, [x.name for x in layers]

    def by_reference(self, wanted: Identifier) -> Schema:
        found = next((k for k in self.known if k.schema.name == wanted.name), None)
        if found is None or wanted.selector:  # a bare reference is never fetched
            found = self.fetched(wanted) if wanted.selector else found
        if found is None:
            raise Unresolved("not-found", wanted.reference or "")
        declared = [x.name for x in found.schema.layers]
        if missing := [x for x in wanted.layers if x not in declared]:
            raise Unresolved("unknown-layer", missing[0])
        return self.selected(found, list(wanted.layers))[0]

    def fetched(self, wanted: Identifier) -> Known:
        text = self.fetch(wanted.reference or "") if self.fetch else None
        if text is None:
            raise Unresolved("fetch-failed", wanted.reference or "")
        k = self.add(text)
        if k.schema.name != wanted.name:
            raise Unresolved("mismatch", k.schema.name)
        return k

    def selected(self, known: Known, layers: list[str]) -> tuple[Schema, str, bool]:
        """(composed schema, its signature's letters, whether the layers were listed in declaration order)."""
        schema, faults = compose(known.schema, layers) if layers else (without_layers(known.schema), [])
        if faults:
            raise Unresolved("bad-body", faults[0].code)
        sign = to_letters(signature(known.root, layers))
        self.cache[sign] = schema
        return schema, sign, in_declaration_order(known.schema, layers)


def resolve_documents(documents: DataFrame, resolver: Resolver) -> DataFrame:
    """documents with schema_id (Resolver.schema gives the schema) and resolution: resolved, untyped or an error's kind.

    The resolver goes to the tasks, which resolve each distinct identifier once; the answers come back by a join on the
    identifier. Nothing reaches the driver.
    """
    keys = ["reference", "layers", "signature"]
    distinct = documents.select(*keys).distinct().where("reference IS NOT NULL OR signature IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for reference, layers, sign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found.append((resolver.identity(Identifier(reference, tuple(layers or ()), sign)), "resolved"))
                except Unresolved as e:
                    found.append((None, e.kind))
            yield pa.record_batch([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], [*keys, "schema_id", "resolution"])

    found = distinct.mapInArrow(run, "reference string, layers array<string>, signature string, schema_id string, resolution string")
    joined = documents.join(found, [documents[k].eqNullSafe(found[k]) for k in keys], "left")
    return joined.select(*(documents[c] for c in documents.columns), "schema_id", F.coalesce("resolution", F.lit("untyped")).alias("resolution"))
