"""The binary form: keyword indices and values in canonical order, with a schema signature in front."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, replace

from ..functions.hashes import CADENCE, HashLibrary, blake3, stack_hashes, unstack
from ..functions.registry import Codecs
from ..functions.varints import MalformedVarint, decode_varint, encode_varint
from ..plans.compose import compose
from ..plans.schema import META, Schema, construct
from .assign import Element

# Fixed values of the format.
EXTERNAL, SELF_CONTAINED = bytes.fromhex("b2c4b5bb"), bytes.fromhex("b2c4b5bc")


class CannotEncode(ValueError):
    """A value or an encoding name has no binary form; nothing is written."""


class BinaryError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def encode_root(root: Element, schema: Schema, codecs: Codecs | None = None) -> bytes:
    """Children by member order, atoms before compounds before defaults; the presentation has no say."""
    out = bytearray()
    work: list = [root]
    while work:
        e = work.pop()
        if e.keyword_ix is not None:
            out += encode_varint(e.keyword_ix)
        if e.kind == "struct":
            out += encode_varint(len(e.children))
            work += reversed(e.children)
        elif e.kind == "scalar":
            data = scalar_bytes(e.text or "", schema.scalar(e.type).encoding, codecs)
            out += encode_varint(len(data)) + data
    return bytes(out)


def scalar_bytes(text: str, encoding: str | None, codecs: Codecs | None) -> bytes:
    if encoding is None:
        return text.encode()
    codec = codecs(encoding) if codecs else None
    data = codec.encode(text) if codec else None
    if data is None:
        raise CannotEncode(encoding)
    return data


def value_hash(root: Element, schema: Schema, codecs: Codecs | None = None) -> bytes:
    return blake3(encode_root(root, schema, codecs))


@dataclass
class Cursor:
    data: bytes
    at: int = 0

    def take(self, n: int, code: str = "B09") -> bytes:
        if self.at + n > len(self.data):
            raise BinaryError(code)
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        if self.at >= len(self.data):
            raise BinaryError("B09")
        try:
            value, self.at = decode_varint(self.data, self.at)
        except MalformedVarint as e:
            raise BinaryError("B02") from e
        return value


def decode_root(cursor: Cursor, schema: Schema, codecs: Codecs | None = None, verify: bool = True) -> Element:
    """The element tree of a root encoding. verify: encoded values must encode to the same bytes again (B15)."""
    root = Element("", None, None, "struct", "")
    work = [(root, cursor.varint())]
    while work:
        parent, left = work.pop()
        if not left:
            continue
        work.append((parent, left - 1))
        entries = schema.entries(parent.type)
        index = cursor.varint()
        if index >= len(entries):
            raise BinaryError("B05")
        entry = entries[index]
        e = Element(entry.keyword, index, entry.member, entry.kind, entry.type, source_ord=len(parent.children))
        parent.children.append(e)
        if entry.kind == "struct":
            work.append((e, cursor.varint()))
        elif entry.kind == "scalar":
            e.text = decode_scalar(cursor.take(cursor.varint(), "B06"), schema.scalar(entry.type).encoding, codecs, verify)
        elif entry.kind != "flag":
            raise BinaryError("B10")
    return root


def decode_scalar(data: bytes, encoding: str | None, codecs: Codecs | None, verify: bool) -> str:
    if encoding is None:
        try:
            return data.decode()
        except UnicodeDecodeError as e:
            raise BinaryError("B07") from e
    codec = codecs(encoding) if codecs else None
    if codec is None:
        raise BinaryError("B13")
    text = codec.decode(data)
    if text is None:
        raise BinaryError("B14")
    if verify and codec.encode(text) != data:
        raise BinaryError("B15")
    return text


def read_signature(cursor: Cursor) -> bytes:
    n = cursor.varint()
    if n != 33 and (n < 37 or n % 2 == 0):
        raise BinaryError("B03")
    signature = cursor.take(n)
    c = 0
    for b in signature:
        c ^= b
    if c != CADENCE:
        raise BinaryError("B03")
    return signature


def component_hashes(schema_root: Element) -> list[bytes]:
    """Of a schema document's root element: the hash of the base without layers, then of each layer."""
    base = replace(schema_root, children=[c for c in schema_root.children if c.keyword != "layer"])
    layers = [replace(c, keyword_ix=None) for c in schema_root.children if c.keyword == "layer"]
    return [value_hash(x, META) for x in (base, *layers)]


def signature(schema_root: Element, selected: list[str] | None = None) -> bytes:
    """The signature of the base and its layers (all, or those selected)."""
    first, *others = component_hashes(schema_root)
    names = [next((x.text for x in c.children if x.keyword == "name"), None) for c in schema_root.children if c.keyword == "layer"]
    return stack_hashes([first, *(h for h, n in zip(others, names, strict=True) if selected is None or n in selected)])


def encode_document(root: Element, schema: Schema, sign: bytes, codecs: Codecs | None = None) -> bytes:
    return EXTERNAL + encode_varint(len(sign)) + sign + encode_root(root, schema, codecs)


def encode_self_contained(root: Element, schema_root: Element, codecs: Codecs | None = None) -> bytes:
    """With the schema document inside; its composed schema types the root."""
    schema, _ = compose(construct(schema_root))
    return self_contained_head(schema_root) + encode_root(root, schema, codecs)


def self_contained_head(schema_root: Element) -> bytes:
    """What stands before the root in every self-contained document of a schema."""
    sign, body = signature(schema_root), encode_root(schema_root, META)
    return SELF_CONTAINED + encode_varint(len(sign)) + sign + encode_varint(len(body)) + body


#: Schemas inside documents by signature and body, as last used; documents of one table repeat few of them.
_INSIDE: OrderedDict[tuple[bytes, bytes], Schema] = OrderedDict()
MOST_INSIDE = 256


def schema_inside(sign: bytes, data: bytes) -> Schema:
    """The composed schema of a self-contained document's body. Bodies that are wrong raise each time."""
    key = sign, data
    if key not in _INSIDE:
        _INSIDE[key] = _read_inside(sign, data)
        while len(_INSIDE) > MOST_INSIDE:
            _INSIDE.popitem(last=False)
    _INSIDE.move_to_end(key)
    return _INSIDE[key]


def _read_inside(sign: bytes, data: bytes) -> Schema:
    body = Cursor(data)
    try:
        schema_root = decode_root(body, META)
    except BinaryError as e:
        raise BinaryError("B12") from e
    if body.at != len(body.data) or not any(c.keyword == "document" for c in schema_root.children):
        raise BinaryError("B12")
    if signature(schema_root) != sign:
        raise BinaryError("B11")
    schema, faults = compose(construct(schema_root))
    if faults:
        raise BinaryError("B12")
    return schema


def decode_document(data: bytes, schema: Schema | None, codecs: Codecs | None = None, library: HashLibrary | None = None) -> tuple[Element, bytes, Schema]:
    """(root, signature, schema) of either mode. schema may be None for self-contained documents. BinaryError otherwise."""
    cursor = Cursor(data)
    magic = cursor.take(4)
    if magic not in (EXTERNAL, SELF_CONTAINED):
        raise BinaryError("B01")
    sign = read_signature(cursor)
    if library is not None and unstack(sign, library) is None:
        raise BinaryError("B04")
    if magic == SELF_CONTAINED:
        schema = schema_inside(sign, cursor.take(cursor.varint()))
    if schema is None:
        raise BinaryError("B10")
    root = decode_root(cursor, schema, codecs)
    if cursor.at != len(data):
        raise BinaryError("B08")
    return root, sign, schema


