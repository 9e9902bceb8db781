"""Named validators and codecs, resolved once and then applied to many values."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from ..plans.schema import IDENTIFIER, TYPE_NAME
from ..sources.parser import SIGILS
from .varints import MalformedVarint, decode_varint, encode_varint

#: A scalar validator gets the text, a struct validator a view; each returns None or a message, or a mapping of
#: child keyword to message with the struct's own message under "".
Validator = Callable[[object], object]


class View:
    """What a struct validator sees of an element."""

    def __init__(self, element):
        self.element = element

    def scalar(self, keyword: str) -> str | None:
        return next((c.text for c in self.element.children if c.keyword == keyword and c.kind == "scalar"), None)

    def flag(self, keyword: str) -> bool:
        return any(c.keyword == keyword and c.kind == "flag" for c in self.element.children)

    def struct_field(self, keyword: str) -> View | None:
        return next((View(c) for c in self.element.children if c.keyword == keyword and c.kind == "struct"), None)

    def children(self, keyword: str | None = None) -> list:
        return [c for c in self.element.children if keyword in (None, c.keyword)]


def _matches(pattern: str, what: str) -> Validator:
    compiled = re.compile(pattern)
    return lambda text: None if isinstance(text, str) and compiled.fullmatch(text) else f"not {what}"


BUILT_IN_VALIDATORS: dict[str, Validator] = {
    "string": lambda text: None if isinstance(text, str) else "not applicable to structs",
    "identifier": _matches(IDENTIFIER, "an identifier"),
    "type-name": _matches(TYPE_NAME, "a type name"),
    "sigil": lambda text: None if isinstance(text, str) and len(text) == 1 and text in SIGILS else "not a sigil",
}


@dataclass(frozen=True)
class Codec:
    """encode: text -> bytes, or None for a text it rejects; decode: bytes -> text, or None. Mutual inverses on what they accept."""

    encode: Callable[[str], bytes | None]
    decode: Callable[[bytes], str | None]


def _hex_bytes(text: str) -> bytes | None:
    return bytes.fromhex(text) if re.fullmatch("(?:[0-9a-f]{2})*", text) else None


def _decimal(text: str) -> bytes | None:
    return encode_varint(int(text)) if re.fullmatch("0|[1-9][0-9]{0,18}", text) else None


def _undecimal(data: bytes) -> str | None:
    try:
        value, end = decode_varint(data)
    except MalformedVarint:
        return None
    return str(value) if end == len(data) and encode_varint(value) == data else None


HEX_BYTES = Codec(_hex_bytes, lambda data: data.hex())
DECIMAL_VARINT = Codec(_decimal, _undecimal)


class Codecs:
    """Resolves each name once. Names nobody bound resolve to None."""

    def __init__(self, bound: Mapping[str, Codec] | Callable[[str], Codec | None]):
        self.bind = bound if callable(bound) else bound.get
        self.known: dict[str, Codec | None] = {}

    def __call__(self, name: str) -> Codec | None:
        if name not in self.known:
            self.known[name] = self.bind(name)
        return self.known[name]
