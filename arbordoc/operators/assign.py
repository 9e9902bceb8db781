"""Type assignment: from compounds to typed elements, with every validation error."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from ..functions.registry import BUILT_IN_VALIDATORS, Codecs, Validator, View
from ..plans.patterns import matches_whole
from ..plans.schema import Entry, Member, Schema
from ..sources.parser import Compound, Document, Error

#: Frames for the walk down a document; calls from Python to Python take no C stack, so nesting has no other limit than memory.
FRAMES = 5_000_000


@dataclass(slots=True)
class Element:
    keyword: str
    keyword_ix: int | None
    member_ix: int | None
    kind: str  # struct, scalar, flag, or unknown for a keyword its parent does not have
    type: str
    text: str | None = None
    origin: str = "compound"  # atom, compound or default
    children: list[Element] = field(default_factory=list)
    start: int = 0
    source_ord: int = 0  # order among the parent's written children
    compound: Compound | None = None
    unknown: list[Element] = field(default_factory=list)  # compounds without a type


class Assigner:
    """validators: None skips validation altogether; names it does not know fail. codecs: None skips encodings."""

    def __init__(self, schema: Schema, validators: Mapping[str, Validator] | None = BUILT_IN_VALIDATORS, codecs: Codecs | None = None):
        self.schema, self.validators, self.codecs = schema, validators, codecs
        self.errors: list[Error] = []

    def assign(self, doc: Document) -> Element:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
        root = Element("", None, None, "struct", "", compound=doc.root)
        self.fill(root, doc.root)
        return root

    def error(self, code: str, start: int, end: int | None = None) -> None:
        self.errors.append(Error(code, start, start if end is None else end))

    def child(self, c: Compound, entry: Entry, order: int) -> Element:
        e = Element(c.keyword, entry.index, entry.member, entry.kind, entry.type, start=c.start, source_ord=order, compound=c)
        end = c.start + len(c.keyword)
        inner = next(c.children(), None) if c.blocks else None
        if e.kind == "flag":
            if c.atoms or inner:
                self.error("E311", c.start, end)
        elif e.kind == "scalar":
            if len(c.atoms) > 1:
                self.error("E302", c.start, end)
            if inner:
                self.error("E301", c.start, end)
            e.text = c.atoms[0].text if c.atoms else ""
            self.scalar(e)
        elif e.kind == "struct":
            self.fill(e, c)
        return e

    def fill(self, e: Element, c: Compound) -> None:
        struct = self.schema.struct(e.type)
        filled: list[list[Element]] = [[] for _ in struct.members]
        order = self.atoms(c, struct.members, e.type, filled) if c.atoms else 0
        keywords = self.schema.keywords(e.type)
        last, left = None, set()
        for child in c.children():
            end = child.start + len(child.keyword)
            entry = keywords.get(child.keyword)
            if entry is None:
                self.error("E306", child.start, end)
                e.unknown.append(Element(child.keyword, None, None, "unknown", "", start=child.start, source_ord=order, compound=child))
                order += 1
                continue
            if entry.member != last:
                if entry.member in left:
                    self.error("E309", child.start, end)
                left.add(last)
                last = entry.member
            filled[entry.member].append(self.child(child, entry, order))
            order += 1
        self.members(e, c, struct.members, filled)
        e.children = [x for own in filled for x in own]
        if len(e.children) > 1:
            self.keys(e, struct.members)
        if self.validators is not None:
            for name in struct.validators:
                self.struct(e, name)

    def atoms(self, c: Compound, members: tuple[Member, ...], type_name: str, filled: list[list[Element]]) -> int:
        """The atom phase: members in order, each atom to the first that does not pass it on."""
        at = n = 0
        entries = self.schema.own_entries(type_name)
        for atom in c.atoms:
            end = c.start + len(c.keyword)
            while at < len(members) and self.passes(members[at], atom.text):
                at += 1
            if at == len(members):
                self.error("E302", c.start, end)
                break
            m = members[at]
            if not self.schema.atom_assignable(m):
                self.error("E303", c.start, end)
                break
            own = entries[at]
            entry = next((x for x in own if x.keyword == atom.text), None)
            if m.kind == "field" and self.schema.kind(m.type) == "scalar":
                e = Element(m.keyword or "", own[0].index, at, "scalar", m.type, atom.text, "atom", start=c.start, source_ord=n, compound=c)
                self.scalar(e)
                filled[at].append(e)
            elif entry is None:
                self.error("E304" if m.kind == "select" else "E305", c.start, end)
            else:
                filled[at].append(Element(entry.keyword, entry.index, at, "flag", entry.type, None, "atom", start=c.start, source_ord=n, compound=c))
            n += 1
            if not m.is_repeatable:
                at += 1
        return n

    def passes(self, m: Member, text: str) -> bool:
        """Whether an atom may go past a member: never a scalar, only what is optional and cannot mean it."""
        if m.is_required:
            return False
        if not self.schema.atom_assignable(m):
            return True
        if m.kind == "select":
            return all(v.keyword != text for v in self.schema.select(m.type).variants)
        return self.schema.kind(m.type) == "flag" and m.keyword != text

    def members(self, e: Element, c: Compound, members: tuple[Member, ...], filled: list[list[Element]]) -> None:
        for i, m in enumerate(members):
            own = filled[i]
            if own:
                if len(own) > 1 and not m.is_repeatable:
                    self.error("E308", own[1].start, own[1].start + len(own[1].keyword))
                continue
            if m.is_required:
                if m.kind == "field" and m.default is not None and self.schema.kind(m.type) == "scalar":
                    entry = self.schema.own_entries(e.type)[i][0]
                    d = Element(m.keyword or "", entry.index, i, "scalar", m.type, m.default, "default", start=c.start, source_ord=1 << 30, compound=c)
                    self.scalar(d)
                    own.append(d)
                else:
                    self.error("E307", c.start, c.start + len(c.keyword))

    def key_of(self, e: Element) -> str | None:
        m = self.schema.key_member(e.type) if e.kind == "struct" else None
        return None if m is None else next((c.text for c in e.children if c.keyword == m.keyword), None)

    def keys(self, e: Element, members: tuple[Member, ...]) -> None:
        seen = set()
        keyed = [(x.source_ord, key, x) for x in e.children if x.kind == "struct" and members[x.member_ix].is_repeatable and (key := self.key_of(x)) is not None]
        for _, key, x in sorted(keyed, key=lambda k: k[0]):
            if key in seen:
                self.error("E314", x.start, x.start + len(x.keyword))
            seen.add(key)

    def scalar(self, e: Element) -> None:
        scalar = self.schema.scalar(e.type)
        text = e.text or ""
        if self.validators is not None:
            for name in scalar.validators:
                check = self.validators.get(name)
                if check is None or check(text) is not None:
                    self.error("E310", e.start, e.start + len(e.keyword))
        for pattern in scalar.patterns:
            if not matches_whole(pattern, text):
                self.error("E315", e.start, e.start + len(e.keyword))
        if scalar.encoding and self.codecs is not None:
            codec = self.codecs(scalar.encoding)
            if codec is None:
                self.error("E313", e.start, e.start + len(e.keyword))
            elif codec.encode(text) is None:
                self.error("E312", e.start, e.start + len(e.keyword))

    def struct(self, e: Element, name: str) -> None:
        """One error for each message; a malformed answer counts as one error."""
        check = (self.validators or {}).get(name)
        answer = "unknown validator" if check is None else check(View(e))
        if answer is None:
            return
        self.flatten(e, answer)

    def flatten(self, e: Element, answer: object) -> None:
        """A message counts against the element, a mapping against the children it names, down to every leaf."""
        if not isinstance(answer, Mapping) or not answer:
            self.error("E310", e.start, e.start + len(e.keyword))
            return
        for keyword, inner in answer.items():
            at = next((c for c in e.children if c.keyword == keyword), None)
            if at is None:
                self.error("E310", e.start, e.start + len(e.keyword))
            else:
                self.flatten(at, inner)


def assign(doc: Document, schema: Schema, validators: Mapping[str, Validator] | None = BUILT_IN_VALIDATORS, codecs: Codecs | None = None) -> tuple[Element, list[Error]]:
    """The root element and the validation errors of a document; the schema's layers are composed already."""
    a = Assigner(schema, validators, codecs)
    return a.assign(doc), a.errors


def walk(root: Element) -> Iterator[tuple[Element, int, int, int, int]]:
    """(element, id, parent id, depth, order among siblings), parents first; unknown compounds last among their siblings."""
    work, n = [(root, -1, 0, 0)], 0
    while work:
        e, parent, depth, order = work.pop()
        yield e, n, parent, depth, order
        work += [(c, n, depth + 1, i) for i, c in reversed(list(enumerate([*e.children, *e.unknown])))]
        n += 1
