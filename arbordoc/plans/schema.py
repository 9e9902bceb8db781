"""Schemas: their model, the schema of schemas, construction from documents, and validity.

Schemas are small and live on the driver; a composed schema is broadcast. catalog() gives its relational form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from ..sources.parser import PRAGMA, SIGILS
from .patterns import is_pattern

# Fixed values of the format.
BUILT_IN = {"Flag": None, "String": "string", "Identifier": "identifier", "Sigil": "sigil", "TypeName": "type-name"}
IDENTIFIER = r"'*[a-z](?:-?[a-z0-9])*"
TYPE_NAME = r"[A-Z][A-Za-z0-9]*"


@dataclass(frozen=True)
class Member:
    """A field (with keyword and type) or a use of a select (type is the select's name)."""

    kind: str  # field or select
    type: str
    keyword: str | None = None
    required: str = "default"  # default, loose (optional) or tight
    repeatable: str = "default"  # default, loose (repeatable) or tight
    key: bool = False
    default: str | None = None
    description: str | None = None

    @property
    def is_required(self) -> bool:
        return self.required != "loose"

    @property
    def is_repeatable(self) -> bool:
        return self.repeatable == "loose"


@dataclass(frozen=True)
class Struct:
    name: str = ""
    members: tuple[Member, ...] = ()
    validators: tuple[str, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Scalar:
    name: str
    validators: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    encoding: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class Variant:
    keyword: str
    type: str
    description: str | None = None


@dataclass(frozen=True)
class Select:
    name: str
    variants: tuple[Variant, ...] = ()
    excludes: tuple[str, ...] = ()
    validators: tuple[str, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Layer:
    name: str
    overlay: Struct = Struct()
    records: tuple[Struct, ...] = ()
    scalars: tuple[Scalar, ...] = ()
    selects: tuple[Select, ...] = ()


@dataclass(frozen=True)
class Entry:
    """One keyword of a struct: its index, member, type and kind."""

    index: int
    keyword: str
    member: int
    type: str
    kind: str


@dataclass(frozen=True)
class Schema:
    name: str
    document: Struct = Struct()
    records: tuple[Struct, ...] = ()
    scalars: tuple[Scalar, ...] = ()
    selects: tuple[Select, ...] = ()
    layers: tuple[Layer, ...] = ()
    sigil: str | None = None

    def __post_init__(self) -> None:
        for name, items in (("_records", self.records), ("_scalars", self.scalars), ("_selects", self.selects)):
            object.__setattr__(self, name, {x.name: x for x in reversed(items)})
        for name in ("_entries", "_keywords", "_keys", "_own"):
            object.__setattr__(self, name, {})

    def kind(self, name: str) -> str | None:
        """flag, scalar, struct or select; None where nothing has that name. The document's own type is ''."""
        if name in BUILT_IN:
            return "flag" if name == "Flag" else "scalar"
        if name == "" or name in self._records:
            return "struct"
        return "scalar" if name in self._scalars else "select" if name in self._selects else None

    def struct(self, name: str) -> Struct:
        return self._records[name] if name else self.document

    def scalar(self, name: str) -> Scalar:
        return self._scalars.get(name) or Scalar(name, (BUILT_IN[name],))

    def select(self, name: str) -> Select:
        return self._selects.get(name) or Select(name)

    def entries(self, name: str) -> list[Entry]:
        """The keyword order of a struct."""
        if name not in self._entries:
            out: list[Entry] = []
            for i, m in enumerate(self.struct(name).members):
                for k, t in [(m.keyword, m.type)] if m.kind == "field" else [(v.keyword, v.type) for v in self.select(m.type).variants]:
                    out.append(Entry(len(out), k, i, t, self.kind(t) or "unknown"))
            self._entries[name] = out
        return self._entries[name]

    def keywords(self, name: str) -> dict[str, Entry]:
        """Not to be changed by callers."""
        if name not in self._keywords:
            self._keywords[name] = {e.keyword: e for e in reversed(self.entries(name))}
        return self._keywords[name]

    def own_entries(self, name: str) -> list[list[Entry]]:
        """The entries of each member of a struct."""
        if name not in self._own:
            self._own[name] = [[e for e in self.entries(name) if e.member == i] for i in range(len(self.struct(name).members))]
        return self._own[name]

    def all_flags(self, m: Member) -> bool:
        return all(self.kind(v.type) == "flag" for v in self.select(m.type).variants)

    def atom_assignable(self, m: Member) -> bool:
        return self.all_flags(m) if m.kind == "select" else self.kind(m.type) in ("scalar", "flag")

    def key_member(self, name: str) -> Member | None:
        if name not in self._keys:
            self._keys[name] = next((m for m in self.struct(name).members if m.key), None)
        return self._keys[name]

    def structs(self) -> Iterator[Struct]:
        yield self.document
        yield from self.records

    def admits(self, path: list[str], keyword: str) -> bool:
        """Whether a compound reached by keywords from the root may have a child of that keyword."""
        at = ""
        for k in path:
            entry = self.keywords(at).get(k)
            if entry is None or entry.kind != "struct":
                return False
            at = entry.type
        return keyword in self.keywords(at)


@dataclass(frozen=True)
class Fault:
    """A schema error and what it is about."""

    code: str
    about: str = ""


@dataclass
class Faults:
    found: list[Fault] = field(default_factory=list)

    def add(self, code: str, about: str = "") -> None:
        self.found.append(Fault(code, about))


def _f(line: str, description: str | None = None) -> Member:
    words = line.split()
    axis = lambda loose, tight: "loose" if loose in words[2:] else "tight" if tight in words[2:] else "default"
    return Member("field", words[1], words[0], axis("optional", "required"), axis("repeatable", "irrepeatable"), "key" in words[2:], description=description)


def _s(line: str) -> Member:
    words = line.split()
    axis = lambda loose, tight: "loose" if loose in words else "tight" if tight in words else "default"
    return Member("select", words[0], None, axis("optional", "required"), axis("repeatable", "irrepeatable"))


def schema_of_schemas() -> Schema:
    """The self-describing schema: the vocabulary in which schemas are written. All names and texts are fixed values."""
    about = "description String optional"
    flags = ["optional Flag optional", "required Flag optional", "repeatable Flag optional", "irrepeatable Flag optional"]

    def record(name: str, description: str, *members: Member) -> Struct:
        return Struct(name, members, (), description)

    return Schema(
        PRAGMA + "s",
        Struct("", (_f("name Identifier"), _f("sigil Sigil optional"), _f("record Record optional repeatable"), _f("scalar Scalar optional repeatable"), _f("select Select optional repeatable"), _f("document Body"), _f("layer Layer optional repeatable"))),
        (
            record("Field", "A field declaration at a member position.", _f("keyword Identifier"), _f("type TypeName"), *map(_f, flags), _f("key Flag optional"), _f("default String optional"), _f(about)),
            record("SelectRef", "A select declaration at a member position, referencing a top-level SelectDefinition.", _f("reference TypeName"), *map(_f, flags)),
            record("Variant", "A variant declaration inside a Select body.", _f("keyword Identifier"), _f("type TypeName"), _f(about)),
            record("Record", "A record declaration: a named struct definition.", _f("name TypeName"), _s("Member optional repeatable"), _f(about)),
            record("Scalar", "A scalar declaration: a named scalar definition constrained by validators and/or RE2 patterns, with an optional encoding.", _f("name TypeName"), _f("validate Identifier optional repeatable"), _f("pattern String optional repeatable"), _f("encoding Identifier optional"), _f(about)),
            record("Select", "A top-level select declaration: a named sum type.", _f("name TypeName"), _s("SelectChild repeatable"), _f(about)),
            record("Body", "The shared struct shape used by document and overlay.", _s("Member optional repeatable")),
            record("Layer", "A layer declaration: per-layer definitions and an optional overlay.", _f("name Identifier"), _f("record Record optional repeatable"), _f("scalar Scalar optional repeatable"), _f("select Select optional repeatable"), _f("overlay Body optional")),
        ),
        (),
        (
            Select("Member", (Variant("field", "Field"), Variant("select", "SelectRef"), Variant("validate", "Identifier")), description="Members admissible inside a struct-shaped body: a field, select, or validator."),
            Select("SelectChild", (Variant("variant", "Variant"), Variant("exclude", "Identifier"), Variant("validate", "Identifier")), description="Children admissible inside a Select body: a variant, exclude, or validator."),
        ),
    )


META = schema_of_schemas()


def construct(root) -> Schema:
    """A schema from the root element of a document under the schema of schemas."""

    def texts(e, keyword: str) -> list[str]:
        return [c.text for c in e.children if c.keyword == keyword and c.kind == "scalar"]

    def one(e, keyword: str) -> str | None:
        return next(iter(texts(e, keyword)), None)

    def axis(e, loose: str, tight: str) -> str:
        have = {c.keyword for c in e.children if c.kind == "flag"}
        return "loose" if loose in have else "tight" if tight in have else "default"

    def member(e) -> Member:
        shared = {"required": axis(e, "optional", "required"), "repeatable": axis(e, "repeatable", "irrepeatable")}
        if e.keyword == "select":
            return Member("select", one(e, "reference") or "", **shared)
        return Member("field", one(e, "type") or "", one(e, "keyword") or "", key=any(c.keyword == "key" for c in e.children), default=one(e, "default"), description=one(e, "description"), **shared)

    def struct(e, name: str = "") -> Struct:
        return Struct(name, tuple(member(c) for c in e.children if c.keyword in ("field", "select") and c.kind == "struct"), tuple(texts(e, "validate")), one(e, "description"))

    def scalar(e) -> Scalar:
        return Scalar(one(e, "name") or "", tuple(texts(e, "validate")), tuple(texts(e, "pattern")), one(e, "encoding"), one(e, "description"))

    def select(e) -> Select:
        variants = tuple(Variant(one(c, "keyword") or "", one(c, "type") or "", one(c, "description")) for c in e.children if c.keyword == "variant")
        return Select(one(e, "name") or "", variants, tuple(texts(e, "exclude")), tuple(texts(e, "validate")), one(e, "description"))

    def parts(e) -> dict:
        of = lambda k: [c for c in e.children if c.keyword == k and c.kind == "struct"]
        return {"records": tuple(struct(c, one(c, "name") or "") for c in of("record")), "scalars": tuple(map(scalar, of("scalar"))), "selects": tuple(map(select, of("select")))}

    body = next((c for c in root.children if c.keyword == "document"), None)
    layers = []
    for c in root.children:
        if c.keyword == "layer":
            overlay = next((x for x in c.children if x.keyword == "overlay"), None)
            layers.append(Layer(one(c, "name") or "", struct(overlay) if overlay else Struct(), **parts(c)))
    return Schema(one(root, "name") or "", struct(body) if body else Struct(), layers=tuple(layers), sigil=one(root, "sigil"), **parts(root))


def check(schema: Schema) -> list[Fault]:
    """What makes a schema invalid, its layers apart from what only their merge can tell."""
    faults = Faults()
    names = Counter(d.name for d in (*schema.records, *schema.scalars, *schema.selects))
    for name, n in names.items():
        if n > 1 or name in BUILT_IN:
            faults.add("E210", name)
    if schema.sigil is not None and (len(schema.sigil) != 1 or schema.sigil not in SIGILS):
        faults.add("E207", schema.sigil)
    for name, n in Counter(x.name for x in schema.layers).items():
        if n > 1:
            faults.add("E204", name)
    for s in schema.selects:
        for k in s.excludes:
            faults.add("E216", k)
    for s in schema.scalars:
        check_scalar(s, faults)
    for layer in schema.layers:
        for s in layer.scalars:
            check_scalar(s, faults, base=False)
    for s in (*schema.selects, *(x for layer in schema.layers for x in layer.selects)):
        for v in s.variants:
            if v.keyword == PRAGMA:
                faults.add("E208", s.name)
    for body in (*schema.structs(), *(x for layer in schema.layers for x in (layer.overlay, *layer.records))):
        for m in body.members:
            if m.keyword == PRAGMA:
                faults.add("E208", body.name)
    if not schema.layers:
        check_composed(schema, faults)
    return faults.found


def check_scalar(s: Scalar, faults: Faults, base: bool = True) -> None:
    for p in s.patterns:
        if not is_pattern(p):
            faults.add("E222", p)
    if base and not s.validators and not s.patterns:
        faults.add("E224", s.name)


def check_composed(schema: Schema, faults: Faults) -> None:
    """Rules on the structs and selects of a schema without layers left."""
    for s in schema.selects:
        if not s.variants:
            faults.add("E202", s.name)
        for k, n in Counter(v.keyword for v in s.variants).items():
            if n > 1:
                faults.add("E201", k)
        for v in s.variants:
            check_reference(schema, v.type, False, faults)
    for body in schema.structs():
        uses = Counter(k for m in body.members for k in ([m.keyword] if m.kind == "field" else {v.keyword for v in schema.select(m.type).variants}))
        for k, n in uses.items():
            if n > 1:
                faults.add("E201", k)
        keys = [m for m in body.members if m.key]
        if len(keys) > 1:
            faults.add("E221", keys[1].keyword or "")
        for m in body.members:
            check_reference(schema, m.type, m.kind == "select", faults)
            if m.kind == "field" and m.default is not None and (schema.kind(m.type) != "scalar" or not m.is_required):
                faults.add("E203", m.keyword or "")
            if m.key and schema.kind(m.type) != "scalar":
                faults.add("E219", m.keyword or "")
            if m.key and (not m.is_required or m.is_repeatable):
                faults.add("E220", m.keyword or "")


def check_reference(schema: Schema, name: str, select: bool, faults: Faults) -> None:
    kind = schema.kind(name)
    if kind is None or select and name in BUILT_IN:
        faults.add("E209", name)
    elif (kind == "select") != select:
        faults.add("E217", name)


def incoherent(schema: Schema) -> list[str]:
    """Type names that members or variants use and nothing defines."""
    used = [m.type for s in schema.structs() for m in s.members] + [v.type for s in schema.selects for v in s.variants]
    return sorted({t for t in used if schema.kind(t) is None})


def canonical_name(text: str, kind: str) -> bool:
    return re.fullmatch(IDENTIFIER if kind == "identifier" else TYPE_NAME, text) is not None


def without_layers(schema: Schema) -> Schema:
    return replace(schema, layers=())


def catalog(spark, schemas: dict[str, Schema]) -> dict:
    """Relational form of schemas by id: types, scalars, members, keywords and constraints. Small; broadcast when joined."""
    types, scalars, members, keywords, constraints = [], [], [], [], []
    for sid, s in schemas.items():
        for b, v in BUILT_IN.items():
            types.append((sid, b, s.kind(b)))
            if v:
                constraints.append((sid, b, 0, "validator", v))
        for d in s.structs():
            types.append((sid, d.name, "struct"))
            for i, m in enumerate(d.members):
                members.append((sid, d.name, i, m.kind, m.keyword, m.type, m.is_required, m.is_repeatable, m.key, m.default))
            for e in s.entries(d.name):
                keywords.append((sid, d.name, e.member, e.index, e.keyword, e.type, e.kind))
            constraints += [(sid, d.name, i, "validator", v) for i, v in enumerate(d.validators)]
        for d in s.scalars:
            types.append((sid, d.name, "scalar"))
            scalars.append((sid, d.name, d.encoding))
            constraints += [(sid, d.name, i, "validator", v) for i, v in enumerate(d.validators)]
            constraints += [(sid, d.name, len(d.validators) + i, "pattern", p) for i, p in enumerate(d.patterns)]
        for d in s.selects:
            types.append((sid, d.name, "select"))
            constraints += [(sid, d.name, i, "validator", v) for i, v in enumerate(d.validators)]
    return {
        "types": spark.createDataFrame(types, "schema_id string, type_name string, kind string"),
        "scalars": spark.createDataFrame(scalars, "schema_id string, type_name string, encoding string"),
        "members": spark.createDataFrame(members, "schema_id string, type_name string, member_ix int, kind string, keyword string, member_type string, required boolean, repeatable boolean, is_key boolean, default_text string"),
        "keywords": spark.createDataFrame(keywords, "schema_id string, type_name string, member_ix int, keyword_ix int, keyword string, child_type string, child_kind string"),
        "constraints": spark.createDataFrame(constraints, "schema_id string, type_name string, ord int, kind string, text string"),
    }
