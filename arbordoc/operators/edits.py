"""Machine edits of documents, and the merge of concurrent edits.

An edit names its target by positions and is tried on a copy: one that the schema would then reject is refused with the
first error's code. A merge sorts all edits by (timestamp, agent), finds each target by identity rather than by position,
since other agents' edits may have moved it, and demotes what no longer applies to a remark or a comment.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.schema import Schema
from ..sources.parser import Atom, Block, Compound, Document, parse, write
from ..sources.storage import pieces
from .assign import Assigner, Element
from .canonical import atom_form, delimiter, inline_safe, source_safe


OPERATIONS = ("update-value", "attach-remark", "remove-remark", "delete", "replace", "set-flag", "unset-flag", "insert", "insert-before", "insert-after", "insert-into-block", "reorder-within-group", "reorder-groups", "resize-tabulation")


#: An identity that no compound has: a document's first compound starts at 0 where nothing stands before it.
NOWHERE = 1 << 62


class Refused(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Edit:
    """path: (block, compound) pairs from the root. What else an edit takes depends on its operation."""

    op: str
    path: tuple[tuple[int, int], ...] = ()
    value: str | None = None
    keyword: str | None = None
    block: int | None = None
    index: int | None = None
    compound: str | None = None  # text of one compound with its children
    other: str | None = None
    timestamp: int = 0
    agent: str = ""

    @classmethod
    def from_json(cls, text: str, timestamp: int = 0, agent: str = "") -> Edit:
        """ValueError where the text is not an edit."""
        return replace(_edit(text), timestamp=int(timestamp), agent=str(agent))


@lru_cache(maxsize=4096)
def _edit(text: str) -> Edit:
    try:
        d = json.loads(text)
        edit = Edit(**{**d, "path": tuple((int(b), int(c)) for b, c in d.get("path", []))})
    except (TypeError, AttributeError, json.JSONDecodeError) as e:
        raise ValueError(f"not an edit: {text}") from e
    if edit.op not in OPERATIONS:
        raise ValueError(f"no such edit: {edit.op}")
    return edit


def find(doc: Document, path) -> Compound:
    at = doc.root
    for b, c in path:
        if not (0 <= b < len(at.blocks) and 0 <= c < len(at.blocks[b].compounds)):
            raise Refused("unresolved")
        at = at.blocks[b].compounds[c]
    return at


def locate(root: Compound, identity: int) -> tuple[Compound, Block, int] | None:
    """(parent, block, place) of the compound with that identity (its start)."""
    work = [root]
    while work:
        at = work.pop()
        for b in at.blocks:
            for i, c in enumerate(b.compounds):
                if c.start == identity:
                    return at, b, i
                work.append(c)
    return None


def one_compound(text: str, sigil: str, identity: int) -> Compound:
    d = parse(text)
    made = list(d.root.children())
    if d.errors or len(made) != 1:
        raise Refused(d.errors[0].code if d.errors else "not one compound")
    work = [made[0]]
    while work:
        c = work.pop()
        c.start, identity = identity, identity - 1
        work += c.children()
    return made[0]


def refit(atom: Atom | None, value: str, sigil: str, indent: int) -> Atom:
    """The value in the atom's form while that carries it, else in the first later form that does; never an earlier one."""
    form = atom.form if atom else "inline"
    if form == "inline" and inline_safe(value, sigil) and value:
        return Atom("inline", value, max(atom.spaces if atom else 1, 2 if " " in value else 1))
    if form in ("inline", "source") and source_safe(value):
        return Atom("source", value)
    old = atom.delimiter if atom else None
    mark = old if old and " " * indent + old not in value.split("\n") else delimiter(value, indent)
    return Atom("literal", value, delimiter=mark)


def depth_of(root: Compound, target: Compound) -> int:
    work = [(root, -1)]
    while work:
        c, d = work.pop()
        if c is target:
            return d
        work += [(x, d + 1) for x in c.children()]
    return 0


class Kept:
    """What an edit may change: the compounds down its path with their atoms and blocks, and the rows of a table that is resized."""

    def __init__(self, doc: Document, edit: Edit):
        at, nodes = doc.root, [doc.root]
        for b, c in edit.path:
            if not (0 <= b < len(at.blocks) and 0 <= c < len(at.blocks[b].compounds)):
                break
            at = at.blocks[b].compounds[c]
            nodes.append(at)
        self.nodes = [(c, list(c.atoms), c.remark, list(c.blocks)) for c in nodes]
        self.blocks = [(b, list(b.comments), b.offsets, list(b.headings), list(b.compounds), b.blanks) for c in nodes[-2:] for b in c.blocks]
        self.spaces = [(a, a.spaces) for b in at.blocks for c in b.compounds for a in c.atoms] if edit.op == "resize-tabulation" else []

    def restore(self) -> None:
        for c, atoms, remark, blocks in self.nodes:
            c.atoms, c.remark, c.blocks = atoms, remark, blocks
        for b, comments, offsets, headings, compounds, blanks in self.blocks:
            b.comments, b.offsets, b.headings, b.compounds, b.blanks = comments, offsets, headings, compounds, blanks
        for a, spaces in self.spaces:
            a.spaces = spaces


class Editor:
    """Applies edits to one document under a schema (None: without checks)."""

    def __init__(self, doc: Document, schema: Schema | None):
        self.doc, self.schema = doc, schema
        self.fresh = -1
        self.known: Counter | None = None  # the document's errors as it stands

    def codes(self) -> Counter:
        if self.schema is None:
            return Counter()
        a = Assigner(self.schema)
        a.assign(self.doc)
        return Counter(e.code for e in a.errors)

    def apply(self, edit: Edit) -> None:
        """Refused leaves the document as it was; an edit that changes nothing succeeds."""
        if self.known is None:
            self.known = self.codes()
        kept = Kept(self.doc, edit)
        try:
            self.change(edit)
            after = self.codes()
            if worse := after - self.known:
                raise Refused(min(worse))
            self.known = after
        except (Refused, IndexError, TypeError) as e:
            kept.restore()
            raise e if isinstance(e, Refused) else Refused("unresolved") from e

    def made(self, edit: Edit) -> Compound:
        c = one_compound(edit.compound or "", self.doc.sigil, self.fresh)
        self.fresh -= 1 + sum(1 for _ in _all(c))
        return c

    def change(self, edit: Edit) -> None:
        target = find(self.doc, edit.path)
        parent = find(self.doc, edit.path[:-1]) if edit.path else None
        place = edit.path[-1] if edit.path else None
        {
            "update-value": self.update_value,
            "attach-remark": lambda t, *_: setattr(t, "remark", edit.value),
            "remove-remark": lambda t, *_: setattr(t, "remark", None),
            "delete": self.delete,
            "replace": self.replace,
            "set-flag": self.set_flag,
            "unset-flag": self.unset_flag,
            "insert": lambda t, *_: self.insert(t, self.made(edit)),
            "insert-before": self.insert_beside,
            "insert-after": self.insert_beside,
            "insert-into-block": lambda t, *_: t.blocks[edit.block or 0].compounds.append(self.made(edit)),
            "reorder-within-group": self.reorder_within,
            "reorder-groups": self.reorder_groups,
            "resize-tabulation": lambda t, *_: resize(t.blocks[edit.block or 0], 2 * (depth_of(self.doc.root, t) + 1)),
        }[edit.op](target, parent, place, edit)

    def update_value(self, target: Compound, parent, place, edit: Edit) -> None:
        """Of a compound's own atom, or of the atom number `index` on its line."""
        value = edit.value or ""
        indent = self.doc.margin + 2 * depth_of(self.doc.root, target) + 6
        at = edit.index or 0
        if at and not inline_safe(value, self.doc.sigil):
            raise Refused("not inline-safe")
        old = target.atoms[at] if at < len(target.atoms) else None
        if old is not None and old.text == value:
            return
        target.atoms[at : at + 1] = [] if not value and (old is None or old.form == "inline") else [refit(old, value, self.doc.sigil, indent)]

    def delete(self, target, parent: Compound, place, edit) -> None:
        if parent is None:
            raise Refused("unresolved")
        block = parent.blocks[place[0]]
        block.compounds.pop(place[1])
        if not block.compounds:
            parent.blocks.remove(block)

    def replace(self, target: Compound, parent: Compound, place, edit: Edit) -> None:
        new = self.made(edit)
        if self.schema and self.member(parent, new.keyword) != self.member(parent, target.keyword):
            raise Refused("E306")
        new.remark = target.remark
        parent.blocks[place[0]].compounds[place[1]] = new

    def type_of(self, target: Compound) -> str | None:
        """The struct type of a compound, '' for the root; None where it has none."""
        if self.schema is None:
            return None
        work = [(self.doc.root, "")]
        while work:
            c, t = work.pop()
            if c is target:
                return t
            if c.blocks:
                keywords = self.schema.keywords(t)
                work += [(x, e.type) for x in c.children() if (e := keywords.get(x.keyword)) and e.kind == "struct"]
        return None

    def members(self, parent: Compound) -> Callable[[str], object]:
        """The group of each keyword below a compound: those of one member form one; without a schema those of one keyword."""
        t = self.type_of(parent)
        keywords = self.schema.keywords(t) if self.schema and t is not None else {}
        return lambda keyword: e.member if (e := keywords.get(keyword)) else keyword

    def member(self, parent: Compound, keyword: str) -> object:
        return self.members(parent)(keyword)

    def set_flag(self, target: Compound, parent, place, edit: Edit) -> None:
        t = self.type_of(target)
        children = list(target.children())
        if t is not None and self.schema:
            entry = self.schema.keywords(t).get(edit.keyword or "")
            earlier = [c for c in children if (x := self.schema.keywords(t).get(c.keyword)) and entry and x.member < entry.member]
            if entry and not earlier and all(a.form == "inline" for a in target.atoms):
                before = self.codes()
                target.atoms.append(Atom("inline", entry.keyword, 2 if any(a.spaces > 1 for a in target.atoms) else 1))
                if not self.codes() - before:
                    return
                target.atoms.pop()
        self.insert(target, Compound(edit.keyword or "", start=self.fresh))
        self.fresh -= 1

    def unset_flag(self, target: Compound, parent, place, edit: Edit) -> None:
        for i, a in enumerate(target.atoms):
            if a.form == "inline" and a.text == edit.keyword:
                del target.atoms[i]
                return
        for b in target.blocks:
            for c in b.compounds:
                if c.keyword == edit.keyword:
                    b.compounds.remove(c)
                    if not b.compounds:
                        target.blocks.remove(b)
                    return
        raise Refused("unresolved")

    def insert(self, parent: Compound, new: Compound) -> None:
        of = self.members(parent)
        group = of(new.keyword)
        last = next(((b, i) for b in reversed(parent.blocks) for i in range(len(b.compounds) - 1, -1, -1) if of(b.compounds[i].keyword) == group), None)
        if last:
            last[0].compounds.insert(last[1] + 1, new)
        else:
            parent.blocks.append(Block(compounds=[new]))

    def insert_beside(self, target, parent: Compound, place, edit: Edit) -> None:
        new, block = self.made(edit), parent.blocks[place[0]]
        after = edit.op == "insert-after"
        if block.offsets is None:
            block.compounds.insert(place[1] + after, new)
        else:
            parent.blocks.insert(place[0] + after, Block(compounds=[new]))

    def reorder_within(self, target: Compound, parent: Compound, place, edit: Edit) -> None:
        member = self.members(parent)
        group = member(target.keyword)
        slots = [(b, i) for b in parent.blocks for i, c in enumerate(b.compounds) if member(c.keyword) == group]
        members = [b.compounds[i] for b, i in slots]
        members.remove(target)
        if not 0 <= (edit.index or 0) <= len(members):
            raise Refused("unresolved")
        members.insert(edit.index or 0, target)
        for (b, i), c in zip(slots, members, strict=True):
            b.compounds[i] = c

    def reorder_groups(self, target: Compound, parent, place, edit: Edit) -> None:
        """Blocks of the group of `keyword` go before (index 0) or behind (index 1) those of `other`."""
        member = self.members(target)
        of = lambda b: {member(c.keyword) for c in b.compounds}
        mine, theirs = member(edit.keyword or ""), member(edit.other or "")
        moved = [b for b in target.blocks if mine in of(b)]
        anchor = [b for b in target.blocks if theirs in of(b)]
        if not moved or not anchor or any(len(of(b)) > 1 for b in (*moved, *anchor)):
            raise Refused("E309")
        rest = [b for b in target.blocks if b not in moved]
        at = rest.index(anchor[-1]) + 1 if edit.index else rest.index(anchor[0])
        target.blocks[:] = rest[:at] + moved + rest[at:]


def _all(c: Compound) -> Iterator[Compound]:
    yield c
    for x in c.children():
        yield from _all(x)


def cells(c: Compound) -> list[str]:
    """A row's texts: keyword and soft-spaced atoms first, then each hard-spaced atom."""
    out = [c.keyword]
    for a in c.atoms:
        if a.spaces > 1:
            out.append(a.text)
        else:
            out[-1] += " " + a.text
    return out


def minimal_offsets(indent: int, widths: list[int], headings: list[int]) -> list[int]:
    """The least offsets whose columns hold values and headings of these widths, two spaces apart; a heading starts two later."""
    out = [indent]
    for v, h in zip(widths, headings, strict=True):
        out.append(out[-1] + max(v, h + 2) + 2)
    return out[: len(widths)]


def resize(block: Block, indent: int) -> None:
    if block.offsets is None:
        raise Refused("unresolved")
    n = len(block.offsets)
    rows = [cells(c) for c in block.compounds]
    widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(n)]
    block.offsets = minimal_offsets(indent, widths, [len(h) for h in block.headings])
    for c in block.compounds:
        at, column = block.offsets[0] + len(c.keyword), 0
        for a in c.atoms:
            if a.spaces > 1 and column + 1 < n:
                column += 1
                a.spaces = block.offsets[column] - at
            at += a.spaces + len(a.text)


def construct(element: Element, schema: Schema, sigil: str = "#") -> Compound:
    """A compound from an element alone: members inline while they can be, in member order, the others as children."""
    c = Compound(element.keyword)
    if element.kind == "scalar":
        _set_value(c, element.text or "", sigil)
    if element.kind != "struct":
        return c
    members = schema.struct(element.type).members
    filled = [[x for x in element.children if x.member_ix == i and x.origin != "default"] for i in range(len(members))]
    stop = len(members)
    for i, m in enumerate(members):
        kind = schema.kind(m.type) if m.kind == "field" else "select"
        if m.kind == "field" and not m.is_repeatable and kind == "flag":
            c.atoms += [Atom("inline", m.keyword or "", 1) for _ in filled[i]]
        elif m.kind == "field" and not m.is_repeatable and kind == "scalar" and filled[i] and _inline(filled[i][0].text or "", sigil):
            _inline_atom(c, filled[i][0].text or "")
        else:
            stop = i
            break
    if stop < len(members):
        m = members[stop]
        if m.kind == "select" and filled[stop] and schema.all_flags(m):
            c.atoms += [Atom("inline", x.keyword, 1) for x in filled[stop]]
            stop += 1
        elif m.kind == "field" and m.is_repeatable and schema.kind(m.type) == "scalar" and all(_inline(x.text or "", sigil) for x in filled[stop]):
            for x in filled[stop]:
                _inline_atom(c, x.text or "")
            stop += 1
    children = [construct(x, schema, sigil) for own in filled[stop:] for x in own]
    if children:
        c.blocks.append(Block(compounds=children))
    hard = False
    for a in c.atoms:  # behind a hard space only hard spaces separate
        hard |= a.spaces > 1
        a.spaces = 2 if hard else a.spaces
    return c


def _inline(value: str, sigil: str) -> bool:
    return bool(value) and inline_safe(value, sigil)


def _inline_atom(c: Compound, value: str) -> None:
    c.atoms.append(Atom("inline", value, 2 if " " in value else 1))


def _set_value(c: Compound, value: str, sigil: str) -> None:
    form = atom_form(value, sigil)
    if form == "inline":
        if value:
            _inline_atom(c, value)
    else:
        c.atoms.append(Atom(form, value, delimiter=delimiter(value, 6) if form == "literal" else None))


def merge(doc: Document, edits: list[Edit], schema: Schema | None) -> list[Edit]:
    """Applies all agents' edits to doc in one order and returns those that were demoted.

    Each agent's paths are read on a replica that has only that agent's edits, which tells what they meant.
    """
    edits = sorted(edits, key=lambda e: (e.timestamp, e.agent))
    several = any(e.agent != edits[0].agent for e in edits)
    base = copied(doc) if several else doc
    replicas: dict[str, Editor] = {}
    editor, demoted = Editor(doc, schema), []
    if edits and not several:  # a single agent's replica is the document itself until an edit is demoted
        replicas[edits[0].agent] = editor
    for e in edits:
        if e.agent not in replicas:
            replicas[e.agent] = Editor(copied(base), schema)
        own = replicas[e.agent]
        if own is editor:
            identity = _identity(doc, e)
            try:
                editor.apply(e)
            except Refused:
                own = replicas[e.agent] = Editor(copied(doc), schema)
                own.known, own.fresh = editor.known, editor.fresh
                _demote(doc, e, identity, demoted)
            continue
        identity = _identity(own.doc, e)
        own.fresh = editor.fresh = min(own.fresh, editor.fresh)
        try:
            own.apply(e)
        except Refused:
            pass
        try:
            editor.apply(Edit(**{**e.__dict__, "path": _path(doc, identity, e.path)}))
        except Refused:
            _demote(doc, e, identity, demoted)
    return demoted


def _identity(doc: Document, e: Edit) -> int | None:
    """What an edit's path means in the document of its agent; None for the root, NOWHERE for a path that leads to nothing."""
    try:
        return find(doc, e.path).start if e.path else None
    except Refused:
        return NOWHERE


def _demote(doc: Document, e: Edit, identity: int | None, demoted: list[Edit]) -> None:
    demoted.append(e)
    note = f"Merge conflict (agent {e.agent}, ts={e.timestamp}): {e.op}"
    at = locate(doc.root, identity) if identity is not None else None
    if at:
        at[1].compounds[at[2]].remark = note + " attempted"
    elif doc.root.blocks and doc.root.blocks[0].offsets is None:
        doc.root.blocks[0].comments.append(note + " — target was removed")


def copied(doc: Document) -> Document:
    """A copy whose compounds, atoms and blocks are its own."""
    root = _shell(doc.root)
    work = [(doc.root, root)]
    while work:
        old, new = work.pop()
        for b in old.blocks:
            own = [_shell(c) for c in b.compounds]
            new.blocks.append(Block(list(b.comments), None if b.offsets is None else list(b.offsets), list(b.headings), own, b.blanks))
            work += [(c, x) for c, x in zip(b.compounds, own, strict=True) if c.blocks]
    return replace(doc, root=root, errors=list(doc.errors))


def _shell(c: Compound) -> Compound:
    return Compound(c.keyword, [Atom(a.form, a.text, a.spaces, a.delimiter) for a in c.atoms], c.remark, [], c.start)


def _path(doc: Document, identity: int | None, given) -> tuple[tuple[int, int], ...]:
    """Where the compound of that identity stands now."""
    if not given:
        return ()
    work: list[tuple[Compound, tuple]] = [(doc.root, ())]
    while work:
        at, path = work.pop()
        for bi, b in enumerate(at.blocks):
            for ci, c in enumerate(b.compounds):
                here = (*path, (bi, ci))
                if c.start == identity:
                    return here
                work.append((c, here))
    raise Refused("unresolved")


MERGED = "source_id string, text string, applied int, demoted int, malformed int, status string"


def merge_sources(docs: DataFrame, edits: DataFrame, schema: Schema | None) -> DataFrame:
    """(source_id, text, applied, demoted, malformed, status) of single-document sources and their edits (source_id, timestamp, agent, edit json).

    Sources and edits are dealt by source and sorted, the source's rows first, so a task folds one document's edits after the
    other. An edit without timestamp or agent, or that is not one, is malformed and passed over. status: merged; no document,
    for edits whose source is absent; repeated source, for each row of sources that share an id, whose text stays as it is. A
    null text is empty.
    """
    kind = T._parse_datatype_string(MERGED)
    arrow = to_arrow_schema(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for source, own in groupby(rows(batches), lambda r: r[0]):
            out += _folded(source, own, schema)
            if len(out) >= 2_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    none = lambda name, t: F.lit(None).cast(t).alias(name)
    mine = docs.select("source_id", F.lit(False).alias("is_edit"), "text", none("timestamp", "long"), none("agent", "string"), none("edit", "string"))
    theirs = edits.select("source_id", F.lit(True).alias("is_edit"), none("text", "string"), F.col("timestamp").try_cast("long").alias("timestamp"), F.col("agent").cast("string").alias("agent"), "edit")
    both = mine.unionByName(theirs)
    return both.repartition(pieces(both), "source_id").sortWithinPartitions("source_id", "is_edit", "timestamp", "agent", "edit").mapInArrow(run, kind)


def _folded(source: str | None, rows: Iterator[tuple], schema: Schema | None) -> list[tuple]:
    """Rows of merge_sources for one source; rows are its texts, then its edits."""
    texts, good, bad = [], [], 0
    for _, is_edit, text, timestamp, agent, edit in rows:
        if not is_edit:
            texts.append(text)
            continue
        try:
            if timestamp is None or agent is None or edit is None:
                raise ValueError("incomplete")
            good.append(Edit.from_json(edit, timestamp, agent))
        except ValueError:
            bad += 1
    if len(texts) != 1:
        return [(source, t, 0, len(good), bad, "repeated source") for t in texts] or [(source, None, 0, len(good), bad, "no document")]
    d = parse(texts[0] or "")
    lost = merge(d, good, schema)
    return [(source, write(d), len(good) - len(lost), len(lost), bad, "merged")]


def last_writes(updates: DataFrame, key: str = "source_id", value: str = "value") -> DataFrame:
    """The surviving value of concurrent updates of one target: the greatest (timestamp, agent). Combined before the shuffle."""
    return updates.groupBy(key).agg(F.max_by(value, F.struct("timestamp", "agent")).alias(value))


def offsets_of(widths: DataFrame, by: list[str], indent: int = 0) -> DataFrame:
    """Minimal offsets as a relation: (by, column, width, heading) rows, width already the greatest of the column."""
    order = Window.partitionBy(*by).orderBy("column")
    step = F.greatest("width", F.col("heading") + 2) + 2
    return widths.withColumn("offset", F.lit(indent) + F.coalesce(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
