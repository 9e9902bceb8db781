"""What tools show of documents: reports, outlines, completions, and edits offered only if the model stays the same."""

from __future__ import annotations

from collections.abc import Container, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import Schema
from ..sources.parser import MESSAGES, Atom, Block, Compound, Document, parse, parse_stream, write
from .assign import assign
from .binary import CannotEncode, encode_root
from .canonical import inline_safe
from .edits import copied


def report(errors: DataFrame) -> DataFrame:
    """(source_id, doc_ord, n, line): one line a problem, in order of document and span within a source."""
    line = F.concat_ws(" ", F.concat(F.col("source_id"), F.lit("#"), F.col("doc_ord")), F.concat(F.lit("["), F.col("span_start"), F.lit(","), F.col("span_end"), F.lit(")")), F.col("code"), F.col("message"))
    ordered = F.array_sort(F.collect_list(F.struct("span_start", "span_end", "code", line.alias("line"))))
    return errors.groupBy("source_id", "doc_ord").agg(ordered.alias("all")).select("source_id", "doc_ord", F.posexplode("all").alias("n", "x")).select("source_id", "doc_ord", "n", "x.line")


def snapshot(compounds: DataFrame) -> DataFrame:
    """Each compound as JSON, for debugging."""
    return compounds.select("source_id", "doc_ord", "node_id", F.to_json(F.struct("keyword", "atoms", "remark", "depth")).alias("json"))


def outline(compounds: DataFrame) -> DataFrame:
    """(source_id, doc_ord, node_id, depth, label, last_node): a compound, what it is called and the last node it folds in."""
    ends = compounds.groupBy("source_id", "doc_ord", "parent_id").agg(F.max("node_id").alias("last_child"))
    label = F.concat_ws(" ", F.col("keyword"), F.get(F.col("atoms"), 0)["text"])
    c = compounds.alias("c").join(ends.withColumnRenamed("parent_id", "node_id"), ["source_id", "doc_ord", "node_id"], "left")
    return c.select("source_id", "doc_ord", "node_id", "depth", label.alias("label"), F.coalesce("last_child", "node_id").alias("last_node"))


def first_by_keyword(compounds: DataFrame, keyword: str) -> DataFrame:
    """(source_id, doc_ord, parent_id, node_id, atoms): the first child of that keyword below each parent; the root is parent 0."""
    own = compounds.where(F.col("keyword") == keyword).groupBy("source_id", "doc_ord", "parent_id")
    return own.agg(F.min("node_id").alias("node_id"), F.min_by("atoms", "node_id").alias("atoms"))


def completions(schema: Schema, path: list[str], prefix: str = "") -> list[str]:
    """Keywords that may stand below the compound reached by keywords, in keyword order."""
    at = ""
    for k in path:
        entry = schema.keywords(at).get(k)
        if entry is None or entry.kind != "struct":
            return []
        at = entry.type
    return [e.keyword for e in schema.entries(at) if e.keyword.startswith(prefix)]


def describe(schema: Schema, path: list[str]) -> str | None:
    """The description of the field a path of keywords ends at."""
    at, found = "", None
    for k in path:
        entry = schema.keywords(at).get(k)
        if entry is None:
            return None
        m = schema.struct(at).members[entry.member]
        found = m.description or next((d.description for d in (*schema.records, *schema.scalars, *schema.selects) if d.name == entry.type), None)
        at = entry.type
    return found


def same_model(a: str, b: str, schema: Schema) -> bool:
    """Whether two texts type to the same model without errors."""
    model = model_of(a, schema)
    return model is not None and model == model_of(b, schema)


def model_of(text: str, schema: Schema) -> bytes | None:
    """A text's model as bytes; None where it has errors or no encoding."""
    d = parse(text)
    root, errors = assign(d, schema)
    if d.errors or errors:
        return None
    try:
        return encode_root(root, schema)
    except CannotEncode:
        return None


def expand_last_atom(doc: Document, target: Compound, schema: Schema, model: bytes | None = None) -> Document | None:
    """The target's last inline atom as a child line of its own, where the model stays the same; else None. model: the document's, where it is known."""
    return _verified(doc, target, schema, _expand, model)


def inline_first_child(doc: Document, target: Compound, schema: Schema, model: bytes | None = None) -> Document | None:
    """The inverse: the target's first child, a plain value, as its last inline atom."""
    return _verified(doc, target, schema, _inline, model)


def _verified(doc: Document, target: Compound, schema: Schema, change, model: bytes | None) -> Document | None:
    path = _path_to(doc.root, target)
    # a child that the target's type does not have is an error, so no such keyword is tried
    keywords = [k for k in change(None, schema, target) or [] if k in _admitted(doc.root, path, schema)]
    if not keywords or (model := model_of(write(doc), schema) if model is None else model) is None:
        return None
    for keyword in keywords:
        new = copied(doc)
        at = new.root
        for b, c in path:
            at = at.blocks[b].compounds[c]
        change(at, schema, keyword)
        if model == model_of(write(new), schema):
            return new
    return None


def _admitted(root: Compound, path: list[tuple[int, int]], schema: Schema) -> Container[str]:
    """The keywords that may stand below the compound at a path; none where it is no struct."""
    at, keywords = root, schema.keywords("")
    for b, c in path:
        at = at.blocks[b].compounds[c]
        entry = keywords.get(at.keyword)
        if entry is None or entry.kind != "struct":
            return ()
        keywords = schema.keywords(entry.type)
    return keywords


def _path_to(root: Compound, target: Compound) -> list[tuple[int, int]]:
    work: list[tuple[Compound, list]] = [(root, [])]
    while work:
        at, path = work.pop()
        if at is target:
            return path
        work += [(c, [*path, (i, j)]) for i, b in enumerate(at.blocks) for j, c in enumerate(b.compounds)]
    raise LookupError("not in the document")


def _expand(at: Compound | None, schema: Schema, what):
    if at is None:
        return sorted({e.keyword for s in schema.structs() for e in schema.entries(s.name)}) if what.atoms and what.atoms[-1].form == "inline" else []
    atom = at.atoms.pop()
    atom.spaces = 2 if " " in atom.text else 1
    flag = Compound(what, [] if atom.text == what else [atom])
    if at.blocks and at.blocks[0].offsets is None:
        at.blocks[0].compounds.insert(0, flag)
    else:
        at.blocks.insert(0, Block(compounds=[flag]))
    return None


def _inline(at: Compound | None, schema: Schema, what):
    if at is None:
        first = next(what.children(), None)
        plain = first is not None and not list(first.children()) and len(first.atoms) <= 1 and all(a.form == "inline" and inline_safe(a.text) for a in first.atoms)
        return [first.keyword] if plain else []
    first = at.blocks[0].compounds.pop(0)
    if not at.blocks[0].compounds:
        at.blocks.pop(0)
    text = first.atoms[0].text if first.atoms else first.keyword
    at.atoms.append(Atom("inline", text, 2 if " " in text or any(a.spaces > 1 for a in at.atoms) else 1))
    return None


def problems(text: str, schema: Schema | None) -> Iterator[str]:
    """One line a problem of a text's documents, in order."""
    for i, d in enumerate(parse_stream(text, schema.admits if schema else None)):
        found = d.errors + (assign(d, schema)[1] if schema else [])
        for e in sorted(found, key=lambda e: (e.start, e.end, e.code)):
            yield f"{i} [{e.start},{e.end}) {e.code} {MESSAGES.get(e.code, '')}".rstrip()


def chain_at(doc: Document, offset: int) -> list[Compound]:
    """The compounds around an offset, outermost first: at each level the last one that starts at or before it."""
    out: list[Compound] = []
    at = doc.root
    while (inner := [c for c in at.children() if c.start <= offset]):
        at = max(inner, key=lambda c: c.start)
        out.append(at)
    return out


def every_compound(root: Compound) -> Iterator[Compound]:
    work = [root]
    while work:
        c = work.pop()
        yield c
        work += list(c.children())[::-1]


def word_at(text: str, offset: int) -> str:
    """The run of characters without spaces and line ends around an offset."""
    begin = max(text.rfind(" ", 0, offset), text.rfind("\n", 0, offset)) + 1
    ends = [x for x in (text.find(" ", offset), text.find("\n", offset)) if x >= 0]
    return text[begin : min(ends, default=len(text))]


#: (ranges, keywords, highlights, completions, description, definition), as the columns of documents.positions.
Position = tuple[list[int], list[str], list[int], list[str], str | None, int | None]


def position(text: str, offset: int, schema: Schema) -> Position:
    """What a tool shows at an offset of a document.

    ranges: starts of the compounds around it, outermost first; highlights: starts of all compounds with the innermost one's
    keyword; completions: keywords that may stand beside the innermost one; description: its field's; definition: where
    the type that the word names is declared, in a schema document.
    """
    doc = parse(text, schema.admits)
    around = chain_at(doc, offset)
    keywords = [c.keyword for c in around]
    every = list(every_compound(doc.root))[1:]
    word = word_at(text, offset)
    declared = next((c.start for c in every if c.keyword in ("record", "scalar", "select") and c.atoms and c.atoms[0].text == word and list(c.children())), None)
    highlights = [c.start for c in every if keywords and c.keyword == keywords[-1]]
    return [c.start for c in around], keywords, sorted(highlights), completions(schema, keywords[:-1]), describe(schema, keywords) if keywords else None, declared
