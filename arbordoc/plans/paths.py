"""Paths into typed documents: parsing, schema-directed compilation to columns, and per-document resolution.

Whether a component is a keyword or a selector depends on the schema alone. What the schema can tell is found once, when
a path is compiled; absent members, indices out of range and unknown keys are outcomes of each document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.assign import Element
from .schema import Schema

# Fixed value of the format.
DELIMITERS = '!"#$%&*+,./:;=?@\\^_`|~'


class PathError(ValueError):
    """A failure that needs no document; kind and index of the component."""

    def __init__(self, kind: str, component: int):
        super().__init__(f"{kind} at component {component}")
        self.kind, self.component = kind, component


def components(path: str) -> list[str]:
    if not path or path[0] not in DELIMITERS or "\n" in path or "\r" in path:
        raise PathError("syntax", 0)
    if len(path) == 1:
        return []
    parts = path[1:].split(path[0])
    if "" in parts:
        raise PathError("syntax", parts.index(""))
    return parts


def same_path(a: str, b: str) -> bool:
    return components(a) == components(b)


def components_column(path: Column) -> Column:
    """The components of a path column; null where it is no path."""
    parts = F.when(F.length(path) > 1, F.split(F.substring(path, 2, 1 << 30), F.concat(F.lit("\\Q"), F.substring(path, 1, 1), F.lit("\\E")))).otherwise(F.array().cast("array<string>"))
    good = F.substring(path, 1, 1).isin(*DELIMITERS) & ~F.contains(path, F.lit("\n")) & ~F.contains(path, F.lit("\r")) & ~F.array_contains(parts, "")
    return F.when(good, parts)


def same_path_column(a: Column, b: Column) -> Column:
    """Whether two path columns have the same components; null where one is no path."""
    return components_column(a) == components_column(b)


@dataclass(frozen=True)
class Step:
    """child: the single child of a keyword; all: the occurrences of one; index and key select among occurrences."""

    kind: str
    keyword: str
    component: int
    index: int = 0
    key: str = ""
    key_keyword: str = ""


def is_index(c: str) -> bool:
    return c.isascii() and c.isdigit()


def compile_path(path: str, schema: Schema, context: str = "") -> list[Step]:
    """Steps for elements of a context type. PathError for what no document can change."""
    steps: list[Step] = []
    at, kind, pending = context, "struct", None
    for i, c in enumerate(components(path)):
        if pending:
            keyword, pending = pending.keyword, None
            if is_index(c):
                steps[-1] = Step("index", keyword, i, index=int(c))
            else:
                key = schema.key_member(at) if kind == "struct" else None
                if key is None:
                    raise PathError("type not keyed", i)
                steps[-1] = Step("key", keyword, i, key=c, key_keyword=key.keyword or "")
            continue
        if kind != "struct":
            raise PathError("non-struct descent", i)
        entry = schema.keywords(at).get(c)
        if entry is None:
            raise PathError("unknown keyword", i)
        repeatable = schema.struct(at).members[entry.member].is_repeatable
        at, kind = entry.type, entry.kind
        steps.append(Step("all" if repeatable else "child", c, i))
        pending = entry if repeatable else None
    return steps


@dataclass(frozen=True)
class Outcome:
    status: str  # element, occurrences, or a failure's kind
    component: int | None = None
    elements: tuple[Element, ...] = ()


def resolve(path: str, schema: Schema, root: Element) -> Outcome:
    """A path in one document, from any struct element of it."""
    try:
        steps = compile_path(path, schema, root.type)
    except PathError as e:
        return Outcome(e.kind, e.component)
    at = root
    for s in steps:
        own = [c for c in at.children if c.keyword == s.keyword]
        if s.kind == "all":
            return Outcome("occurrences", None, tuple(own))
        if s.kind == "child" and not own:
            return Outcome("absent member", s.component)
        if s.kind == "index" and s.index >= len(own):
            return Outcome("index out of range", s.component)
        if s.kind == "key":
            own = [c for c in own if any(k.keyword == s.key_keyword and k.text == s.key for k in c.children)][:1]
            if not own:
                return Outcome("key not found", s.component)
        at = own[s.index if s.kind == "index" else 0]
    return Outcome("element", None, (at,))


#: Why a step may find nothing.
MISSING = {"child": "absent member", "index": "index out of range", "key": "key not found"}


def select_path(elements: DataFrame, path: str, schema: Schema) -> DataFrame:
    """(source_id, doc_ord, status, failed_component, elem_id, occurrence, text) of a path over an elements table.

    One equi-join by parent and one filter a step; occurrences are counted by windows over a parent's children of
    one keyword. A path that ends at a repeatable keyword gives a row per occurrence, and one without elem_id where there is
    none. Static failures are the same for every document and read no children.
    """
    doc = ["source_id", "doc_ord"]
    roots = elements.where("elem_id = 0").select(*doc)
    shape = lambda status, component: roots.select(*doc, F.lit(status).alias("status"), F.lit(component).cast("int").alias("failed_component"), F.lit(None).cast("int").alias("elem_id"), F.lit(None).cast("int").alias("occurrence"), F.lit(None).cast("string").alias("text"))
    try:
        steps = compile_path(path, schema)
    except PathError as e:
        return shape(e.kind, e.component)
    known = elements.where(F.col("kind") != "unknown").select(*doc, "elem_id", "parent_id", "keyword", "sib_ord", "text", "key_value")
    at = roots.select(*doc, F.lit(0).alias("elem_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("failed"), F.lit(None).cast("int").alias("occurrence"))
    for s in steps:
        own = known.where(F.col("keyword") == s.keyword)
        if s.kind == "key":
            own = own.where(F.col("key_value") == s.key)
        order = Window.partitionBy(*doc, "parent_id").orderBy("sib_ord")
        own = own.withColumn("n", F.row_number().over(order) - 1)
        if s.kind != "all":
            own = own.where(F.col("n") == (s.index if s.kind == "index" else 0))
        own = own.select(*doc, F.col("parent_id").alias("p"), F.col("elem_id").alias("e"), F.col("text").alias("t"), "n")
        joined = at.join(own, [*(at[c] == own[c] for c in doc), at["elem_id"] == own["p"]], "left").select(*(at[c] for c in doc), at["elem_id"], at["status"], at["failed"], own["e"], own["t"], own["n"], at["text"])
        lost = F.col("e").isNull() & F.col("status").isNull()
        status = F.lit("occurrences") if s.kind == "all" else F.when(lost, MISSING[s.kind]).otherwise(F.col("status"))
        failed = F.col("failed") if s.kind == "all" else F.when(lost, s.component).otherwise(F.col("failed"))
        if s.kind == "all":
            status = F.coalesce(F.col("status"), status)
        at = joined.select(*doc, F.col("e").alias("elem_id"), F.col("t").alias("text"), status.alias("status"), failed.cast("int").alias("failed"), F.col("n").cast("int").alias("occurrence"))
    ends_open = bool(steps) and steps[-1].kind == "all"
    return at.select(*doc, F.coalesce("status", F.lit("element")).alias("status"), F.col("failed").alias("failed_component"), F.col("elem_id").cast("int").alias("elem_id"), (F.col("occurrence") if ends_open else F.lit(None).cast("int")).alias("occurrence"), "text")


def member_column(node: Column, path: str, schema: Schema) -> Column:
    """The same over wide typed structs (fields by keyword; arrays for repeatable members), for schemas without cycles."""
    for s in compile_path(path, schema):
        own = node[s.keyword]
        if s.kind == "index":
            own = F.get(own, s.index)
        elif s.kind == "key":
            own = F.get(F.filter(own, _keyed(s.key_keyword, s.key)), 0)
        node = own
    return node


def _keyed(keyword: str, key: str):
    return lambda x: x[keyword] == key
