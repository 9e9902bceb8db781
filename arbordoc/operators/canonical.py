"""Canonical text: every member a child line, values in the first form that carries them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.letters import to_letters
from ..sources.parser import DEFAULT_SIGIL, PRAGMA, WHITE_SPACE
from .assign import Element

TRAILING = re.compile(rf"[{WHITE_SPACE}](?:\n|\Z)")


def inline_safe(value: str, sigil: str = DEFAULT_SIGIL) -> bool:
    """An empty value is written as a bare keyword, which needs no atom."""
    return "\n" not in value and "  " not in value and value[:1] != " " and value[-1:] != " " and not value.startswith(sigil + " ")


def source_safe(value: str) -> bool:
    return bool(value) and value[0] not in " \n" and value[-1] != "\n" and "\n\n" not in value and not TRAILING.search(value)


def atom_form(value: str, sigil: str = DEFAULT_SIGIL) -> str:
    return "inline" if inline_safe(value, sigil) else "source" if source_safe(value) else "literal"


def delimiter(value: str, indent: int) -> str:
    """Dashes, three or more, so that no line of the value is the delimiter line at that indent."""
    lines, mark = set(value.split("\n")), "---"
    while " " * indent + mark in lines:
        mark += "-"
    return mark


def value_lines(pad: str, keyword: str, value: str, sigil: str = DEFAULT_SIGIL) -> list[str]:
    form = atom_form(value, sigil)
    if form == "inline":
        return [pad + keyword + (("  " if " " in value else " ") + value if value else "")]
    if form == "source":
        return [pad + keyword, *(f"{pad}    {x}" for x in value.split("\n"))]
    mark = f"{pad}      {delimiter(value, len(pad) + 6)}"
    return [pad + keyword, mark, *([value] if value else []), mark]


def canonical_text(root: Element, signature: bytes | None = None, version: tuple[int, int] = (1, 0)) -> str:
    out = [f"{PRAGMA} {version[0]}.{version[1]}" + (" " + to_letters(signature) if signature else "")]
    work = [(c, 0) for c in reversed(root.children)]
    while work:
        e, depth = work.pop()
        pad = "  " * depth
        if e.kind == "scalar":
            out += value_lines(pad, e.keyword, e.text or "")
        else:
            out.append(pad + e.keyword)
            work += [(c, depth + 1) for c in reversed(e.children)]
    return "\n".join(out) + "\n"


# The same as columns.


def is_inline_safe(value: Column, sigil: str = DEFAULT_SIGIL) -> Column:
    return ~(value.contains("\n") | value.contains("  ") | value.startswith(" ") | value.endswith(" ") | value.startswith(sigil + " "))


def is_source_safe(value: Column) -> Column:
    spaces = WHITE_SPACE.replace("\n", "")
    return (F.length(value) > 0) & ~(value.startswith(" ") | value.startswith("\n") | value.endswith("\n") | value.contains("\n\n") | value.rlike(rf"[{spaces}](?:\n|\z)"))


def form_of(value: Column, sigil: str = DEFAULT_SIGIL) -> Column:
    return F.when(is_inline_safe(value, sigil), "inline").when(is_source_safe(value), "source").otherwise("literal")


def delimiter_of(value: Column, indent: Column) -> Column:
    """One dash more than the longest run of three and more that makes up a whole line at that indent, else three."""
    lines = F.split(value, "\n")
    # what is left of a colliding line is dashes alone; the first length without a collision is wanted
    dashes = F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"\A *-{3,}\z")) & (F.length(x) - F.length(F.ltrim(x)) == indent)), lambda x: F.length(F.ltrim(x)))
    first = F.aggregate(F.array_sort(F.array_distinct(dashes)), F.lit(3), lambda n, d: F.when(d == n, n + 1).otherwise(n))
    return F.repeat(F.lit("-"), first)


def lines_of(pad: Column, keyword: Column, value: Column, sigil: str = DEFAULT_SIGIL) -> Column:
    """An element's canonical lines, joined by line feeds; value is null for elements without one."""
    gap = F.when(value.contains(" "), "  ").otherwise(" ")
    head = F.concat(pad, keyword)
    deep = F.concat(pad, F.lit("    "))
    mark = F.concat(pad, F.lit("      "), delimiter_of(value, F.length(pad) + 6))
    source = F.concat(head, F.lit("\n"), deep, F.replace(value, F.lit("\n"), F.concat(F.lit("\n"), deep)))
    literal = F.concat_ws("\n", head, mark, F.when(value != "", value), mark)
    inline = F.when(value == "", head).otherwise(F.concat(head, gap, value))
    return F.when(value.isNull(), head).otherwise(F.when(is_inline_safe(value, sigil), inline).when(is_source_safe(value), source).otherwise(literal))


def canonical_documents(elements: DataFrame, signature: bytes | None = None) -> DataFrame:
    """(source_id, doc_ord, text) of an elements table: a line column, and one ordered concatenation per document.

    The exchange is by document; a document must fit in a row, as it does in the elements' source.
    """
    head = f"{PRAGMA} 1.0" + (" " + to_letters(signature) if signature else "")
    known = elements.where((F.col("kind") != "unknown") & (F.col("elem_id") > 0))
    line = lines_of(F.repeat(F.lit("  "), F.col("depth") - 1), F.col("keyword"), F.when(F.col("kind") == "scalar", F.coalesce("text", F.lit(""))))
    body = known.select("source_id", "doc_ord", F.struct("elem_id", line.alias("line")).alias("l")).groupBy("source_id", "doc_ord").agg(F.sort_array(F.collect_list("l")).alias("l"))
    roots = elements.where("elem_id = 0").select("source_id", "doc_ord")
    text = F.concat(F.array_join(F.concat(F.array(F.lit(head)), F.coalesce(F.transform("l", lambda x: x["line"]), F.array().cast("array<string>"))), "\n"), F.lit("\n"))
    return roots.join(body, ["source_id", "doc_ord"], "left").select("source_id", "doc_ord", text.alias("text"))
