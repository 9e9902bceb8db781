"""Tree-document parser: text to documents with blocks, compounds, atoms and located errors.

The parser keeps a stack of open levels and gives each line to the level of its indent. Every error is recorded with a
code and a half-open span of code points, and parsing goes on; nothing raises on bad input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..functions.letters import ALPHABET

# Fixed values of the format.
PRAGMA = "tel"
SIGILS = "!\"#$%&'*,-./:;=?@\\^_`|~"
DEFAULT_SIGIL = "#"
PRAGMA_WINDOW = 4096
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
MESSAGES = {
    "E101": "byte order mark at the start",
    "E102": "the pragma is not the first non-blank line",
    "E103": "the pragma line reaches beyond the first 4096 bytes",
    "E104": "bad pragma version",
    "E105": "bad sigil character",
    "E106": "line does not begin with the margin",
    "E107": "odd indentation",
    "E108": "trailing spaces",
    "E109": "comment must follow a blank line, a comment or a line of lesser indent",
    "E111": "line is indented too far",
    "E112": "comments, tabulations and rows have no children",
    "E113": "a second block atom where a source atom begins",
    "E114": "a second block atom where a literal atom begins",
    "E115": "literal atom is not closed",
    "E116": "row is indented unlike its tabulation",
    "E117": "hard space does not end at a column",
    "E118": "value is wider than its column",
    "E119": "malformed column heading",
    "E120": "inconsistent line ending",
    "E121": "phrase matches no pragma form",
    "E122": "pragma phrase out of order",
    "E123": "not well-formed UTF-8",
    "E124": "layers are not in declaration order",
}

VERSION = re.compile(r"[0-9]+\.[0-9]+")
_LABEL = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_NAME = r"[a-z](?:-?[a-z0-9])*"
REFERENCE = re.compile(rf"(?P<domain>{_LABEL}(?:\.{_LABEL})+)/(?P<module>{_NAME}(?:[/.]{_NAME})*)(?::(?P<selector>(?:0|[1-9][0-9]*)\.(?:0|[1-9][0-9]*)\.(?:0|[1-9][0-9]*)|[A-Za-z][A-Za-z0-9.-]*))?")
LAYER = re.compile(rf"'*{_NAME}")


@dataclass(slots=True)
class Error:
    code: str
    start: int
    end: int


@dataclass(slots=True)
class Atom:
    form: str  # inline, source or literal
    text: str
    spaces: int = 0
    delimiter: str | None = None


@dataclass(slots=True)
class Compound:
    keyword: str
    atoms: list[Atom] = field(default_factory=list)
    remark: str | None = None
    blocks: list[Block] = field(default_factory=list)
    start: int = 0

    def children(self) -> Iterator[Compound]:
        return (c for b in self.blocks for c in b.compounds)


@dataclass(slots=True)
class Block:
    comments: list[str] = field(default_factory=list)
    offsets: list[int] | None = None
    headings: list[str] = field(default_factory=list)
    compounds: list[Compound] = field(default_factory=list)
    blanks: int = 0

    def used(self) -> bool:
        return bool(self.comments or self.compounds or self.offsets)


@dataclass(slots=True)
class Pragma:
    version: tuple[int, int] | None = None
    reference: str | None = None
    layers: list[str] = field(default_factory=list)
    signature: str | None = None
    sigil: str | None = None


@dataclass(slots=True)
class Document:
    directive: str | None = None
    pragma: Pragma | None = None
    line_endings: str = "LF"
    sigil: str = DEFAULT_SIGIL
    margin: int = 0
    root: Compound = field(default_factory=lambda: Compound(""))
    errors: list[Error] = field(default_factory=list)


def is_signature(phrase: str) -> bool:
    n = len(phrase)
    return (n == 33 or n >= 37 and n % 2 == 1) and all(c in ALPHABET for c in phrase)


def decode_bytes(data: bytes) -> tuple[str, list[Error]]:
    """Text with one replacement character, and one error, for each maximal ill-formed part."""
    if (text := data.decode("utf-8", "replace")).find("�") < 0:
        return text, []
    errors, parts, at = [], [], 0
    while at < len(data):
        try:
            parts.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            parts.append(data[at : at + e.start].decode() + "�")
            n = sum(map(len, parts))
            errors.append(Error("E123", n - 1, n))
            at += e.end
    return "".join(parts), errors


class Level:
    """The children of one compound while they are read."""

    __slots__ = ("block", "depth", "owner", "previous")

    def __init__(self, owner: Compound, depth: int):
        self.owner, self.depth, self.block, self.previous = owner, depth, Block(), "start"

    def close_block(self) -> None:
        if self.block.used():
            self.owner.blocks.append(self.block)
        self.block = Block()

    def blank(self, n: int) -> None:
        """n blank lines stand before the next line of this level."""
        if n and self.block.used():
            self.block.blanks = n
            self.close_block()
        if n:
            self.previous = "blank"


class Parser:
    def __init__(self, text: str, admits: Callable[[list[str], str], bool] | None = None):
        self.text, self.admits = text, admits
        self.source_errors: list[Error] = []
        base = 0
        if text.startswith("﻿"):
            self.source_errors.append(Error("E101", 0, 3))
            base = 1
        self.lines = (text[base:] if base else text).split("\n")
        self.plain = "\r" not in text  # then no line ending needs a check
        self.crlf = len(self.lines) > 1 and self.lines[0].endswith("\r")
        if not self.lines[-1] and len(self.lines) > 1:
            self.lines.pop()  # a final line feed ends the last line
        self.n = len(self.lines)
        self.starts, at = [], base
        for line in self.lines:
            self.starts.append(at)
            at += len(line) + 1
        self.errors: list[Error] = []
        self.checked = -1

    def raw(self, i: int) -> str:
        return self.lines[i]

    def line(self, i: int) -> str:
        """A line's content; its ending is checked the first time it is read in order."""
        if self.plain:
            return self.lines[i]
        raw, start = self.raw(i), self.starts[i]
        ended = start + len(raw) < len(self.text)
        own = ended and raw.endswith("\r")
        if i > self.checked:
            self.checked = i
            body = raw[:-1] if own else raw
            if own != self.crlf and ended:
                at = start + len(raw)
                self.errors.append(Error("E120", at - 1 if own else at, at if own and not self.crlf else at + 1))
            self.errors += [Error("E120", start + m.start(), start + m.end()) for m in re.finditer("\r", body)]
        return raw[:-1] if own else raw

    def documents(self) -> Iterator[Document]:
        at, first = 0, True
        while first or at < self.n:
            if not first and all(not self.raw(i).strip(" \r") for i in range(at, self.n)):
                return
            self.errors = list(self.source_errors) if first else []
            document, at = self.document(at)
            first = False
            yield document

    def document(self, at: int) -> tuple[Document, int]:
        doc = Document(line_endings="CRLF" if self.crlf else "LF")
        begin = at
        if at < self.n and self.raw(at).startswith("#!"):
            doc.directive = self.line(at)[2:]
            at += 1
        first = next((i for i in range(at, self.n) if self.raw(i).strip(" \r")), None)
        if first is not None and self.is_pragma(first):
            for i in range(at, first + 1):
                content = self.line(i)
            self.pragma(doc, first, content, begin)
            at = first + 1
        elif (misplaced := self.misplaced(at)) is not None:
            # the document is read with what the misplaced line says, and that line is passed over
            self.errors.append(Error("E102", self.starts[misplaced] + self.indent_of(self.raw(misplaced)), self.starts[misplaced] + self.indent_of(self.raw(misplaced)) + len(PRAGMA)))
            self.pragma(doc, misplaced, self.raw(misplaced).rstrip("\r"), begin)
            return self.body(doc, at, misplaced)
        return self.body(doc, at, None)

    @staticmethod
    def indent_of(line: str) -> int:
        return len(line) - len(line.lstrip(" "))

    def is_pragma(self, i: int) -> bool:
        words = self.raw(i).strip(" \r").split(" ", 1)
        return words[0] == PRAGMA

    def misplaced(self, at: int) -> int | None:
        """A later pragma line: at indent 0, outside block atoms, before the end of the document."""
        probe = Parser.__new__(Parser)
        probe.text, probe.admits, probe.starts, probe.n, probe.crlf = self.text, None, self.starts, self.n, self.crlf
        probe.lines, probe.plain = self.lines, self.plain
        probe.errors, probe.checked, probe.source_errors = [], -1, []
        if PRAGMA not in self.text or not any(self.is_pragma(i) for i in range(at, self.n)):
            return None
        doc = Document()
        probe.body(doc, at, None)
        found = next((c for c in doc.root.children() if c.keyword == PRAGMA), None)
        if found is None:
            return None
        return next(i for i in range(self.n) if i + 1 == self.n or self.starts[i + 1] > found.start)

    def pragma(self, doc: Document, i: int, content: str, begin: int) -> None:
        start, end = self.starts[i], self.starts[i] + len(content)
        if len(self.text[self.starts[begin] : end].encode("utf-8", "surrogatepass")) > PRAGMA_WINDOW:
            self.errors.append(Error("E103", start, end))
        phrases = [(m.start(), m[0]) for m in re.finditer("[^ ]+", content)][1:]
        doc.pragma = pragma = Pragma()
        if phrases and VERSION.fullmatch(phrases[0][1]):
            major, minor = phrases.pop(0)[1].split(".")
            pragma.version = int(major), int(minor)
        elif phrases:
            at, bad = phrases[0]
            self.errors.append(Error("E104", start + at, start + at + len(bad)))
            if not (bad.startswith("+") or "/" in bad):
                phrases.pop(0)
        else:
            at = self.indent_of(content)
            self.errors.append(Error("E104", start + at, start + at + len(PRAGMA)))
        rank, faults = 0, set()  # a fault of the pragma line is recorded once, however many phrases have it
        for k, (_, phrase) in enumerate(phrases):
            form = self.form(phrase, k + 1 == len(phrases))
            if form == 0:
                faults.add("E121")
            elif form < rank or form == rank and form != 2:
                faults.add("E122")
            else:
                rank = form
                if form == 1:
                    pragma.reference = phrase
                elif form == 2:
                    pragma.layers.append(phrase[1:])
                elif form == 3:
                    pragma.signature = phrase
                elif phrase in SIGILS:
                    pragma.sigil = doc.sigil = phrase
                else:
                    faults.add("E105")
        self.errors += [Error(code, start, end) for code in sorted(faults)]

    @staticmethod
    def form(phrase: str, final: bool) -> int:
        """1 reference, 2 layer, 3 signature, 4 sigil, 0 none."""
        if phrase.startswith("+"):
            return 2 if LAYER.fullmatch(phrase[1:]) else 0
        if "/" in phrase and len(phrase) > 1:
            return 1 if REFERENCE.fullmatch(phrase) else 0
        if is_signature(phrase):
            return 3
        return 4 if final and len(phrase) == 1 else 0

    def body(self, doc: Document, at: int, skip: int | None) -> tuple[Document, int]:
        self.sigil = doc.sigil
        lines = (i for i in range(at, self.n) if i != skip)
        first = next((i for i in lines if self.raw(i).strip(" \r")), None)
        self.margin = doc.margin = 0 if doc.directive is not None or first is None else self.indent_of(self.raw(first))
        stack = [Level(doc.root, 0)]
        blanks = 0
        i = at
        while i < self.n:
            if i == skip:
                i += 1
                continue
            content = self.line(i)
            if content == self.sigil * 2:
                self.settle(stack, 0, blanks)
                self.finish(stack)
                doc.errors = sorted(self.errors, key=lambda e: (e.start, e.end, e.code))
                return doc, i + 1
            if not content.strip(" "):
                blanks += 1
                i += 1
                continue
            indent, body = self.measure(i, content, stack)
            i = self.place(stack, i, content, indent, body, blanks)
            blanks = 0
        if blanks and stack[-1].block.used():
            stack[-1].block.blanks = blanks
        self.finish(stack)
        doc.errors = sorted(self.errors, key=lambda e: (e.start, e.end, e.code))
        return doc, self.n

    def measure(self, i: int, content: str, stack: list[Level]) -> tuple[int, str]:
        spaces = self.indent_of(content)
        start = self.starts[i]
        body = content[spaces:]
        if spaces < self.margin:
            self.errors.append(Error("E106", start, start + spaces))
            return 0, body
        spaces -= self.margin
        if spaces % 2:
            self.errors.append(Error("E107", start, start + self.margin + spaces))
            indent = spaces // 2
            if self.admits:
                keyword = body.split(" ", 1)[0]
                shallow, deep = self.path(stack, indent), self.path(stack, indent + 1)
                if not (shallow is not None and self.admits(shallow, keyword)) and deep is not None and self.admits(deep, keyword):
                    indent += 1
            return indent, body
        return spaces // 2, body

    @staticmethod
    def path(stack: list[Level], depth: int) -> list[str] | None:
        """Keywords down to the compound whose children stand at depth; None where it is not open."""
        if depth < len(stack):
            return [level.owner.keyword for level in stack[1 : depth + 1]]
        last = stack[-1].block.compounds[-1:] or [c for b in stack[-1].owner.blocks for c in b.compounds][-1:]
        if depth == len(stack) and last and stack[-1].block.offsets is None:
            return [level.owner.keyword for level in stack[1:]] + [last[0].keyword]
        return None

    @staticmethod
    def settle(stack: list[Level], depth: int, blanks: int) -> None:
        while len(stack) - 1 > depth:
            stack.pop().close_block()
        stack[-1].blank(blanks)

    @staticmethod
    def finish(stack: list[Level]) -> None:
        while stack:
            stack.pop().close_block()

    def place(self, stack: list[Level], i: int, content: str, indent: int, body: str, blanks: int) -> int:
        """Gives line i to its level and returns the next line."""
        start = self.starts[i]
        depth = len(stack) - 1
        top = stack[-1]
        if top.block.offsets is not None and not blanks and indent != depth:
            if indent > depth and top.previous == "row":
                self.errors.append(Error("E112", start, start))
            else:
                self.errors.append(Error("E116", start, start + self.margin + 2 * indent))
            return i + 1
        if indent > depth:
            top.blank(blanks)
            if top.previous in ("comment", "tabulation") or blanks and top.block.comments and not top.block.compounds:
                self.errors.append(Error("E112", start, start))
                return i + 1
            last = next((b.compounds[-1] for b in [top.block, *top.owner.blocks[::-1]] if b.compounds and b.offsets is None), None)
            if last is None or indent > depth + 1 or top.owner.blocks and top.block.used() is False and top.owner.blocks[-1].offsets is not None:
                self.errors.append(Error("E111", start, start + self.margin + 2 * indent))
                return i + 1
            if blanks:  # blank lines before a first child do not close the parent's block
                top.block = top.owner.blocks.pop()
                top.block.blanks, top.previous = 0, "compound"
            stack.append(Level(last, depth + 1))
            top = stack[-1]
        else:
            if blanks or indent < depth:
                self.settle(stack, indent, blanks)
                top = stack[-1]
        at = start + len(content) - len(body)
        if body[0] == self.sigil and (marks := self.markers(body)):
            if top.block.offsets is not None or top.block.compounds:
                top.close_block()
            shift = len(content) - len(body) - self.margin
            top.block.offsets = [m + shift for m in marks]
            top.block.headings = self.headings(body, marks, at)
            top.previous = "tabulation"
            return i + 1
        if body[0] == self.sigil and (len(body) == 1 or body[1] == " "):
            if top.previous not in ("start", "blank", "comment"):
                self.errors.append(Error("E109", start, start))
            top.block.comments.append(body[2:])
            top.previous = "comment"
            return i + 1
        trimmed = body.rstrip(" ")
        if len(trimmed) < len(body):
            self.errors.append(Error("E108", at + len(trimmed), at + len(body)))
        compound = self.compound(trimmed, at)
        row = top.block.offsets is not None
        if row:
            self.check_row(body, at, len(content) - len(body) - self.margin, top.block.offsets)
        top.block.compounds.append(compound)
        top.previous = "row" if row else "compound"
        return i + 1 if row else self.block_atoms(compound, i + 1, indent)

    def compound(self, body: str, at: int) -> Compound:
        if "  " not in body and self.sigil + " " not in body:
            keyword, *texts = body.split(" ")
            return Compound(keyword, [Atom("inline", x, 1) for x in texts], start=at)
        keyword = body.split(" ", 1)[0]
        out = Compound(keyword, start=at)
        i, hard = len(keyword), False
        while i < len(body):
            begin = i
            while body[i] == " ":
                i += 1
            spaces = i - begin
            hard |= spaces > 1
            if self.introduces_remark(body, i):
                out.remark = body[i + 2 :]
                break
            end = body.find("  " if hard else " ", i)
            end = len(body) if end < 0 else end
            out.atoms.append(Atom("inline", body[i:end], spaces))
            i = end
        return out

    def introduces_remark(self, body: str, i: int) -> bool:
        return body[i] == self.sigil and body[i + 1 : i + 2] == " " and body[i + 2 : i + 3] not in ("", " ")

    def markers(self, body: str) -> list[int] | None:
        """Offsets of a tabulation line's markers within its body, or None for other lines."""
        if body[0] != self.sigil:
            return None
        found = [m.start() + 2 for m in re.finditer("  (?=" + re.escape(self.sigil) + ")", body)]
        return [0, *found] if found else None

    def headings(self, body: str, marks: list[int], at: int) -> list[str]:
        out = []
        for k, m in enumerate(marks):
            end = marks[k + 1] if k + 1 < len(marks) else len(body)
            part = body[m + 1 : end]
            heading = part.strip(" ")
            if not part.strip(" ") and (k + 1 < len(marks) or not part):
                out.append("")
            elif part.startswith(" ") and not part.startswith("  ") and "  " not in part[1:].rstrip(" ") and self.sigil not in heading and (k + 1 < len(marks) or not part.endswith(" ")):
                out.append(heading)
            else:
                self.errors.append(Error("E119", at + m, at + end))
                out.append("")
        return out

    def check_row(self, body: str, at: int, shift: int, offsets: list[int]) -> None:
        used = len(body.rstrip(" "))
        for run in re.finditer("  +", body):
            if run.end() < len(body) and self.introduces_remark(body, run.end()):
                break
            end = run.end() + shift
            if run.start() >= used:  # trailing spaces end at no column either
                self.errors.append(Error("E117", at + run.start(), at + run.end()))
                break
            if end not in offsets[1:]:
                self.errors.append(Error("E117", at + run.start(), at + run.end()))
                continue
            column = offsets.index(end, 1)
            stop = body.find("  ", run.end())
            width = (used if stop < 0 else stop) - run.end()
            if column + 1 < len(offsets) and width > offsets[column + 1] - end - 2:
                self.errors.append(Error("E118", at + run.end(), at + run.end() + width))

    def block_atoms(self, compound: Compound, i: int, indent: int) -> int:
        """Source and literal atoms right below a compound line; the first one counts."""
        least = " " * (self.margin + 2 * indent + 4)
        while i < self.n:
            if not self.lines[i].startswith(least):
                return i
            raw = self.raw(i).rstrip("\r") if self.crlf else self.raw(i)
            spaces = self.indent_of(raw) - self.margin
            if not raw.strip(" ") or spaces not in (2 * indent + 4, 2 * indent + 6):
                return i
            have = any(a.form != "inline" for a in compound.atoms)
            start = self.starts[i]
            if spaces == 2 * indent + 4:
                if have:
                    self.errors.append(Error("E113", start, start + len(raw)))
                atom, i = self.source_atom(i, spaces)
            else:
                if have:
                    self.errors.append(Error("E114", start, start + len(raw)))
                    opening = self.line(i).rstrip(" ")
                    if all(self.raw(k).rstrip("\r") != opening for k in range(i + 1, self.n)):
                        i += 1  # a duplicate that nothing closes is its opening line alone
                        continue
                atom, i = self.literal_atom(i)
            if not have:
                compound.atoms.append(atom)
        return i

    def source_atom(self, i: int, spaces: int) -> tuple[Atom, int]:
        lines, end = [], i
        while i < self.n:
            raw = self.raw(i)
            content = raw.rstrip("\r") if raw.endswith("\r") and i + 1 < self.n else raw
            if content.strip(" "):
                if self.indent_of(content) - self.margin < spaces:
                    break
                end = i + 1
            lines.append(content[self.margin + spaces :].rstrip(WHITE_SPACE))
            i += 1
        lines = lines[: len(lines) - (i - end)]
        for k in range(end - len(lines), end):
            self.line(k)
        return Atom("source", "\n".join(lines)), end

    def literal_atom(self, i: int) -> tuple[Atom, int]:
        opening = self.line(i).rstrip(" ")
        delimiter = opening.lstrip(" ")
        begin = self.starts[i + 1] if i + 1 < self.n else len(self.text)
        for k in range(i + 1, self.n):
            raw = self.raw(k)
            if raw == opening or self.crlf and raw == opening + "\r":
                self.checked = k - 1
                self.line(k)
                return Atom("literal", self.text[begin : max(begin, self.starts[k] - 1)], delimiter=delimiter), k + 1
        self.checked = self.n
        self.errors.append(Error("E115", self.starts[i], self.starts[i] + len(opening)))
        return Atom("literal", self.text[begin : max(begin, len(self.text) - self.text.endswith("\n"))], delimiter=delimiter), self.n


def parse_stream(text: str, admits: Callable[[list[str], str], bool] | None = None) -> Iterator[Document]:
    """Every document of a source, in order; errors stay with their document."""
    return Parser(text, admits).documents()


def parse(text: str, admits: Callable[[list[str], str], bool] | None = None) -> Document:
    """The first document; what follows its separator is not looked at."""
    return next(parse_stream(text, admits))


def write(doc: Document) -> str:
    """Text that parses to the same presentation."""
    out: list[str] = []
    if doc.directive is not None:
        out.append("#!" + doc.directive)
    if doc.pragma:
        p = doc.pragma
        out.append(" ".join([PRAGMA, *(["{}.{}".format(*p.version)] if p.version else []), *([p.reference] if p.reference else []), *("+" + x for x in p.layers), *([p.signature] if p.signature else []), *([p.sigil] if p.sigil else [])]))
        out.append("")
    _write_blocks(doc.root.blocks, 0, doc, out)
    end = "\r\n" if doc.line_endings == "CRLF" else "\n"
    return end.join(out) + end if out else ""


def _write_blocks(blocks: list[Block], depth: int, doc: Document, out: list[str]) -> None:
    pad = " " * (doc.margin + 2 * depth)
    for b in blocks:
        out += [f"{pad}{doc.sigil} {c}" if c else pad + doc.sigil for c in b.comments]
        if b.offsets:
            line = ""
            for m, h in zip(b.offsets, b.headings, strict=True):
                line = line.ljust(doc.margin + m) + doc.sigil + (" " + h if h else "")
            out.append(line)
        for c in b.compounds:
            line = pad + c.keyword + "".join(" " * a.spaces + a.text for a in c.atoms if a.form == "inline")
            out.append(line + (f"  {doc.sigil} {c.remark}" if c.remark is not None else ""))
            for a in c.atoms:
                if a.form == "source":
                    out += [f"{pad}    {x}" if x else "" for x in a.text.split("\n")]
                elif a.form == "literal":
                    out += [f"{pad}      {a.delimiter}", *([a.text] if a.text or not out else []), f"{pad}      {a.delimiter}"]
            _write_blocks(c.blocks, depth + 1, doc, out)
        out += [""] * b.blanks
