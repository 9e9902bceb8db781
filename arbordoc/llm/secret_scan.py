"""Secret scans through nested encodings.

A worklist starts with the text itself. Each layer is scanned for secrets and unwrapped in every way that
applies: percent escapes, Unicode escapes and numeric character references replace the whole layer by its
decoded form (escapes of escapes, however deep, by one level); a base64 run that holds readable text, and compressed data in base64 or behind escapes, become
layers of their own. New layers join the worklist until none is left. A layer whose content was seen before at
the same place is not taken up again, which ends cycles (an archive that unpacks to itself). Every span found
in a layer is mapped back through the layers above it to the characters of the text that carry it.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import lzma
import re
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, text_of

# The kinds in order with their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\u\{[0-9a-fA-F]{1,6}\}|(?:\\x[0-9a-fA-F]{2})+|&#[xX][0-9a-fA-F]{1,6};|&#[0-9]{1,7};"
)
#: Escapes of an escape's own first sign, one within the other: all such levels are opened at once.
NESTED = re.compile(r"%(?:25){2,}|\\u005[cC](?:u005[cC])+|\\x5[cC](?:x5[cC])+|&#0*38;(?:#0*38;)+|&#[xX]0*26;(?:#[xX]0*26;)+")
#: Base64 of a shorter run cannot hold a secret.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
PACKED_IN_PERCENT = re.compile(r"(?:%1[fF]%8[bB]|x%(?:01|5[eE]|9[cC]|[dD][aA])|BZh|%[fF][dD]7zXZ|%28%[bB]5%2[fF]%[fF][dD]|\(%[bB]5/%[fF][dD])[^\s\"'<>]*")
UNREADABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

#: A line end within wrapped base64, escaped ones too, and a line of it.
BREAK = re.compile(r"[\x20\t]*(?:\r?\n|\r|(?:\\r)?\\n)[\x20\t]*")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")

#: Bytes of an unpacked layer that are scanned at once; a larger layer is scanned in such blocks, each with the end of the last.
LARGEST = 64 << 20
OVERLAP = 4 << 20
#: Memory that one decompressor may take; a stream that needs more is counted as unopened.
MEMORY = 256 << 20


class Layer:
    """Text with the way its characters map to the layer above: segments (own start, start above, end above, step)."""

    __slots__ = ("above", "depth", "ends", "own", "starts", "steps", "text")

    def __init__(self, text: str, above: Layer | None, segments: list[tuple[int, int, int, int]]):
        self.text, self.above, self.depth = text, above, above.depth + 1 if above else 0
        self.own, self.starts, self.ends, self.steps = map(list, zip(*segments, strict=True)) if segments else ([], [], [], [])

    def root(self, start: int, end: int) -> tuple[int, int]:
        """The characters of the first text that carry [start, end) of this one."""
        layer = self
        while layer.above:
            i, j = bisect_right(layer.own, start) - 1, bisect_right(layer.own, end - 1) - 1
            start = layer.starts[i] + (start - layer.own[i] if layer.steps[i] else 0)
            end = layer.starts[j] + end - layer.own[j] if layer.steps[j] else layer.ends[j]
            layer = layer.above
        return start, end


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three kinds, leftmost and non-overlapping in each; runs: where long runs of word characters stand."""
    found = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for a, b in [(m.start(), m.end()) for m in RUN.finditer(text)] if runs is None else runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return found


def replaced(layer: Layer, pattern: re.Pattern, decode: Callable[[str], tuple[str, list[int]] | None]) -> Layer | None:
    """The whole layer with each match decoded; None where nothing changes.

    decode: the match -> its text and how many signs carry each character, or None, which leaves it as it is.
    """
    out, segments, at, size = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        if (new := decode(m[0])) is None:
            continue
        if m.start() > at:
            segments.append((size, at, m.start(), 1))
            out.append(layer.text[at : m.start()])
            size += m.start() - at
        place = m.start()
        for n in new[1]:
            segments.append((size, place, place + n, 0))
            place += n
            size += 1
        out.append(new[0])
        at = m.end()
    if not at:
        return None
    if at < len(layer.text):
        segments.append((size, at, len(layer.text), 1))
        out.append(layer.text[at:])
    return Layer("".join(out), layer, segments)


def of_bytes(data: bytes, step: int, skip: bool = False) -> tuple[str, list[int]]:
    """Text of escaped bytes, `step` signs each; a byte that is no UTF-8 stands for its Latin-1 character, or is skipped."""
    out, widths, before = [], [], 0
    for c in data.decode("utf-8", "surrogateescape"):
        alone = 0xDC80 <= ord(c) < 0xDD00
        if alone and skip:
            before += step
            continue
        out.append(chr(ord(c) - 0xDC00) if alone else c)
        widths.append(before + step * (1 if alone else len(c.encode())))
        before = 0
    return "".join(out), widths


def unpercent(coded: str, skip: bool = False) -> tuple[str, list[int]]:
    return of_bytes(bytes.fromhex(coded.replace("%", "")), 3, skip)


def unescape(coded: str) -> tuple[str, list[int]] | None:
    if coded[:2] == "\\x":
        return of_bytes(bytes.fromhex(coded.replace("\\x", "")), 4)
    if coded.count("\\u") == 2:
        return bytes.fromhex(coded.replace("\\u", "")).decode("utf-16-be"), [len(coded)]
    digits = re.sub(r"[^0-9a-fA-F]", "", coded)
    point = int(digits, 10 if coded[0] == "&" and coded[2] not in "xX" else 16)
    return (chr(point), [len(coded)]) if point < 0x110000 and not 0xD800 <= point < 0xE000 else None


def unnested(coded: str) -> tuple[str, list[int]]:
    """The escape of one level; its first sign is carried by all the levels."""
    inner = "%25" if coded[0] == "%" else coded[: coded.index(";") + 1] if coded[0] == "&" else coded[: 6 if coded[1] == "u" else 4]
    return inner, [len(coded) - len(inner) + 1, *[1] * (len(inner) - 1)]


def inflated(data: bytes) -> bytes | None:
    """What raw deflate data holds; None unless the stream ends where the data ends and holds text."""
    d = zlib.decompressobj(-15)
    try:
        out = d.decompress(data, LARGEST)
    except zlib.error:
        return None
    return out if d.eof and not d.unused_data and len(out) >= len(data) // 2 else None


def zipped(data: bytes) -> Iterator[bytes]:
    """The members of a zip archive, one after another, each followed by a line end."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for name in archive.infolist():
                with archive.open(name) as member:
                    while piece := member.read(1 << 20):
                        yield piece
                yield b"\n"
    except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError, lzma.LZMAError, ValueError):
        return


def is_packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:1] == b"x" and data[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda") or data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\x00" or data[:4] == b"\x28\xb5\x2f\xfd"


class Unpacking:
    """Pieces of what packed data holds, all its members, then what stands behind them; damaged: whether an end is missing, refused: for want of memory."""

    def __init__(self, data: Iterator[bytes]):
        self.data, self.damaged, self.refused = data, False, False

    def _one(self, head: bytes) -> Iterator[bytes]:
        """A member that starts with head; self.rest: what was read beyond it."""
        piece = 1 << 20
        if head[:4] == b"\x28\xb5\x2f\xfd":
            d = zstandard.ZstdDecompressor(max_window_size=MEMORY).decompressobj()
            while not d.eof and head:
                for at in range(0, len(head), 4096):  # output of a call is not bounded
                    yield d.decompress(head[at : at + 4096])
                    if d.eof:
                        self.rest = d.unused_data + head[at + 4096 :]
                        return
                head = next(self.data, b"")
        elif head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00":
            d = bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor(memlimit=MEMORY)
            while not d.eof:
                yield d.decompress(head, piece)
                head = b""
                if not d.eof and d.needs_input and not (head := next(self.data, b"")):
                    break
            self.rest = d.unused_data
        else:
            d = zlib.decompressobj(47)
            while not d.eof and head:
                out = d.decompress(head, piece)
                yield out
                # a full piece may leave output behind although all input is used up
                while not d.eof and not d.unconsumed_tail and len(out) == piece:
                    out = d.decompress(b"", piece)
                    yield out
                head = d.unconsumed_tail or (b"" if d.eof else next(self.data, b""))
            self.rest = d.unused_data
        self.damaged |= not d.eof

    def __iter__(self) -> Iterator[bytes]:
        head = next(self.data, b"")
        try:
            while head := head if len(head) >= 6 else head + next(self.data, b""):
                if not is_packed(head):
                    break
                self.rest = b""
                yield from self._one(head)
                head = self.rest.lstrip(b"\0") or next(self.data, b"").lstrip(b"\0")
        except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError) as e:
            self.damaged, self.refused = True, "memory" in str(e).lower()
            return
        if head:
            yield b"\n" + head
            yield from self.data


def iter_of(head: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from rest


def up_to(pieces: Iterator[bytes], most: int) -> bytes:
    """Pieces joined until they are more than `most` bytes."""
    out = bytearray()
    for piece in pieces:
        out += piece
        if len(out) > most:
            break
    return bytes(out)


def unpacked(data: bytes) -> bytes | None:
    """The first bytes of what data holds; None where it is not packed or gives nothing."""
    return up_to(iter(Unpacking(iter([data]))), 0) or None if is_packed(data) else None


def decoded(data: bytes) -> tuple[str, int]:
    """Text of any bytes, and how many bytes a character has: 0 for UTF-8, 2 for UTF-16, 1 where neither fits."""
    for half, order in ((1, "le"), (0, "be")):
        if len(data) >= 8 and data[half::2].count(0) > len(data) * 0.3 and data[1 - half :: 2].count(0) < len(data) * 0.1:
            return data[: len(data) // 2 * 2].decode(f"utf-16-{order}", "replace"), 2
    try:
        return data.decode(), 0
    except UnicodeDecodeError:
        return data.decode("latin-1"), 1


def wrapped(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The lines of base64 that start with the run [start, end): all as wide as the second one but the first and the last."""
    lines, width = [(start, end)], 0
    while not text[lines[-1][1] - 1] == "=" and (m := BREAK.match(text, lines[-1][1])) and (line := LINE.match(text, m.end())):
        n = line.end() - line.start()
        if not width:
            width = max(n, end - start)
        if n > width:
            break
        lines.append(line.span())
        if n < width:
            break
    return lines


def unbase64(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1 or ("+" in body or "/" in body) and ("-" in body or "_" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except binascii.Error:
        return None


def scan(text: str) -> tuple[list[tuple[int, int, int]], set[tuple[int, int, int]], int, int]:
    """Base spans, spans of all layers (both as (start, kind, end)), layers opened and layers unopened."""
    runs = [(m.start(), m.end()) for m in RUN.finditer(text)]
    base = base_spans(text, runs)
    found, seen, opened, unopened = set(base), set(), 0, 0
    root = Layer(text, None, [])
    work: list[Layer | Iterator[Layer]] = [root]

    def take(layer: Layer | None) -> None:
        nonlocal opened
        if layer is None or not layer.text:
            return
        mark = (hashlib.sha1(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.root(0, len(layer.text)))
        if mark not in seen:
            seen.add(mark)
            opened += 1
            work.append(layer)

    def pieces_of(head: bytes, rest: Iterator[bytes], states: list[Unpacking], above: Layer, start: int, end: int) -> Iterator[Layer]:
        """A layer for each block of a large unpacked layer."""
        nonlocal unopened
        while is_packed(head):
            states.append(Unpacking(iter_of(head, rest)))
            rest = iter(states[-1])
            head = up_to(rest, LARGEST)
        while head:
            yield Layer(decoded(head)[0], above, [(0, start, end, 0)])
            more = up_to(rest, LARGEST)
            head = head[-OVERLAP:] + more if more else b""
        unopened += any(x.damaged for x in states)

    def bare(data: bytes, above: Layer, start: int, end: int, place) -> bool:
        """Takes up decoded bytes; says whether they were text or compressed text. place: base64 digit -> where it stands, or None."""
        nonlocal unopened
        packed = False
        while is_packed(data):
            state = Unpacking(iter([data]))
            rest = iter(state)
            out = up_to(rest, LARGEST)
            if not out:
                unopened += state.refused
                break
            mark = (hashlib.sha1(data).digest(), start, end, above.depth)
            if mark in seen:  # it unpacks to itself
                return True
            seen.add(mark)
            if len(out) > LARGEST:
                work.append(pieces_of(out, rest, [state], above, start, end))
                return True
            unopened += state.damaged
            data, packed = out, True
        if not packed and data[:4] == b"PK\x03\x04":
            rest = zipped(data)
            if out := up_to(rest, LARGEST):
                work.append(pieces_of(out, rest, [], above, start, end))
                return True
        inner, size = decoded(data)
        if not packed and (size or UNREADABLE.search(inner)) and (out := inflated(data)):
            work.append(pieces_of(out, iter(()), [], above, start, end))
            return True
        if packed or place is None:
            if packed or size == 0 and not UNREADABLE.search(inner):
                take(Layer(inner, above, [(0, start, end, 0)]))
                return True
            return False
        segments, at = [], 0
        for i, c in enumerate(inner):
            n = size if size == 1 else len(c.encode("utf-16-le" if size else "utf-8", "surrogatepass"))
            segments.append((i, place(at * 8 // 6), place(((at + n) * 8 + 5) // 6 - 1) + 1, 0))
            at += n
        layer = Layer(inner, above, segments)
        if size != 1 and len(UNREADABLE.findall(inner)) * 10 <= len(inner):
            take(layer)
            return True
        found.update((a, kind, b) for x, kind, y in base_spans(inner) for a, b in [layer.root(x, y)])
        return False

    while work:
        layer = work.pop()
        if not isinstance(layer, Layer):
            if (block := next(layer, None)) is not None:
                work.append(layer)
                take(block)
            continue
        t = layer.text
        spans = runs if layer is root else [(m.start(), m.end()) for m in RUN.finditer(t)]
        if layer is not root:
            found |= {(a, kind, b) for start, kind, end in base_spans(t, spans) for a, b in [layer.root(start, end)]}
        if (peeled := replaced(layer, NESTED, unnested)) is not None:
            take(peeled)
        elif "%" in t:
            take(replaced(layer, PERCENT, unpercent))
            take(replaced(layer, PERCENT, lambda x: unpercent(x, skip=True)))  # the same layer where all is UTF-8
            for m in PACKED_IN_PERCENT.finditer(t):
                coded = re.sub(rb"%([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), m[0].encode())
                bare(coded, layer, m.start(), m.end(), None)
        if "\\" in t or "&#" in t:
            if peeled is None:
                take(replaced(layer, ESCAPE, unescape))
            for m in re.finditer(r"(?:\\x[0-9a-fA-F]{2}){8,}", t):
                data = bytes.fromhex(m[0].replace("\\x", ""))
                if unpacked(data) or data[:4] == b"PK\x03\x04":
                    bare(data, layer, m.start(), m.end(), None)
        done = 0
        for a, b in spans:
            if a < done:
                continue
            lines = wrapped(t, a, b)
            for some in (lines, lines[:-1]):
                if len(some) < 2 or (data := unbase64("".join(t[x:y] for x, y in some))) is None:
                    continue
                starts = [0]
                for x, y in some:
                    starts.append(starts[-1] + y - x)
                place = lambda k, some=some, starts=starts: some[(i := min(bisect_right(starts, k), len(some)) - 1)][0] + k - starts[i]
                if bare(data, layer, a, some[-1][1], place):
                    done = some[-1][1]
                    break
            if a < done:
                continue
            run = t[a:b]
            if (data := unbase64(run)) is not None and bare(data, layer, a, b, lambda k, a=a: a + k):
                continue
            for m in re.finditer(r"[A-Za-z0-9]{16,}={0,2}", run):  # parts between signs that may be punctuation
                if m[0] != run and (data := unbase64(m[0])) is not None:
                    bare(data, layer, a + m.start(), a + m.end(), lambda k, a=a + m.start(): a + k)
    return base, found, opened, unopened


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, base, spans, n_layers, n_unopened); base and spans: arrays of (kind, start, end), by start, kind, end.

    Offsets are code points of the whole text, end exclusive. base has the text's own spans, spans also those of
    its decoded layers. Null and empty texts have none; null keys, repeated rows and ties stay as they are; very long
    texts are read whole; other columns are not read, whatever their names. An empty table gives no rows.
    """
    span = "array<struct<kind:string,start:int,end:int>>"
    schema = f"{key} long, base {span}, spans {span}, n_layers int, n_unopened int"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            columns = [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(row[i])] for row in rows] for i in (0, 1)]
            return pa.record_batch([batch.column(0), *(pa.array(c, kind) for c in columns), *(pa.array([row[i] for row in rows], pa.int32()) for i in (2, 3))], [key, "base", "spans", "n_layers", "n_unopened"])

        return work

    return map_texts(docs.select(F.col(key).cast("long"), text_of(text).alias("text")), "text", make, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """docs with every span of every layer replaced by mark (overlapping ones together).

    Null and empty texts, null keys, repeated rows and other columns, whatever their names, stay as they are; very long
    texts are read whole. An empty table gives no rows.
    """

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            i = batch.schema.get_field_index(text)
            out = []
            for t in batch.column(i).to_pylist():
                if t is not None:
                    last = len(t)
                    for a, b in merged(scan(t)[1])[::-1]:
                        t, last = t[:a] + mark + t[b:last] + t[last:], a
                out.append(t)
            return batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

        return work

    return map_texts(docs, text, make, docs.schema)


def merged(spans: set[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), "n_layers", "n_unopened")
