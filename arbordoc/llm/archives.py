"""Legacy ARC archives: parsing by version-specific header lines and declared lengths, and conversion to WARC.

ARC version 1 has five header fields, version 2 ten; the declared length comes last in both, and the content
of that many bytes follows the header line. A WARC record made from one gets an identifier derived from what
it holds, the timestamp in WARC form, a type and SHA-256 digests. Equal payloads become revisit records, which
keep the HTTP head alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, map_texts, saved, shared_path, table

# Fixed values of the two formats.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads below this many bytes are never revisited.
LEAST = 100
STAMP = "20240101000000"
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:x-arbordoc:archive-record")


@dataclass
class ArcRecord:
    url: str
    ip: str
    stamp: str
    kind: str
    content: bytes
    more: dict[str, str] = field(default_factory=dict)


def write_arc(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An uncompressed ARC file of that version."""
    note = f"{version} 0 arbordoc\n{FIELDS[version]}\n"
    out = [_line(version, f"filedesc://{name}", "0.0.0.0", STAMP, "text/plain", len(note), name, 0), note.encode(), b"\n"]
    at = sum(map(len, out))
    for r in records:
        out += [head := _line(version, r.url, r.ip, r.stamp, r.kind, len(r.content), name, at), r.content, b"\n"]
        at += len(head) + len(r.content) + 1
    return b"".join(out)


def _line(version: int, url: str, ip: str, stamp: str, kind: str, length: int, name: str, at: int) -> bytes:
    url = re.sub(r"[\s%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    values = [url, ip, stamp, kind, *(["200", "-", "-", str(at), name] if version == 2 else []), str(length)]
    return " ".join(values).encode() + b"\n"


class ArcReader:
    """Records out of an ARC file that comes in parts: header lines by the version block's fields, contents by their declared lengths."""

    def __init__(self) -> None:
        self.data, self.done, self.fields = bytearray(), 0, None

    def feed(self, part: bytes) -> Iterator[tuple[int, ArcRecord]]:
        """(offset, record) of each record that is complete. ValueError where a header line does not fit."""
        self.data += part
        at = 0
        while True:
            while self.data[at : at + 1] in (b"\n", b"\r"):
                at += 1
            stop = self.data.find(b"\n", at)
            if stop < 0:
                break
            values = self.data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
            if not values[-1].isdigit() or self.fields and len(values) != len(self.fields):
                raise ValueError(f"no header line at byte {self.done + at}")
            end = stop + 1 + int(values[-1])
            if end > len(self.data):
                break
            content = bytes(self.data[stop + 1 : end])
            if self.fields is None:
                version = content.split(b"\n")[0].split(b" ")[0]
                if not values[0].startswith("filedesc://") or version not in (b"1", b"2"):
                    raise ValueError("the version block is missing or of an unknown version")
                self.fields = FIELDS[int(version)].split(" ")
            else:
                named = dict(zip(self.fields, values, strict=True))
                url = re.sub("(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), named["URL"])
                yield self.done + at, ArcRecord(url, named["IP-address"], named["Archive-date"], named["Content-type"], content, named)
            at = end
        del self.data[:at]
        self.done += at

    def close(self) -> None:
        """ValueError where the last record is shorter than declared."""
        if self.data.strip(b"\r\n"):
            raise ValueError(f"the record at byte {self.done} is shorter than declared")


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records behind the version block. ValueError where a header line or a declared length does not fit."""
    reader = ArcReader()
    yield from (record for _, record in reader.feed(data))
    reader.close()


def inflated(data: bytes) -> Iterator[bytes]:
    """A file's bytes in pieces; a gzipped one's members one after another."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof and data:
            yield d.decompress(data, 1 << 20)
            data = d.unconsumed_tail
        data = d.unused_data.lstrip(b"\0")


def read_arcs(spark: SparkSession, path: str, pattern: str = "*.arc*") -> DataFrame:
    """(file, position, url, ip, stamp, kind, content, error) of the ARC files below a path, gzipped or not.

    A file is a task's unit; its records are found while it is unpacked. Where a header line or a length does not fit,
    the records before it stay, and one row with the error follows. Empty files give no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = "file string, position long, url string, ip string, stamp string, kind string, content binary, error string"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]

    def rows(file: str, data: bytes) -> Iterator[tuple]:
        reader = ArcReader()
        try:
            for part in inflated(data):
                yield from ((file, at, r.url, r.ip, r.stamp, r.kind, r.content, None) for at, r in reader.feed(part))
            reader.close()
        except (ValueError, zlib.error) as e:
            yield file, reader.done, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for row in rows(file, data.as_py()):
                    held.append(row)
                    size += len(row[6] or b"")
                    if size > SLICE_BYTES:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return files.mapInArrow(run, schema)


def convert_arcs(arcs: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes the records of read_arcs as WARC below path; rows with an error are left out.

    Of equal payloads of at least `least` bytes the one with the smallest (file, position) is the response, the others revisit
    it. Only digests and places travel; the contents stay where they were read.
    """
    rows = saved(arcs.where("error IS NULL"), "arcs")
    place = F.concat_ws("#", "file", F.lpad(F.col("position").cast("string"), 20, "0"))

    def digest():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            payloads = [http_head(c)[1] for c in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array([hashlib.sha256(p).hexdigest() if len(p) >= least else None for p in payloads], pa.string())], ["place", "digest"])

        return work

    digests = map_texts(rows.select(place.alias("place"), "content"), "content", digest, "place string, digest string").where("digest IS NOT NULL")
    first = digests.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    targets = digests.join(first, "digest").select("place", "digest", "first")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for where, url, ip, stamp, kind, content, payload, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(convert(ArcRecord(url, ip, stamp, kind, content), {payload: target} if target else {}, where))
            return pa.record_batch([pa.array(out, pa.binary())], ["value"])

        return work

    marked = rows.withColumn("place", place).join(targets, "place", "left").select("place", "url", "ip", "stamp", "kind", "content", "digest", "first")
    map_texts(marked, "content", make, "value binary").write.parquet(path)


def http_head(content: bytes) -> tuple[bytes, bytes]:
    """Head with its empty line, and payload."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark and content.startswith(b"HTTP/") else (b"", content)


def header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, key)}>"


def convert(record: ArcRecord, first: Mapping[str, str], key: str | None = None) -> bytes:
    """The equivalent WARC record. first: payload digest -> key of the record that such payloads revisit; key: this record's own."""
    head, payload = http_head(record.content)
    digest = hashlib.sha256(payload).hexdigest()
    key = key or header(head, "X-Record-Key") or f"{record.url} {record.stamp} {digest}"
    target = first.get(digest)
    revisit = target is not None and target != key
    block = head if revisit else record.content
    t = record.stamp.ljust(14, "0")
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", record.url),
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(target)}", f"X-Refers-To-Key: {target}"] if revisit else []),
        "Content-Type: " + ("application/http;msgtype=response" if head else record.kind),
        f"Content-Length: {len(block)}",
    ]
    return VERSION.encode() + "\r\n".join(lines).encode() + END.encode() + block


class WarcReader:
    """Records out of a stream that comes in parts, by their declared lengths."""

    def __init__(self) -> None:
        self.data = bytearray()

    def feed(self, part: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.data += part
        mark = VERSION.encode()
        while True:
            while self.data.startswith(mark + mark):  # the start of a file behind another one's end
                del self.data[: len(mark)]
            stop = self.data.find(b"\r\n\r\n")
            if not self.data.startswith(mark) or stop < 0:
                return
            named = dict(x.split(": ", 1) for x in self.data[len(mark) : stop].decode("utf-8", "replace").split("\r\n"))
            end = stop + 4 + int(named["Content-Length"])
            if len(self.data) < end + 4:
                return
            block = bytes(self.data[stop + 4 : end])
            del self.data[: end + 4]
            yield named, block


def write_warc(pages: DataFrame, path: str, version: int = 2, least: int = LEAST, key: str = "page_id") -> None:
    """Writes pages (key, url, html) by way of ARC files as gzipped WARC files below path.

    Of equal payloads of at least `least` bytes the smallest key is the response; rows that repeat it are responses, too. A
    null html is an empty payload. A null key comes first in no group: where it revisits nothing its record names no key.
    Very long pages are written whole; other columns are not read, whatever their names; an empty table gives an empty
    archive. The one shuffle is by payload digest; Spark splits what a hot digest brings.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col("url").cast("string"), F.lit("-")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    same = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            records, first = [], {}
            for k, url, html, digest, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html.encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Record-Key: {k}\r\n\r\n"
                records.append(ArcRecord(url, "0.0.0.0", STAMP, "text/html", head.encode() + payload))
                if target is not None:
                    first[digest] = str(target)
            out = [convert(r, first).decode() for r in read_arc(write_arc(records, version))]
            return pa.record_batch([pa.array(out, pa.string())], ["value"])

        return work

    marked = rows.join(same, "digest", "left").select("key", "url", "html", "digest", "first")
    map_texts(marked, "html", make, "value string").write.option("lineSep", END).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, key, payload_bytes, payload_digest, refers_to, url, html) of each record; html is null for revisits.

    The text reader hands over a file's parts in order (a gzipped file is not split); records are found in
    them by their declared lengths, so that a payload may hold anything.
    """
    schema = "record_type string, key string, payload_bytes long, payload_digest string, refers_to string, url string, html string"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, first = WarcReader(), True
        for batch in batches:
            rows = []
            for part in batch.column(0).cast(pa.binary()).to_pylist():
                for named, block in reader.feed(part if first else VERSION.encode() + part):
                    head, payload = http_head(block)
                    revisit = named["WARC-Type"] == "revisit"
                    size = int(header(head, "Content-Length") or 0) if revisit else len(payload)
                    rows.append((named["WARC-Type"], header(head, "X-Record-Key"), size, named["WARC-Payload-Digest"].partition(":")[2], named.get("X-Refers-To-Key"), named["WARC-Target-URI"], None if revisit else payload.decode("utf-8", "replace")))
                first = False
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return spark.read.option("lineSep", VERSION).text(path).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    key = lambda name: F.when(F.col(name) != "None", F.col(name).cast("long"))
    return read_warc(spark, path).select(key("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
