"""Web archives: write ARC, convert ARC to WARC with synthesised identifiers and revisits, read WARC."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

# Field names of the record line, by ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
#: Payload bytes after which an archive ends, and bytes that a reader takes at once.
ARCHIVE_BYTES, PIECE = 8 << 20, 1 << 16
_UNSAFE = re.compile(r"[\s\x00-\x20\x7f]")
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    """A record of an ARC file: fields of its header line, and the declared number of bytes."""

    fields: dict[str, str]
    body: bytes
    version: int

    @property
    def url(self) -> str:
        return self.fields["URL"]


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 tracewright\n{ARC_FIELDS[version]}\n\n".encode()
    more = f" 200 - - 0 {name}" if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, kind: str, body: bytes, name: str, offset: int) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind}{more} {len(body)}\n".encode() + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file. The version block names the fields; a record has its declared length.

    A header line is cut from its right end, as old URLs may hold spaces. Blank lines between
    records are skipped; a line with too few fields or a length beyond the data is an error.
    """
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line.strip():
            at = end + 1
            continue
        is_head = line.startswith("filedesc://")
        length = line.rsplit(" ", 1)[-1]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"bad ARC record line at byte {at}: {line[:200]!r}")
        body = data[end + 1 : end + 1 + int(length)]
        if is_head:
            version = int(body.split(b" ", 1)[0] or b"1")
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
        names = ARC_FIELDS[version].split()
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"{len(values)} fields in an ARC {version} record line: {line[:200]!r}")
        yield ArcRecord(dict(zip(names, values, strict=True)), body, version)
        at = end + 1 + int(length)


def iso_date(arc_date: str) -> str:
    """A 14-digit ARC date (older files: fewer digits) as a WARC date."""
    d = (arc_date + "00000101000000"[len(arc_date) :] if len(arc_date) < 14 else arc_date)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, payload_digest: str, tag: str = "") -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {payload_digest} {tag} {url}')}>"


@dataclass
class Original:
    """The record that a revisit refers to."""

    tag: str
    url: str


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; no head where the body is no HTTP message."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body[: end + 4], body[end + 4 :]) if end >= 0 else (body, b"")


def http_field(head: bytes, name: str) -> str:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else ""


def to_warc(arc: ArcRecord, original: Original | None = None) -> tuple[dict[str, str], bytes]:
    """Named fields and block of the WARC record that is equivalent to an ARC record."""
    date = arc.fields["Archive-date"]
    if arc.url.startswith("filedesc://"):
        fields = {"WARC-Type": "warcinfo", "WARC-Date": iso_date(date), "WARC-Filename": arc.url[11:], "Content-Type": "application/warc-fields"}
        block = f"software: tracewright\r\nformat: WARC File Format 1.1\r\nconformsTo: ARC {arc.version}\r\n".encode()
        return fields | {"WARC-Record-ID": record_id(arc.url, date, "")}, block
    head, payload = split_http(arc.body)
    digest, tag = sha1_label(payload), http_field(head, "X-Page-Id")
    fields = {
        "WARC-Type": ("revisit" if original else "response") if head else "resource",
        "WARC-Target-URI": arc.url,
        "WARC-Date": iso_date(date),
        "WARC-IP-Address": arc.fields["IP-address"],
        "WARC-Record-ID": record_id(arc.url, date, digest, tag),
        "WARC-Payload-Digest": digest,
        "Content-Type": "application/http; msgtype=response" if head else arc.fields["Content-type"],
    }
    if not (original and head):
        return fields | {"WARC-Block-Digest": sha1_label(arc.body)}, arc.body
    fields |= {"WARC-Profile": _REVISIT_PROFILE, "WARC-Refers-To": record_id(original.url, date, digest, original.tag), "WARC-Refers-To-Target-URI": original.url, "X-Refers-To-Page": original.tag}
    return fields | {"WARC-Block-Digest": sha1_label(head)}, head


def warc_record(fields: dict[str, str], block: bytes, level: int = 3) -> bytes:
    """A record in a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items()) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def convert(data: bytes, original_of: Callable[[ArcRecord], Original | None] = lambda _: None) -> bytes:
    """A WARC file (a gzip member for each record) from an ARC file."""
    return b"".join(warc_record(*to_warc(r, original_of(r))) for r in read_arc(data))


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record of a WARC file with gzip members."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:  # by pieces, so that what follows a member is not copied with each
            piece = data[at : at + PIECE]
            if not piece:
                raise ValueError("a record ends early")
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        raw = b"".join(parts)
        end = raw.index(b"\r\n\r\n")
        lines = raw[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:80]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, raw[end + 4 : end + 4 + int(fields["Content-Length"])]


def safe_url(url: str | None, page_id) -> str:
    """The URL with white space and control characters escaped; a made one where it is null or empty."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"


def write_archives(pages: DataFrame, date: str = "20240101000000", least: int = LEAST_REVISIT) -> DataFrame:
    """WARC archives of pages (page_id, url, html), as rows of archive and content.

    Pages are written as ARC of both versions and converted. Of equal payloads of at least
    `least` bytes, pages with the largest id are responses, the others revisits. Payloads move
    once, to the row that names their group; only repeated digests are joined, and Spark splits
    a hot one.
    """
    small_batches(pages.sparkSession)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    light = pages.select("page_id", "url", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    groups = (
        light.where((F.col("bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy(F.col("digest").alias("of"))
        .agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("of", F.col("kept.page_id").alias("kept_id"), F.col("kept.url").alias("kept_url"))
    )
    joined = rows.join(groups, (rows["digest"] == groups["of"]) & (rows["bytes"] >= least), "left")
    ready = joined.select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("kept_id")), F.col("kept_id")).alias("kept_id"), "kept_url")

    def archive(version: int, pages: list[tuple]) -> pa.RecordBatch:
        name = f"part-{uuid.uuid4().hex}.arc"
        arc, size, originals = [arc_header(version, name, date)], 0, {}
        for page, url, payload, kept, kept_url in pages:
            tag = "" if page is None else str(page)
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {tag}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            if kept is not None:
                originals[len(arc)] = Original(str(kept), safe_url(kept_url, kept))
            arc.append(arc_record(version, safe_url(url, tag), date, "text/html", head + payload, name, size))
            size += len(arc[-1])
        at = iter(range(len(arc)))
        warc = convert(b"".join(arc), lambda _: originals.get(next(at)))
        return pa.RecordBatch.from_arrays([pa.array([name.replace(".arc", ".warc.gz")]), pa.array([warc], pa.binary())], ["archive", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            pages, size = [], 0
            for r in range(b.num_rows):
                pages.append(tuple(b.column(i)[r].as_py() for i in range(5)))
                size += len(pages[-1][2])
                if size >= ARCHIVE_BYTES or r == b.num_rows - 1:
                    yield archive(1 + done % 2, pages)
                    done, pages, size = done + 1, [], 0

    return ready.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows of the response and revisit records of archives.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id. A response's
    length and digest are those of the payload that was read, and must be as declared.
    """
    small_batches(archives.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def of(fields: dict[str, str], block: bytes) -> tuple:
        head, payload = split_http(block)
        kind, digest = fields["WARC-Type"], base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(http_field(head, "Content-Length"))
        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is not as declared")
        page, refers = http_field(head, "X-Page-Id"), fields.get("X-Refers-To-Page", "")
        return int(page) if page else None, size, digest, kind, int(refers) if refers else None, fields["WARC-Target-URI"], fields["WARC-Record-ID"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = [of(f, block) for f, block in read_warc(content.as_py()) if f["WARC-Type"] in ("response", "revisit")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return archives.select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages into archives (a table in the shared folder) and read them back.

    Null html is an empty payload, a null URL gets a made one; pages with equal ids keep their
    rows; a null page_id stays null and is never an original. No pages, no rows.
    """
    small_batches(pages.sparkSession)
    return read_archives(Scratch(pages.sparkSession, "warc").keep(write_archives(pages)))
