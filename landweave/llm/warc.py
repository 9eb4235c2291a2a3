"""WARC files: written from pages, and read sequentially, whoever wrote them.

A file is a run of gzip members, one for each record, so that a record can be read on
its own. The reader inflates a file incrementally in blocks, never holding more than a
member; a member's end is where zlib says it is. Within it the header ends at the
first empty line and Content-Length frames the block; what follows is the next record, if a
writer put several into a member (uncompressed files are one such member). WARC-Block-Digest
and WARC-Payload-Digest (SHA-1, SHA-256 or MD5, in base 32 or 16) are verified.

A page is a ``response`` with a status line, a ``resource`` or a ``conversion``. The payload of an HTTP
response is what follows its head, without chunks' frames and inflated as its Content-Encoding
says (the digest is of what the block has; both readings are tried, as writers differ). Other records
(warcinfo, request, metadata, revisit and so on) are returned as well, with their type, but aren't pages: their
html is null. :func:`pages` keeps the pages.

Each task writes a file of its own, named by its attempt, to the shared folder; the
list of files is a table that only committed attempts get into. Files are read in
parallel, each from its start to its end by one task.

Defined cases: a record of a null url has no target, of a null page_id no page id, of a
null html the header Landweave-Null, and is read as null; an empty page is a record of length
0; repeated rows are a record each; an empty table gives no file and no record; extra columns
don't matter. A digest is optional: without one, or with one of an unknown kind, digest_ok is
null; one that doesn't fit gives false. Bytes that aren't of the charset named (UTF-8 if none is, or
an unknown one) are read as U+FFFD. Header names have any case, values may be folded or
follow the colon at once, lines may end without a carriage return. A damaged frame (no header, a
length beyond the record) raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, qualified, scratch

BLOCK = 1 << 18
LEVEL = 6
#: Pages carry no time, and a record must have one.
NO_DATE = "1970-01-01T00:00:00Z"
ROWS = "page_id long, url string, html string, length long, digest string, digest_ok boolean, type string, file string, offset long"
NAMES = ["page_id", "url", "html", "length", "digest", "digest_ok", "type", "file", "offset"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64()]


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def fits(said: str, payload: bytes) -> bool | None:
    """Whether a labelled digest is that of ``payload``; None if its kind isn't known."""
    kind, _, value = said.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5"):
        return None
    found, value = hashlib.new(kind, payload).digest(), value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def record(page_id: int | None, url: str | None, html: str | None, compressed: bool = True) -> bytes:
    """One resource record as a gzip member. URLs are percent-encoded where a header can't hold them."""
    payload = (html or "").encode()
    head = ["WARC/1.1", "WARC-Type: resource", "Content-Type: text/html; charset=utf-8"]
    head += ["WARC-Date: " + NO_DATE, f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    if html is not None:
        head.append("WARC-Payload-Digest: " + digest(payload))
    else:
        head.append("Landweave-Null: html")
    head.append(f"Content-Length: {len(payload)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"
    if not compressed:
        return raw
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(stream: BinaryIO, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """Where each gzip member begins and what it inflates to, one after another; of a file that isn't
    compressed, its records. Zeros after a member are padding."""
    at, held = 0, b""
    while held or (held := stream.read(block)):
        while len(held) < 2 and (more := stream.read(block)):
            held += more
        if at == 0 and held[:2] != b"\x1f\x8b":
            yield from _plain(held, stream, block)
            return
        if held[:1] == b"\0":
            rest = held.lstrip(b"\0")
            at += len(held) - len(rest)
            held = rest
            continue
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not held and not (held := stream.read(block)):
                raise ValueError(f"the member at {at} is cut short")
            parts.append(z.decompress(held))
            used += len(held) - len(z.unused_data)
            held = z.unused_data
        yield at, b"".join(parts)
        at += used


def _plain(held: bytes, stream: BinaryIO, block: int) -> Iterator[tuple[int, bytes]]:
    """The records of a file that isn't compressed, by their lengths."""
    at = 0
    while held.strip(b"\r\n") or (more := stream.read(block)):
        if not held.strip(b"\r\n"):
            held += more
            continue
        start = len(held) - len(held.lstrip(b"\r\n"))
        at, held = at + start, held[start:]
        while not (m := _BLANK.search(held)) and (more := stream.read(block)):
            held += more
        said = _headers(held[: m.start()]).get("content-length", "") if m else ""
        need = m.end() + int(said) if said.isdigit() else len(held)
        parts, size = [held], len(held)
        while size < need and (more := stream.read(max(block, need - size))):
            parts.append(more)
            size += len(more)
        held = b"".join(parts)
        yield at, held[:need]
        at, held = at + min(need, size), held[need:]


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; a line that begins with white space goes on with the one before."""
    text = re.sub(rb"\r?\n[ \t]+", b" ", raw).decode("utf-8", "replace")
    found: dict[str, str] = {}
    for line in text.splitlines():
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


_BLANK = re.compile(rb"\r?\n\r?\n")


def _unchunked(body: bytes) -> bytes:
    """What chunks hold; ``body`` as it is where it isn't made of chunks."""
    parts, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n").match(body, at):
        n = int(m[1], 16)
        if n == 0:
            return b"".join(parts)
        if m.end() + n > len(body):
            return body
        parts.append(body[m.end() : m.end() + n])
        at = m.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join(parts) if parts and at == len(body) else body


def _http(block: bytes) -> tuple[list[bytes], bytes, dict[str, str]]:
    """Of an HTTP response: the payloads that a digest may be of, the content, its headers."""
    m = _BLANK.search(block)
    first, _, lines = (block[: m.start()] if m else block).partition(b"\n")
    head, body = _headers(lines), block[m.end() :] if m else b""
    plain = _unchunked(body) if "chunked" in head.get("transfer-encoding", "").lower() else body
    content = plain
    for kind in reversed([k.strip() for k in head.get("content-encoding", "").lower().split(",") if k.strip()]):
        for bits in {"gzip": [47], "x-gzip": [47], "deflate": [47, -15]}.get(kind, []):
            try:
                content = zlib.decompressobj(bits).decompress(content)
                break
            except zlib.error:  # stored inflated, or not what it says: as it is
                pass
    return [body, plain, content], content, head


def _decoded(raw: bytes, kind: str) -> str:
    """Text in the charset that a content type names."""
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    try:
        return raw.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _past_breaks(raw: bytes, at: int) -> int:
    while raw[at : at + 1] in (b"\r", b"\n"):
        at += 1
    return at


def parse(raw: bytes, start: int = 0) -> tuple[tuple, int]:
    """The record that begins at ``start`` as (page_id, url, html, length, digest, whether it fits, type), and
    where the next begins."""
    m = _BLANK.search(raw, start)
    first, _, lines = raw[start : m.start() if m else start].partition(b"\n")
    head = _headers(lines)
    if not m or not first.startswith(b"WARC/") or not head.get("content-length", "").isdigit():
        raise ValueError("a record's frame is damaged")
    length, end = int(head["content-length"]), m.end()
    block = raw[end : end + length]
    if len(block) < length or raw[end + length : end + length + 1] not in (b"", b"\r", b"\n"):
        raise ValueError("a record's frame is damaged")
    kind, content_type = head.get("warc-type", "").lower(), head.get("content-type", "")
    payloads, content, of = [block], block, content_type
    if kind == "response" and block.startswith(b"HTTP/"):
        payloads, content, http = _http(block)
        of = http.get("content-type", "")
    said, checks = head.get("warc-payload-digest"), []
    if said is not None and kind != "revisit":  # a revisit's is of the payload that it lacks
        found = [fits(said, p) for p in payloads]
        checks.append(True if True in found else found[0])
    if (whole := head.get("warc-block-digest")) is not None:
        checks.append(fits(whole, block))
    known = [c for c in checks if c is not None]
    page = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-record-id", ""))
    url = head.get("warc-target-uri")
    if url is not None:
        url = unquote(url.removeprefix("<").removesuffix(">") if url.startswith("<") and url.endswith(">") else url)
    is_page = (kind in ("resource", "conversion") or kind == "response" and block.startswith(b"HTTP/")) and "landweave-null" not in head
    row = (int(page[1]) if page else None, url, _decoded(content, of) if is_page else None, length, said or whole, all(known) if known else None, kind)
    return row, _past_breaks(raw, end + length)


def records(stream: BinaryIO) -> Iterator[tuple[tuple, int]]:
    """Every record of a file, with where its member begins."""
    for at, raw in members(stream):
        here = _past_breaks(raw, 0)
        while here < len(raw):
            row, here = parse(raw, here)
            yield row, at


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages below ``folder`` (of the shared folder by default); the table of (file, records)."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or scratch(spark, "warc"))
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, name = None, 0, f"{folder}/pages-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz"
        for b in batches:
            for row in zip(*(c for c in b.columns)):
                if out is None:
                    system, path = fs.FileSystem.from_uri(name)
                    out = system.open_output_stream(path, compression=None)
                out.write(record(*(x.as_py() for x in row)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    d = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", "html")
    d.mapInArrow(each, "file string, records long").write.parquet(f"{folder}/files")
    return spark.read.schema("file string, records long").parquet(f"{folder}/files")


def read(files: DataFrame) -> DataFrame:
    """A row for each record of the files: page_id, url, html, length (of the block), digest, digest_ok, type, file, offset."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                system, path = fs.FileSystem.from_uri(name)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row, at in records(stream):
                        rows.append((*row, name, at))
                        held += row[3]
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    listed = pick(files, "file").distinct()
    return listed.repartition(max(1, listed.count()), "file").mapInArrow(each, ROWS)


def pages(found: DataFrame) -> DataFrame:
    """The records of :func:`read` that are pages."""
    return found.filter("type in ('resource', 'conversion') or type = 'response' and html is not null")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=NAMES)


def query(docs: DataFrame) -> DataFrame:
    """Every page, through WARC and back, with its length in bytes and the check of its digest."""
    return read(write(docs)).select("page_id", "url", "html", "length", "digest_ok")


ORACLE = """select page_id, url, html, cast(coalesce(octet_length(encode(html)), 0) as bigint) "length",
 case when html is not null then true end digest_ok from pages"""
