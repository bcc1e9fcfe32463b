"""WARC archives: a writer with revisit records and a salvage reader.

The writer turns rows into gzip members of one record each and hands them to Spark's text
sink, whose line separator is set to the zero byte that every member ends with, so that
the bytes on storage are the members one after the other and any storage that Spark can
write will do. The reader takes archives from Spark's binary source, checks each member
and record, and after a failed check searches for the next gzip member or version line
that starts a valid record, inside the content of a member too. What lies between is logged
as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import lean, shared_path, small_batches

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
#: A member without content; its last byte is zero, whatever the member before it ends with.
EMPTY_MEMBER = zlib.compressobj(wbits=31).flush()
PAGE = "urn:x-page:"
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit with the headers of one alone."""
    block = _http(len(payload)) + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{PAGE}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that ends with a zero byte, without that byte."""
    c = zlib.compressobj(level, wbits=31)
    out = c.compress(data) + c.flush()
    return out[:-1] if out[-1] == 0 else out + EMPTY_MEMBER[:-1]


@dataclass
class Record:
    """A valid record at ``offset``; a gap has kind ``gap`` and a reason."""

    offset: int
    length: int
    kind: str
    reason: str | None = None
    headers: dict[str, str] | None = None
    block: bytes = b""


def parse(data: bytes, at: int) -> tuple[Record | None, str]:
    """The record that starts at ``at``, or why there is none: it needs a version line, headers, its length, both line ends and its digests."""
    if not VERSION.match(data, at):
        return None, "no version line"
    end = data.find(END, at)
    if end < 0:
        return None, "headers do not end"
    headers: dict[str, str] = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None, "bad header line"
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return None, "no content length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != END:
        return None, "record does not end where its length says"
    block = data[start:stop]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != base32_sha1(block):
        return None, "block digest differs"
    payload = block.partition(END)[2]
    want = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and want.startswith("sha1:") and want[5:] != base32_sha1(payload):
        return None, "payload digest differs"
    return Record(at, stop + 4 - at, headers.get("warc-type", ""), None, headers, block), ""


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content and compressed length of the gzip member at ``at``; with a reason, what came out of it before it failed a check."""
    d, out, pos = zlib.decompressobj(wbits=31), [], at
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(data[pos : pos + 65536]))
            pos += 65536
    except zlib.error as e:
        # once more, byte by byte where it fails, as the failing call returns nothing
        d, out, stop = zlib.decompressobj(wbits=31), [], pos
        for p in range(at, stop, 65536):
            out.append(d.decompress(data[p : p + 65536]))
        try:
            while pos < len(data):
                out.append(d.decompress(data[pos : pos + 1]))
                pos += 1
        except zlib.error:
            pass
        return b"".join(out), pos - at, f"gzip: {e}"
    if not d.eof:
        return b"".join(out), len(data) - at, "gzip member is cut off"
    return b"".join(out), min(pos, len(data)) - len(d.unused_data) - at, ""


def _within(inner: bytes, at: int, length: int) -> tuple[list[Record], str]:
    """Valid records of the content of the member at ``at``, gaps between them, and why the first gap is one; nothing if no record is valid."""
    found, pos, lost, reason, first = [], 0, None, "", ""
    gap = lambda end: Record(at, length, "gap", f"{reason} (bytes {lost} to {end} of the member's content)")
    while pos < len(inner):
        r, why = parse(inner, pos)
        if r is None:
            if lost is None:
                lost, reason, first = pos, why, first or why
            following = VERSION.search(inner, pos + 1)
            pos = following.start() if following else len(inner)
            continue
        if lost is not None:
            found.append(gap(pos))
            lost = None
        pos += r.length
        r.offset, r.length = at, length
        found.append(r)
    if lost is not None and found:
        found.append(gap(len(inner)))
    return found, first


def _step(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """Records at ``at`` and where they end; with a reason those that a damaged member gave before it failed, if any, and ``at``."""
    if data.startswith(MAGIC, at):
        inner, length, broken = _inflate(data, at)
        found, why = _within(inner, at, length)
        if broken or inner and not found:
            return found, at, broken or why
        return found, at + length, ""
    r, why = parse(data, at)
    return ([r], at + r.length, "") if r else ([], at, why)


def salvage(data: bytes) -> Iterator[Record]:
    """All valid records of an archive, and a gap for each run of bytes that none covers.

    A record of a gzip member has the member's offset and length. A damaged record inside a
    member with others is a gap with that offset and length, whose reason names the bytes
    of the content. What a damaged member gives before it fails comes before its gap.
    """
    at, lost, reason = 0, None, ""
    taken, limit = [], 0  # records of the last damaged member, and how far it was read
    while at < len(data):
        found, end, why = _step(data, at)
        if end > at:
            # a member that stores without packing shows its records to the search once more
            if at < limit and found and not data.startswith(MAGIC, at) and any(found[0].headers == r.headers and found[0].block == r.block for r in taken):
                at = end
                continue
            if lost is not None:
                yield Record(lost, at - lost, "gap", reason)
                lost = None
            yield from found
            at = end
            continue
        if found:
            if lost is not None:
                yield Record(lost, at - lost, "gap", reason)
                lost = None
            yield from found
            taken, limit = found, at + found[0].length
        if lost is None:
            lost, reason = at, why
        following = START.search(data, at + 1)
        at = following.start() if following else len(data)
    if lost is not None:
        yield Record(lost, at - lost, "gap", reason)


def _members(batches: Iterable[pa.RecordBatch], level: int, most_bytes: int, most_records: int) -> Iterator[pa.RecordBatch]:
    """Members with the number of the archive, within this task, that each goes to."""
    archive, size, n = 0, 0, 0
    for batch in small_batches(batches):
        out, where = [], []
        for r in batch.to_pylist():
            data = member(record(r["kind"], r["page_id"], r["url"], r["payload"] or b"", r["first_id"]), level)
            if n and (size + len(data) > most_bytes or n >= most_records):
                archive, size, n = archive + 1, 0, 0
            size, n = size + len(data) + 1, n + 1
            out.append(data)
            where.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(where, pa.int32())], names=["member", "archive"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, records_per_archive: int = 4000, bytes_per_archive: int = 256 << 20, level: int = 6) -> None:
    """One record per row below ``path``, in archives that end before either bound is passed (a larger record stands alone).

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    id is a response and the others are revisits that refer to it. Rows that share the
    smallest id and the payload are all responses, as nothing tells them apart; a null id
    is larger than any other, and if all ids of a payload are null all are responses. A
    null html is an empty payload.
    """
    lean(pages.sparkSession)
    raw = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # only payloads that occur more than once need a partner: partial counts go to the shuffle, not the texts
    shared = rows.filter(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    dealt = rows.join(shared, ["sha1", "size"], "left").withColumn("kind", F.when(revisit, "revisit").otherwise("response"))
    out = dealt.select("kind", "page_id", "url", "payload", "first_id").mapInArrow(lambda it: _members(it, level, bytes_per_archive, records_per_archive), "member binary, archive int")
    # the archives of a task follow each other, so the sink need not sort members to keep them apart
    spark, name = pages.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        out.select(F.col("member").cast("string").alias("value"), "archive").write.option("lineSep", "\x00").partitionBy("archive").text(path)
    finally:
        spark.conf.set(name, before)


SCHEMA = "archive string, offset long, length long, kind string, reason string, page_id string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def _read(batches: Iterable[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["archive", "offset", "length", "kind", "reason", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    ident = lambda h, k: (h.get(k) or "").strip("<>").removeprefix(PAGE) or None
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            got, size = [], 0
            for r in salvage(content.as_py() or b""):
                h = r.headers or {}
                _, _, payload = r.block.partition(END)
                told = re.search(rb"(?i)\r\nContent-Length: *(\d+)", r.block[:4096])
                full = int(told[1]) if r.kind == "revisit" and told else len(payload) if r.headers else None
                digest = base32_sha1(payload) if r.kind == "response" else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                got.append((path, r.offset, r.length, r.kind, r.reason, ident(h, "warc-record-id"), h.get("warc-target-uri"), payload if with_payload and r.headers else None, full, digest, ident(h, "warc-refers-to")))
                size += len(payload)
                if size > 8 << 20 or len(got) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=names)
                    got, size = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names=names)


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record or gap (kind ``gap``, with offset, length and reason) of the archives below ``path``.

    An archive passes through one task whole, so archives should stay well below an
    executor's memory; the writer rolls them by bytes and number of records.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(lambda it: _read(it, with_payload), SCHEMA)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    See :func:`write_archives` for ties, repeated rows and nulls. Other columns are not
    carried; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path, with_payload=False).filter("kind <> 'gap'")
    number = lambda c: F.expr(f"try_cast({c} as long)").alias(c)
    return back.select(number("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to"))
