"""WARC archives: a writer with revisit records and a reader that salvages what follows broken bytes.

Every record is a gzip member of its own. Spark's text writer writes the members, with an empty member as its line end,
so any file system that Spark reaches will do and a lost task's file is written again whole. A file holds a bounded
number of records, because a reader holds one file.

Of records with equal payloads of at least `min_bytes`, the one with the largest id is the response; the others become
revisits that refer to it and carry its HTTP header without the payload.

Reader: where a member does not inflate, a record's length or header makes no sense, or a digest differs, it looks for
the next gzip member that inflates whole, or the next version line, goes on there, and logs the bytes between with the
reason. Plain (uncompressed) archives and members of several records are read the same way.

Defined results: a null payload is empty; a null id is written as an empty one and read as null, and refers to others or
is a response like any row; rows that repeat the largest id are all responses; a null or empty address is left out; an
empty table makes no records; other columns are not archived.
"""
from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fareloom.llm.common import binary_files

RECORDS_PER_FILE = 5_000
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:fareloom:page:"
_MAGIC = b"\x1f\x8b\x08"
# An empty gzip member.
_END = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _sha1(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def build_record(page: str | None, url: str | None, date: str, payload: bytes | None, size: int, digest: str,
                 revisit: bool, refers_to: str | None) -> bytes:
    """The bytes of one record. `size` and `digest` (hex SHA-1) are those of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page is None else page}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: {_sha1(digest)}",
        f"WARC-Block-Digest: {_sha1(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    return b"\r\n".join([VERSION, *(h.encode() for h in head), b"", block, b"", b""])


def write_archives(
    pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html",
    date: str = "2024-01-01T00:00:00Z", min_bytes: int = 1000, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write one record per row of `pages` below `path`."""
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # Only digests that occur more than once matter, and they are counted before anything is joined.
    shared = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(
        F.max("page").alias("keeper"), F.count("*").alias("n")).filter(F.col("n") > 1).select(
        F.col("digest").alias("same"), "keeper")
    met = rows.join(shared, F.col("digest") == F.col("same"), "left")
    revisit = F.col("same").isNotNull() & (F.col("size") >= min_bytes) & ~F.col("page").eqNullSafe(F.col("keeper"))
    source = met.select(
        F.col("page").cast("string").alias("page"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "size",
        "digest", revisit.alias("revisit"), F.col("keeper").cast("string").alias("keeper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                made = [
                    _gzip(build_record(r["page"], r["url"], date, r["payload"], r["size"], r["digest"], r["revisit"], r["keeper"]))
                    for r in batch.slice(low, 256).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    records = source.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("encoding", "ISO-8859-1").option("lineSep", _END.decode("latin-1")).option(
        "maxRecordsPerFile", records_per_file).text(path)


class Broken(Exception):
    """Why bytes cannot be read as a record."""


def _member(raw: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at `at`; the checksum in its trailer is checked."""
    unpacker, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            piece = raw[pos:pos + 65536]
            if not piece:
                raise Broken("member ends early")
            out.append(unpacker.decompress(piece))
            pos += len(piece)
    except zlib.error as error:
        raise Broken(f"member does not inflate: {error}") from None
    return b"".join(out), pos - len(unpacker.unused_data)


def _digest_holds(stated: bytes | None, data: bytes) -> bool:
    if not stated or not stated.lower().startswith(b"sha1:"):
        return True
    value, own = stated[5:].decode("latin-1"), hashlib.sha1(data)
    return value.lower() == own.hexdigest() or value.upper() == base64.b32encode(own.digest()).decode()


def _record(raw: bytes, at: int) -> tuple[dict, int]:
    """The record at `at` of plain bytes, and its end."""
    if not re.compile(rb"WARC/\d\.\d\r\n").match(raw, at):
        raise Broken("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Broken("header does not end")
    fields = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if not fields.get(b"content-length", b"").isdigit():
        raise Broken("no content length")
    start, end = stop + 4, stop + 4 + int(fields[b"content-length"])
    if raw[end:end + 4] != b"\r\n\r\n":
        raise Broken("record does not end where its length says")
    block = raw[start:end]
    if not _digest_holds(fields.get(b"warc-block-digest"), block):
        raise Broken("block digest differs")
    kind, payload, size = fields.get(b"warc-type", b"").decode("latin-1"), block, len(block)
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        size = int(length[1]) if kind == "revisit" and length else len(payload)
    stated = fields.get(b"warc-payload-digest")
    if kind == "response" and not _digest_holds(stated, payload):
        raise Broken("payload digest differs")
    digest = hashlib.sha1(payload).hexdigest()
    if kind == "revisit" and stated:
        value = stated.partition(b":")[2].decode("latin-1")
        digest = base64.b32decode(value).hex() if len(value) == 32 else value.lower()

    def own_id(name: bytes) -> str | None:
        value = fields.get(name, b"").decode("utf-8", "replace").strip("<>").removeprefix(_ID)
        return value or None

    uri = fields.get(b"warc-target-uri")
    return {
        "record_type": kind, "id": own_id(b"warc-record-id"), "url": None if uri is None else uri.decode("utf-8", "replace"),
        "refers_to": own_id(b"warc-refers-to"), "payload_bytes": size, "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }, end + 4


def _next(raw: bytes, at: int, gzip: bool) -> int:
    """Where reading can go on after broken bytes at `at`: the next whole member or version line, or the end."""
    lines, line = re.compile(rb"(?:(?<=\n)|\A)WARC/\d\.\d\r\n"), None
    found = lines.search(raw, at + 1)
    line = found.start() if found else len(raw)
    while gzip:
        magic = raw.find(_MAGIC, at + 1, line)
        if magic < 0:
            break
        try:
            _member(raw, magic)
            return magic
        except Broken:
            at = magic
    return line


def salvage(raw: bytes, gzip: bool = True) -> Iterator[dict]:
    """Records and gaps of one archive file, in order. Offsets of what lies in a member are the member's."""
    at = 0
    while at < len(raw):
        reason, inner = None, None
        try:
            if gzip and raw.startswith(_MAGIC, at):
                inner, end = _member(raw, at)
            else:
                fields, end = _record(raw, at)
                yield {"kind": "record", "offset": at, "end": end, **fields}
        except Broken as broken:
            reason, end = str(broken), _next(raw, at, gzip)
        if reason:
            yield {"kind": "gap", "offset": at, "end": end, "reason": reason}
        elif inner:
            for part in salvage(inner, gzip=False):
                yield {**part, "offset": at, "end": end}
        at = end


_FIELDS = ["kind", "file", "offset", "end", "reason", "record_type", "id", "url", "refers_to", "payload_bytes",
           "payload_digest", "payload"]
SCHEMA = ("kind string, file string, offset long, end long, reason string, record_type string, id string, url string, "
          "refers_to string, payload_bytes long, payload_digest string, payload binary")


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records and gaps of the archives below `path`; `kind` says which. Without `payload` that column is null."""
    def rows(item):
        name, raw = item
        for found in salvage(raw):
            if not payload:
                found["payload"] = None
            yield tuple(name if f == "file" else found.get(f) for f in _FIELDS)

    return spark.createDataFrame(binary_files(spark, path).flatMap(rows), SCHEMA)


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined bytes: file, offset, end, reason."""
    return read.filter(F.col("kind") == "gap").select("file", "offset", "end", "reason")


def records(read: DataFrame) -> DataFrame:
    return read.filter(F.col("kind") == "record").drop("kind", "reason")
