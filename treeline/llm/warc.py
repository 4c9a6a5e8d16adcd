"""WARC archives: one gzip member a record, written by tasks to the shared folder and read back record by record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm._common import bounded_batches, fresh_path, lookup, materialize, texts_of

#: Bytes read at once, and compressed bytes after which an archive is closed.
CHUNK, ARCHIVE = 1 << 16, 256 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """One record: its named fields (lower case), its block as a string of bytes."""

    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def http(self) -> tuple[dict[str, str], bytes]:
        """The block's HTTP fields (lower case) and payload."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return _fields(head.split(b"\r\n")[1:]), payload


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines if x)}


def encode_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, original: bool) -> bytes:
    """A gzip member: a response with its payload, or a revisit that has its HTTP fields alone and names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if original else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        *([] if original else [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"]),
        f"Content-Length: {len(block)}",
    ]
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    found = urn.rpartition(":")[2].rstrip(">")
    return None if found == "none" else int(found)


class Reader:
    """Reads records from a stream one after another; holds one record at most, and a chunk of what follows."""

    def __init__(self, stream):
        self.stream, self.ahead = stream, b""

    def _member(self) -> Iterator[bytes]:
        """The inflated pieces of the next gzip member; ends after it, with what was read beyond kept for the next."""
        z = zlib.decompressobj(31)
        while not z.eof:
            data = self.ahead or self.stream.read(CHUNK)
            if not data:
                raise ValueError("an archive ends within a record")
            self.ahead = b""
            piece = z.decompress(data, CHUNK)
            if piece:
                yield piece
            while z.unconsumed_tail and not z.eof:
                piece = z.decompress(z.unconsumed_tail, CHUNK)
                if piece:
                    yield piece
        self.ahead = z.unused_data

    def __iter__(self) -> Iterator[Record]:
        while True:
            if not self.ahead:
                self.ahead = self.stream.read(CHUNK)
                if not self.ahead:
                    return
            member, held = self._member(), bytearray()
            while (end := held.find(b"\r\n\r\n")) < 0:
                piece = next(member, None)
                if piece is None:
                    raise ValueError("a record has no end of its fields")
                held += piece
            version, *lines = bytes(held[:end]).split(b"\r\n")
            if not version.startswith(b"WARC/"):
                raise ValueError("a member does not begin with a WARC record")
            record = Record(_fields(lines))
            size = int(record.fields["content-length"])
            del held[: end + 4]
            for piece in member:
                held += piece
                if len(held) > size + 4:
                    raise ValueError("a record is longer than its Content-Length")
            if bytes(held[size:]) != b"\r\n\r\n":
                raise ValueError("a record does not end after its Content-Length")
            record.block = bytes(held[:size])
            if (said := record.fields.get("warc-block-digest")) and said != f"sha1:{digest(record.block)}":
                raise ValueError("a block does not match its digest")
            if record.fields["warc-type"] == "response" and (said := record.fields.get("warc-payload-digest")) and said != f"sha1:{digest(record.http()[1])}":
                raise ValueError("a payload does not match its digest")
            yield record


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to, original: which record is a revisit, and of which.

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses (several if
    they share it), the others revisit it; smaller payloads are all responses. NULL html is an empty payload; a NULL
    page_id is a response only if no equal payload has an id. Digests of any share of the rows are looked up by lookup().
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("_digest"))
    groups, _ = materialize(own.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")), "digests")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    found = lookup(own, groups, "_digest", "_n", total, F.col("page_id"))
    original = (F.octet_length(F.coalesce("html", F.lit(""))) < least) | F.col("_first").isNull() | F.coalesce(F.col("page_id") == F.col("_first"), F.lit(False))
    return found.select("page_id", "url", "html", original.alias("original"), F.when(~original, F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write archives below folder; returns their list (file, records). Files of lost tasks are in no list."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

        for b in bounded_batches(it):
            for i, url, payload, original, refers_to in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), texts_of(b.column("html")), b.column("original").to_pylist(), b.column("refers_to").to_pylist(), strict=True):
                if out is None:
                    name, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                data = encode_record(i, url, payload, digest(payload), refers_to, original)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(decide(pages, least).mapInArrow(run, "file string, records long"), "archives")[0]


def read(files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the listed archives.

    A revisit's payload length and digest are those that its HTTP and WARC fields state of the full payload.
    """

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in it:
            for name in b.column("file").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(name, compression=None) as f:
                    for r in Reader(f):
                        http, payload = r.http()
                        revisit = r.fields["warc-type"] == "revisit"
                        rows.append((_page_id(r.fields["warc-record-id"]), int(http["content-length"]) if revisit else len(payload), r.fields["warc-payload-digest"].removeprefix("sha1:"), r.fields["warc-type"], _page_id(r.fields["warc-refers-to"]) if revisit else None))
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = max(1, files.count())
    return files.select("file").repartition(min(n, 4096)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def write_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive pages in the shared folder and read every record back. An empty table gives no archive and no row."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(write(pages, folder, least), folder)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((CAST('0x' || substr(hex || '0', CAST(i * 5 // 4 + 1 AS INTEGER), 2) AS INTEGER) >> CAST(3 - (i * 5) % 4 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
