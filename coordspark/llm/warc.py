"""WARC writing and sequential reading.

Writing: one gzip member per record, archives of bounded size in the shared folder, one manifest row per finished
archive (a lost task leaves a file that no manifest names). Payloads of at least ``MIN_REVISIT_BYTES`` that repeat
become revisit records of the record with the smallest page_id. Reading: each archive is read front to back in
chunks with incremental zlib decompression; records are framed by Content-Length, and block and payload digests are
verified, as is the end of each member.

Defined results: a null html is an empty payload; payloads under the limit are always responses; rows that repeat
the smallest page_id of a payload are all responses; null urls are written as empty; white space and control
characters in urls are percent-encoded; an empty table gives no archive and no rows; extra columns are ignored.
A damaged archive raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.llm.common import bound_batches, new_path, save

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16

_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to (null for responses).

    Counts per digest are pre-aggregated; only digests that repeat are kept and joined, so a payload that a large part
    of the pages share is one small row, and its pages are a skewed side that Spark can split.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = save(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id"), "warc-firsts"
    )
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    head = _HTTP.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_warc(pages: DataFrame, out_dir: str | None = None, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the archives below ``out_dir`` (default: a new scratch folder); returns the manifest, which is stored."""
    bound_batches(pages.sparkSession)
    spark = pages.sparkSession
    out_dir = out_dir or new_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out_dir)
        sink, path, n, size = None, "", 0, 0

        def done():
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, n, size = f"{out_dir.rstrip('/')}/{name}", 0, 0
                    sink = store.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(page_id, url, payload, digest, refers_to))
                sink.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield done()
                    sink = None
        if sink is not None:
            yield done()

    return save(mark_revisits(pages, min_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


class _Members:
    """Reads decompressed bytes of one gzip member after another."""

    def __init__(self, source: BinaryIO, chunk: int = CHUNK):
        self.source, self.chunk, self.raw, self.buf, self.z = source, chunk, b"", bytearray(), None

    def begin(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if not self.raw:
            self.raw = self.source.read(self.chunk)
        if not self.raw:
            return False
        self.z, self.buf = zlib.decompressobj(31), bytearray()
        return True

    def fill(self) -> bool:
        """Decompress a little more of this member; False at its end."""
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(self.chunk)
            if not self.raw:
                raise ValueError("archive ends within a gzip member")
        self.buf += self.z.decompress(self.raw, self.chunk)
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def line_block(self) -> bytes:
        """Up to and without the next empty line."""
        seen = 0
        while (at := self.buf.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.buf)
            if not self.fill():
                raise ValueError("record head without an end")
        head = bytes(self.buf[:at])
        del self.buf[: at + 4]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in parts."""
        while n:
            if not self.buf and not self.fill():
                raise ValueError("record shorter than its Content-Length")
            part = bytes(self.buf[:n])
            del self.buf[: len(part)]
            n -= len(part)
            yield part

    def end(self) -> None:
        """The two line ends after a record, then the end of the member, whose checksum zlib verifies."""
        while self.fill():
            pass
        if self.buf != b"\r\n\r\n":
            raise ValueError("record longer than its Content-Length")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix(f"<{_ID}").rstrip(">")
    return int(digits) if digits else None


def read_records(source: BinaryIO, chunk: int = CHUNK, keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive in order; digests and frames are verified."""
    members = _Members(source, chunk)
    while members.begin():
        warc = _fields(members.line_block())
        length = int(warc["content-length"])
        block, payload, head, kept = hashlib.sha256(), hashlib.sha256(), bytearray(), []
        http = None
        size = 0
        for part in members.take(length):
            block.update(part)
            if http is None:
                head += part
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                http, part = _fields(bytes(head[:at])), bytes(head[at + 4 :])
            payload.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        members.end()
        revisit = warc["warc-type"] == "revisit"
        digest = warc["warc-payload-digest"].removeprefix("sha256:")
        if http is None or block.hexdigest() != warc["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"block digest of {warc.get('warc-record-id')} differs")
        if not revisit and (payload.hexdigest() != digest or size != int(http["content-length"])):
            raise ValueError(f"payload digest of {warc.get('warc-record-id')} differs")
        yield {
            "page_id": _page(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": _page(warc.get("warc-refers-to")),
            "payload_bytes": int(http["content-length"]), "payload_digest": digest,
        } | ({"payload": b"".join(kept)} if keep_payload else {})


def read_warc(spark: SparkSession, manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of all archives that the manifest names. A revisit's payload is that of the record it refers to."""
    schema = RECORD + ", payload binary" * keep_payload
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * keep_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = fs.FileSystem.from_uri(path)
                rows, n = [], 0
                with store.open_input_stream(where, compression=None) as source:
                    for row in read_records(source, keep_payload=keep_payload):
                        rows.append(row)
                        n += 1
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows = []
                if n != records:
                    raise ValueError(f"{path} holds {n} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    parts = max(1, min(manifest.count(), 100_000))
    return manifest.select("path", "records").repartition(parts).mapInArrow(run, schema)
