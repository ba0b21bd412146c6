"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent Zstandard frames; a bundle ends with the
seek table of the seekable format (a skippable frame: compressed and plain size
of each frame, their number, a descriptor and a magic number). The index maps a
record's identifier to bundle, frame and offset inside the frame, so that one
record is read by decompressing one frame.

Bundles are rows (bundle, bytes) of a table in shared storage: Spark's commit
protocol then makes a repeated or lost task harmless. Each row's bytes are a
complete file.

Edge cases: null html is an empty payload; equal payloads of at least MIN_REVISIT
bytes have one response, that with the largest identifier (null identifiers
come first), the others are revisits; rows that share the response's identifier and
payload are responses like it, and payloads that only rows without an identifier have
are all responses. An empty table makes no bundle; other columns are not read.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

MIN_REVISIT = 1000
#: Plain bytes of a frame and of a bundle at which the next begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 16, 4 << 20
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def record(kind: str, ident: str, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC record with an HTTP response block; a revisit keeps the HTTP head alone."""
    clean = (url or "").replace("\r", " ").replace("\n", " ")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    extra = f"WARC-Refers-To: <urn:page:{refers}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" if kind == "revisit" else ""
    fields = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{ident}>\r\nWARC-Target-URI: {clean}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\n{extra}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return fields.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Fields, payload and end of the record that starts at `at`."""
    split = raw.index(b"\r\n\r\n", at)
    lines = raw[at:split].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    begin, size = split + 4, int(fields["Content-Length"])
    block = raw[begin : begin + size]
    return fields, block[block.index(b"\r\n\r\n") + 4 :], begin + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(raw: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of each frame, from the footer alone."""
    n, descriptor, magic = struct.unpack("<IBI", raw[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    begin = len(raw) - 9 - n * width
    if struct.unpack_from("<II", raw, begin - 8) != (_SKIPPABLE, n * width + 9):
        raise ValueError("a damaged seek table")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", raw, begin + i * width)
        out.append((at, c, d))
        at += c
    return out


class Bundle:
    """Collects records; frames are closed at FRAME_BYTES."""

    def __init__(self) -> None:
        self.out, self.frames, self.open, self.size, self.index = io.BytesIO(), [], [], 0, []
        self.zip = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.plain = 0

    def add(self, ident: str, raw: bytes) -> None:
        self.index.append((ident, len(self.frames), self.size, len(raw)))
        self.open.append(raw)
        self.size += len(raw)
        self.plain += len(raw)
        if self.size >= FRAME_BYTES:
            self.close()

    def close(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.frames.append((len(packed), self.size))
            self.out.write(packed)
            self.open, self.size = [], 0

    def bytes(self) -> bytes:
        self.close()
        return self.out.getvalue() + seek_table(self.frames)


def read_record(raw: bytes, frame: int, offset: int) -> tuple[dict, bytes]:
    """One record of a bundle: seek table, one frame, one parse."""
    at, size, plain = read_seek_table(raw)[frame]
    return parse(zstandard.ZstdDecompressor().decompress(raw[at : at + size], max_output_size=plain), offset)[:2]


BUNDLE_SCHEMA = "bundle string, bytes binary, ids array<string>, frames array<int>, offsets array<int>, lengths array<int>"


def decided(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """key, url, html, digest, and refers_to: the identifier of the response (null for responses).

    Digests are counted by partial sums first, and only digests that repeat are
    joined back, so a payload that a third of all pages share is no large group.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    same = base.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first")
    joined = base.join(same, "digest", "left")
    return joined.withColumn("refers_to", F.when((F.col("n") >= min_revisit) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))).drop("first", "n")


def bundles(records: DataFrame) -> DataFrame:
    """Rows of decided() as bundles with the index of their records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        name, n, b = uuid.uuid4().hex, 0, Bundle()

        def flush() -> pa.RecordBatch:
            ids, frames, offsets, lengths = zip(*b.index, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([f"{name}-{n:05d}.warc.zst"]), pa.array([b.bytes()], pa.binary()), pa.array([ids], pa.list_(pa.string())), *(pa.array([x], pa.list_(pa.int32())) for x in (frames, offsets, lengths))], names=["bundle", "bytes", "ids", "frames", "offsets", "lengths"])

        for batch in batches:
            for key, url, html, digest, refers in zip(*batch.columns, strict=True):
                key, url, refers = key.as_py(), url.as_py(), refers.as_py()
                b.add(str(key), record("response" if refers is None else "revisit", str(key), url, html.as_py().encode("utf-8", "surrogatepass"), digest.as_py(), None if refers is None else str(refers)))
                if b.plain >= BUNDLE_BYTES:
                    yield flush()
                    n, b = n + 1, Bundle()
        if b.index:
            yield flush()

    cols = records.select(F.col("key").cast("string"), "url", "html", "digest", F.col("refers_to").cast("string"))
    return cols.mapInArrow(run, BUNDLE_SCHEMA)


def read_back(df: DataFrame, check_index: bool = True) -> DataFrame:
    """Each record of the bundles: ident, record_type, digest, payload_bytes (of the record's own payload), refers_to, payload.

    With check_index each frame's records are met at the offsets that the index has for them.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, ids, frames, offsets in zip(batch.column("bytes"), batch.column("ids"), batch.column("frames"), batch.column("offsets"), strict=True):
                raw, ids, frames, offsets = raw.as_py(), ids.as_py(), np.array(frames.as_py()), offsets.as_py()
                unzip, table_ = zstandard.ZstdDecompressor(), read_seek_table(raw)
                for f, (at, size, plain) in enumerate(table_):
                    data, out = unzip.decompress(raw[at : at + size], max_output_size=plain), []
                    for i in np.flatnonzero(frames == f).tolist():
                        fields, payload, _ = parse(data, offsets[i])
                        ident = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if check_index and (ident != ids[i] or (fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest)):
                            raise ValueError(f"record {ids[i]} isn't where the index has it")
                        refers = fields.get("WARC-Refers-To")
                        out.append((ident, fields["WARC-Type"], digest, len(payload), refers and refers[len("<urn:page:") : -1], payload))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["ident", "record_type", "digest", "own_bytes", "refers_to", "payload"])

    return df.mapInArrow(run, "ident string, record_type string, digest string, own_bytes long, refers_to string, payload binary")


def archive(pages: DataFrame) -> DataFrame:
    """Writes the bundles of pages to shared storage and gives them back as a table."""
    return staged(bundles(decided(pages)), "warc")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_back(archive(table(spark, sf_dir, "pages"))).drop("payload")
    got = staged(got, "warc-index")
    # a revisit's length is that of the response it refers to, by its digest as well: identifiers may repeat
    asked = got.where("refers_to IS NOT NULL").select("refers_to", "digest").distinct()
    full = got.where("record_type = 'response'").select(F.col("ident").alias("refers_to"), "digest", F.col("own_bytes").alias("full_bytes")).distinct().join(asked, ["refers_to", "digest"], "left_semi")
    out = got.join(full, ["refers_to", "digest"], "left")
    number = lambda c: F.when(F.col(c) == "None", None).otherwise(F.col(c)).cast("long")
    return out.select(number("ident").alias("page_id"), F.coalesce("full_bytes", "own_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS m FROM p WHERE octet_length(b) >= 1000 GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN octet_length(b) >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(b) >= 1000 AND page_id <> m THEN m END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
