"""WARC archives: a writer with revisit records and a splittable reader.

Writer: one gzip member per record.  Among records with equal payloads of at least ``min_bytes`` bytes, that with the
smallest id is a ``response`` and the others are ``revisit`` records without payload; smaller payloads are all stored.
Rows that repeat that smallest id are responses all; rows without an id are stored and never referred to.  Files are
written by Spark's own text writer, so its commit protocol covers retries and lost executors on any Hadoop store.

Reader: the archives are cut into byte ranges.  A task scans its range for the gzip magic, takes a candidate for a
member only if its first bytes decode to a WARC header, and owns the records that start inside its range, reading past
the end of the range for the last one.

Defined results: a null payload is empty; repeated rows are records of their own; an empty table gives an archive
without records and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, hadoop_fs, released

#: A gzip member with nothing in it. It ends a row's bytes where these would not end in a zero byte of their own.
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
_MAGIC = b"\x1f\x8b\x08"
_FIELDS = pa.schema([("record", pa.binary())])
_PARSED = pa.schema([
    ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()), ("file", pa.string()), ("offset", pa.int64()),
])


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 100) -> DataFrame:
    """The pages with payload (binary), digest and refers_to (null for responses)."""
    scratch = Scratch(pages.sparkSession, "warc-digests")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256))
    large = pages.select(F.col(id_col).alias("id"), payload.alias("payload")).filter((F.length("payload") >= min_bytes) & F.col("id").isNotNull())
    groups = large.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    groups = scratch.write(groups.select("digest", "first_id"), "groups")
    refers = F.when(F.col(id_col).isNull() | (F.length("payload") < min_bytes) | (F.col("first_id") == F.col(id_col)), None).otherwise(F.col("first_id"))
    return rows.join(groups, "digest", "left").withColumn("refers_to", refers).drop("first_id")


def _member(record_id: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    clean = lambda s: re.sub(r"[\r\n]+", " ", s)
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {date}"]
    head += [f"WARC-Record-ID: <urn:page:{record_id}>"] if record_id is not None else []
    head += [f"WARC-Target-URI: {clean(uri)}"] if uri is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write a record for each page to gzip archives in the folder ``path``, a file for each task."""
    spark = pages.sparkSession
    bound_batches(spark, 500)
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    rows = with_revisits(pages.select(F.col(id_col).alias("id"), url.alias("url"), F.col(payload_col).alias("html")), "id", "html", min_bytes)
    rows = rows.select(F.col("id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, uri, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers_to")), strict=True):
                member = _member(rid, uri, payload, digest, refers, date)
                out.append((member if member[-1] == 0 else member + _EMPTY_MEMBER)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=_FIELDS)

    # The text writer puts the separator, a zero byte, after each row: the last byte of the member, which was cut off.
    rows.mapInArrow(released(encode), "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


@dataclass(frozen=True)
class Range:
    file: str
    start: int
    end: int


def byte_ranges(spark: SparkSession, path: str, split_bytes: int) -> list[Range]:
    """Ranges over the files of a folder (or over one file); names starting with _ or . are left out."""
    fs, root = hadoop_fs(spark, path)
    ranges = []
    for status in fs.listStatus(root):
        name, length = status.getPath().getName(), status.getLen()
        if status.isFile() and name[0] not in "_.":
            ranges += [Range(status.getPath().toString(), at, min(at + split_bytes, length)) for at in range(0, length, split_bytes)]
    return ranges


class RangeScanner:
    """The records of one archive that start in [start, end)."""

    def __init__(self, read_at, length: int, chunk: int = 1 << 20):
        self.read_at, self.length, self.chunk = read_at, length, chunk

    def _decode(self, at: int, limit: int | None) -> tuple[bytes, int] | None:
        """The member's content (its first bytes, if ``limit``) and where it ends; None if there is no valid member."""
        inflate, out, pos = zlib.decompressobj(31), bytearray(), at
        try:
            while not inflate.eof and pos < self.length and (limit is None or len(out) < limit):
                data = self.read_at(pos, 512 if limit else self.chunk)
                out += inflate.decompress(data) if limit is None else inflate.decompress(data, limit)
                pos += len(data)
        except zlib.error:
            return None
        if limit is None and not inflate.eof:
            return None
        return bytes(out), pos - len(inflate.unused_data)

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        at = start
        while (at := self._candidate(at, end)) is not None:
            head = self._decode(at, 16)
            if head is None or not head[0].startswith(b"WARC/1."):
                at += 1
                continue
            whole = self._decode(at, None)
            if whole is None:
                at += 1
                continue
            yield at, whole[0]
            at = whole[1]

    def _candidate(self, at: int, end: int) -> int | None:
        while at < end:
            data = self.read_at(at, min(self.chunk, end - at) + len(_MAGIC) - 1)
            if (k := data.find(_MAGIC)) >= 0 and at + k < end:
                return at + k
            at += self.chunk
        return None


def _length(value: str | None, other: int) -> int:
    """A length that a header states, or the other where it states none that is a number."""
    return int(value) if value is not None and value.isascii() and value.isdigit() else other


def parse_record(raw: bytes) -> dict | None:
    """Header fields and payload of one record; None if its header does not end.  Lengths that are no numbers are left out."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    payload = rest[: _length(fields.get("content-length"), len(rest))]
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").partition(":")[2] or None
    urn = lambda v: None if v is None else v.strip("<>").removeprefix("urn:page:")
    return {
        "record_type": kind, "record_id": urn(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "refers_to": urn(fields.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": _length(fields.get("x-payload-length"), len(payload)), "payload": payload,
        "digest_ok": kind == "revisit" or digest is None or hashlib.sha256(payload).hexdigest() == digest,
    }


def read_archives(spark: SparkSession, path: str, split_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives in ``path``: type, id, URI, refers_to, digest, length, payload, and where each starts.

    Ranges are read with pyarrow's file systems, so ``path`` is in a store that these reach from the executors.
    """
    bound_batches(spark, 500)
    ranges = byte_ranges(spark, path, split_bytes)
    table = spark.createDataFrame([(k, r.file, r.start, r.end) for k, r in enumerate(ranges)], "k int, file string, start long, end long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        rows, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                store, name = pafs.FileSystem.from_uri(r["file"].replace("file:/", "file:///") if re.match("file:/[^/]", r["file"]) else r["file"])
                with store.open_input_file(name) as f:
                    scanner = RangeScanner(lambda at, n, f=f: f.read_at(n, at), f.size())
                    for at, raw in scanner.records(r["start"], r["end"]):
                        if (record := parse_record(raw)) is not None:
                            rows.append(record | {"file": r["file"], "offset": at})
                            size += len(record["payload"])
                        if len(rows) >= 500 or size >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)

    # one range to a task
    dealt = table.repartitionByRange(max(1, len(ranges)), "k")
    return dealt.mapInArrow(released(scan), "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, digest_ok boolean, file string, offset long")
