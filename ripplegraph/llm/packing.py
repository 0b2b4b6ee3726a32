"""Packing by power-of-two decomposition.

A document of n tokens (its end token included) is split into pieces whose lengths are powers of two: as many of
``max_len`` as fit, then the binary digits of the rest, largest first.  Each piece is a sequence of its own; sequences
of equal length form a bucket (column ``bucket``, the length's logarithm), and batches are drawn within buckets.  So
no sequence crosses documents and none is padded.

Defined results: a null or empty text is the end token alone; null or repeated ids are documents like any other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held, released

_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long"


class PieceCache(dict):
    """Chunk between white space -> its ids as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks; nor does it
    join Latin letters, whose case it drops, and ASCII punctuation behind them.  One letter is left out, the capital I
    with a dot: in lower case its dot is a mark of its own, which the tokenizer does join to what follows.  Chunks with
    capitals or punctuation are put together each time, and beyond ``limit`` others are encoded each time, so that memory
    stays bounded (about 45 MB); a worker lets its cache go when another operator's task begins.
    """

    _PARTS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-/:-@\\[-`{-~]*)")

    @classmethod
    def of_file(cls, tokenizer_path: str) -> PieceCache:
        from tokenizers import Tokenizer

        return cls(Tokenizer.from_file(tokenizer_path).encode)

    def __init__(self, encode, limit: int = 250_000):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        parts = self._PARTS.fullmatch(chunk)
        if parts and (parts[2] or chunk.lower() != chunk):
            return self[parts[1].lower()] + (self[parts[2]] if parts[2] else b"")
        value = array.array("I", self.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(self) < self.limit and len(chunk) < 100:
            self[chunk] = value
        return value


def cut_points(n: int, max_len: int) -> list[int]:
    """The lengths of the pieces of a document of n tokens; max_len is a power of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, bucket, sequence_id, offset."""
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")
    bound_batches(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = held(f"packing {tokenizer_path}", lambda: PieceCache.of_file(tokenizer_path)).__getitem__
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            doc, start, length, ids, tokens = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # only these: further white space of Unicode stays in the chunks and is dropped by the tokenizer
                own = b"".join(map(ids_of, (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) + end
                at, n = 0, len(own) // 4
                for size in cut_points(n, max_len):
                    doc.append(doc_id), start.append(at), length.append(size), tokens.append(n)
                    ids.append(own[4 * at : 4 * (at + size)])
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(split, f"packing {tokenizer_path}"), _OUT)
    return pieces.withColumns({
        "bucket": F.log2(F.col("length").cast("double")).cast("int"),
        "sequence_id": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
    })


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
