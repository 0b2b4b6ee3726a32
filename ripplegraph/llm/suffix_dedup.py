"""Repeated passages by sparse suffix arrays.

Each text keeps the suffixes at its minimisers: the K-word positions with the least hash in some stretch of
``min_words`` words, so that every run of ``min_words`` words keeps a suffix, and copies of a run keep it at the same
place.  Suffixes whose first K words occur once only are let go.

The others are dealt by their first K words and sorted by their words, ``min_words`` of them (by Spark, on the words
themselves); each is compared with its neighbour, which gives the longest common prefixes.  What precedes them, read
backwards, is sorted and compared in the same way, which extends matches to the left.  Suffixes that share n words ahead
stand together in the one order, those that share o words behind in the other, so both orders' prefixes tell all suffixes
that agree on ``min_words`` words, however many of them lie ahead.  A suffix covers the union of its matches, and a text's
spans are the union of its suffixes: texts of any length are covered whole, for each run of ``min_words`` words in a
longer passage has a suffix of its own.

Equal texts are looked at once; if there are several, all their words are repeated.

Defined results: words are maximal runs of other than ASCII white space, A-Z lower-cased; null, empty and shorter texts
have no spans; repeats inside one text do not count, rows that repeat an id and its text do; a null id is an id like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, bound_batches, released, shuffle_parts, windows, words_of

#: Words of a minimiser; bytes beyond which a digest stands for a word, so that suffixes are bounded in bytes.
K, WORD_BYTES = 8, 40


def minimisers(hashes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the K-word runs that are least (the leftmost, if several) in some min_words words."""
    own = windows(hashes, K)
    width = min_words - K + 1
    if len(own) < width:
        return np.empty(0, np.int64), own[:0]
    # argmin of each window of ``width``: blocks of that width, least from the left and from the right
    at = np.arange(len(own))
    pad = -len(own) % width
    value = np.concatenate([own, np.full(pad, ~np.uint64(0))])
    place = np.concatenate([at, np.arange(len(own), len(own) + pad)])
    rows, index = value.reshape(-1, width), place.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1)
    new = np.ones_like(rows, bool)
    new[:, 1:] = rows[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, index, -1), axis=1).ravel()
    flipped, flipped_at = rows[:, ::-1], index[:, ::-1]
    behind = np.minimum.accumulate(flipped, axis=1)
    new = np.ones_like(rows, bool)
    new[:, 1:] = flipped[:, 1:] <= behind[:, :-1]
    behind_at = np.minimum.accumulate(np.where(new, flipped_at, len(value)), axis=1)[:, ::-1].ravel()
    first, last = behind_at[: len(own) - width + 1], ahead_at[width - 1 : len(own)]
    keep = np.unique(np.where(value[first] <= value[last], first, last))
    return keep, own[keep]


def _sketch(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_key, digest, n_words, at, hash (arrays) of the texts that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for doc_id, key, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = words_of(text)
                if len(words) >= min_words:
                    at, h = minimisers(hashes.array(words), min_words)
                    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                    rows.append((doc_id, key, digest, len(words), at.astype(np.int32), h.view(np.int64)))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_key", "digest", "n_words", "at", "hash"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return own.mapInArrow(released(run), "doc_id long, text_key long, digest binary, n_words int, at array<int>, hash array<long>")


def _bounded(word: bytes) -> bytes:
    """The word, or a digest of it if it is long or may be taken for one."""
    if len(word) > WORD_BYTES or word < b"\x02" or 0 in word:
        return b"\x01" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()
    return word


def _joined(words: list[bytes]) -> bytes:
    """The words, a space behind each: so many spaces in a common prefix are so many words."""
    return b" ".join(words) + b" " if words else b""


def _suffixes(texts: DataFrame, min_words: int) -> DataFrame:
    """h (hash of the first K words), ahead (the suffix, min_words of it), behind (what precedes it, backwards), node, pos."""
    reach = min_words - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for node, text, places in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = words_of(text)
                own = windows(hashes.array(words), K).view(np.int64)
                words = list(map(_bounded, words))
                turned = words[::-1]
                for at in places:
                    back = len(words) - at
                    rows.append((int(own[at]), _joined(words[at : at + min_words]), _joined(turned[back : back + reach]), node, at))
                    if len(rows) >= 2_000:
                        yield batch(rows)
                        rows = []
            yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=["h", "ahead", "behind", "node", "pos"])

    return texts.select("node", "text", "places").mapInArrow(released(run), "h long, ahead binary, behind binary, node binary, pos int")


def common_prefixes(h: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The words that each text of a sorted list shares with the one before it; -1 where h differs."""
    out = np.full(len(texts), -1)
    for at in range(1, len(texts), 1024):
        part = texts[at - 1 : at + 1024]
        width = max(map(len, part)) + 1
        m = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in part), np.uint8).reshape(len(part), width)
        differ = m[1:] != m[:-1]
        differ[:, -1] = True
        words = np.cumsum(m[1:] == 32, axis=1, dtype=np.int32)
        first = differ.argmax(axis=1)
        out[at : at + len(part) - 1] = np.where(first > 0, words[np.arange(len(part) - 1), first - 1], 0)
    out[1:][h[1:] != h[:-1]] = -1
    return out


def copies(rows: list[tuple], min_words: int) -> Iterator[tuple]:
    """(node, start, stop): what each row covers of runs that a row of another node has as well.

    rows: (h, ahead, behind, node, pos), sorted by h and ahead, with all rows of each h.
    """
    if len(rows) < 2:
        return
    h = np.array([r[0] for r in rows], np.int64)
    ahead = common_prefixes(h, [r[1] for r in rows])
    order = np.array(sorted(range(len(rows)), key=lambda k: (rows[k][0], rows[k][2])))
    behind = common_prefixes(h[order], [rows[k][2] for k in order])
    node = np.unique(np.array([r[3] for r in rows], dtype="S16").view("V16"), return_inverse=True)[1].ravel()
    least, most, left = np.full(len(rows), min_words), np.full(len(rows), -1), np.empty(len(rows), np.int64)
    for o in range(min_words - K + 1):
        right = np.cumsum(ahead < min_words - o)
        left[order] = np.cumsum(behind < o)
        several = (np.bincount(right)[right] > 1) & (np.bincount(left)[left] > 1)
        own = np.flatnonzero(several)
        key = right[own] * (len(rows) + 1) + left[own]
        place = np.lexsort((node[own], key))
        own, key = own[place], key[place]
        if len(own) < 2:
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.r_[first[1:], len(own)] - 1
        found = own[np.repeat(node[own[first]] != node[own[last]], last - first + 1)]
        least[found], most[found] = np.minimum(least[found], o), o
    for k in np.flatnonzero(most >= 0):
        yield rows[k][3], int(rows[k][4] - most[k]), int(rows[k][4] - least[k] + min_words)


_SPAN = pa.schema([("node", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])


def _spans_in_groups(rows: DataFrame, min_words: int, parts: int, chunk: int = 8192) -> DataFrame:
    """Spans of suffixes, the suffixes of one h in one task; about ``chunk`` rows, and always whole groups, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            found = list(copies(held, min_words)) if held else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t.type) for k, t in enumerate(_SPAN)], schema=_SPAN)

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if len(held) >= chunk and held[-1][0] != row[0]:
                    yield out(held)
                    held = []
                held.append(row)
        yield out(held)

    dealt = rows.repartition(parts, "h").sortWithinPartitions("h", "ahead", "node")
    return dealt.select("h", "ahead", "behind", "node", "pos").mapInArrow(released(run), "node binary, start int, stop int")


def _spans_by_key(rows: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """Spans of suffixes whose group is too large for one task: a row for each number of words behind; equal runs meet in a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = lambda text: [0, *(np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1).tolist()]
        for b in batches:
            out = []
            for ahead, behind, node, pos in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                right, left = ends(ahead), ends(behind)
                for o in range(min_words - K + 1):
                    if o < len(left) and min_words - o < len(right):
                        run = ahead[: right[min_words - o]] + b"\0" + behind[: left[o]]
                        out.append((hashlib.blake2b(run, digest_size=16).digest(), node, pos, o))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["key", "node", "pos", "o"])

    each = scratch.write(rows.select("h", "ahead", "behind", "node", "pos").mapInArrow(released(run), "key binary, node binary, pos int, o int"), "extensions")
    shared = each.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("key")
    shared = scratch.write(shared, "shared-keys")
    found = each.join(shared, "key", "left_semi").groupBy("node", "pos").agg(F.min("o").alias("least"), F.max("o").alias("most"))
    return found.select("node", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + min_words).alias("stop"))


def repeated_spans(docs: DataFrame, min_words: int = 50, most: int = 20_000) -> DataFrame:
    """doc_id, text_key, start, stop (words, stop exclusive), n_words: the merged spans of each row, in rows of their own.

    Suffixes with the same first words are compared in one task, if there are ``most`` at most, and else by a join.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "suffixes")
    rows = scratch.write(_sketch(docs, min_words), "sketches")
    classes = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
    classes = scratch.write(classes.select("digest", "r.*", "copies", "n_words"), "classes")

    one = rows.join(classes.select("digest", "doc_id", "text_key"), [rows["digest"] == classes["digest"], rows["doc_id"].eqNullSafe(classes["doc_id"]), rows["text_key"] == classes["text_key"]], "left_semi")
    suffixes = one.dropDuplicates(["digest"]).select(F.col("digest").alias("node"), F.explode(F.arrays_zip("at", "hash")).alias("s")).select("node", "s.at", "s.hash")
    suffixes = scratch.write(suffixes, "kept")
    often = scratch.write(suffixes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    places = suffixes.join(often.select("hash"), "hash").groupBy("node").agg(F.array_sort(F.collect_set("at")).alias("places"))
    wanted = scratch.write(places.join(classes.select(F.col("digest").alias("node"), "doc_id", "text_key"), "node"), "places")
    large = scratch.write(often.filter(F.col("n") > most).select(F.col("hash").alias("h")), "large")
    scratch.drop("kept", "often")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    same = own["doc_id"].eqNullSafe(wanted["doc_id"]) & (own["text_key"] == wanted["text_key"])
    texts = scratch.write(own.join(wanted, same).select("node", "text", "places"), "texts")

    rows_of = _suffixes(texts, min_words)
    kept = texts.agg(F.sum(F.size("places"))).first()[0] or 0
    spans = scratch.write(_spans_in_groups(rows_of.join(large, "h", "left_anti"), min_words, shuffle_parts(spark, kept * 14 * min_words)), "in-groups")
    if not large.isEmpty():
        spans = spans.unionByName(scratch.write(_spans_by_key(rows_of.join(large, "h", "left_semi"), min_words, scratch), "by-key"))
    spans = spans.distinct()

    behind = Window.partitionBy("node").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("fresh", F.coalesce(F.col("start") > F.max("stop").over(behind), F.lit(True)).cast("int"))
    marked = marked.withColumn("run", F.sum("fresh").over(Window.partitionBy("node").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("node", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    alone = classes.filter("copies = 1").select(F.col("digest").alias("node"))
    whole = classes.filter("copies > 1").select(F.col("digest").alias("node"), F.lit(0).alias("start"), F.col("n_words").alias("stop"))
    every = scratch.write(merged.join(alone, "node", "left_semi").select("node", "start", "stop").unionByName(whole), "spans")
    out = rows.select("doc_id", "text_key", "n_words", F.col("digest").alias("node")).join(every, "node")
    return out.select("doc_id", "text_key", "start", "stop", "n_words")
