"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits: A-Z lower-cased, ASCII punctuation and white space as separators.  Runs of
``seed`` words that a document shares with a benchmark item join the two.  For each joined pair, the longest match of
unmarked words is marked again and again (running Karp-Rabin: window hashes of a search length that shrinks to the
seed's; equal hashes are compared word by word), so that every word lies in one tile at most and reordered passages count
in full.  Of matches of equal length the first by place in the item, then in the text, is taken.  A pair is reported when
the tiles cover ``least`` of the item's words.

The benchmark is a query set, looked at in blocks of about ``block_words`` words; the driver and each task hold one block
at a time, however large the benchmark is.  If there are several blocks, a bitmap of fixed size holds a bit for each seed
of the benchmark: documents with a seed in it are written once, and the blocks read only these.

Defined results: null and empty texts match nothing, nor do items without words; an item of under ``seed`` words
matches only whole; repeated rows and null ids are texts and items of their own; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, bound_batches, released, windows

SEED, LEAST = 5, 0.75
_SEPARATORS = bytes.maketrans(bytes(range(33)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\x7f", b" " * (33 + 32 + 1))
_OUT = "doc_id long, text_key long, item_id long, covered long, item_words long, tiles long"


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATORS).split() if text else []


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (start in text, start in item, length), no word in two tiles."""
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    tiles, search = [], max(least, len(item))
    while True:
        found = _matches(text, item, free_t, free_i, search)
        if found and (longest := -found[0][0]) > 2 * search:
            search = longest
            continue
        while found:
            n, j, i = heappop(found)
            free = free_t[i : i - n] & free_i[j : j - n]
            if free.all():
                free_t[i : i - n] = free_i[j : j - n] = False
                tiles.append((i, j, -n))
                continue
            # the parts that longer tiles have left, each in its turn
            edge = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= search:
                    heappush(found, (a - b, j + a, i + a))
        if search == least or not free_i.any():
            return tiles
        search = max(least, search // 2)


#: Base of the rolling hash, odd, and its inverse, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of ``length`` words: sums of powers modulo 2**64, each from the one before."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    power = np.full(len(words), _BASE, np.uint64)
    back = np.full(len(words) - length + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(power))])
    return (total[length:] - total[:-length]) * np.cumprod(back)


def _matches(text: np.ndarray, item: np.ndarray, free_t: np.ndarray, free_i: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """A heap of the maximal matches of unmarked words of at least this length: (-length, j, i)."""
    in_text, in_item = _free_windows(free_t, length), _free_windows(free_i, length)
    if not len(in_text) or not len(in_item):
        return []
    value = rolling(item, length)[in_item]
    order = np.argsort(value, kind="stable")
    value, in_item = value[order], in_item[order]
    asked = rolling(text, length)[in_text]
    first, last = np.searchsorted(value, asked, "left"), np.searchsorted(value, asked, "right")
    found = []
    for k in np.flatnonzero(last > first):
        i = int(in_text[k])
        for j in in_item[first[k] : last[k]].tolist():
            if i and j and free_t[i - 1] and free_i[j - 1] and text[i - 1] == item[j - 1]:
                continue  # its maximal match starts further left
            if (text[i : i + length] != item[j : j + length]).any():
                continue
            n = length
            while i + n < len(text) and j + n < len(item) and free_t[i + n] and free_i[j + n] and text[i + n] == item[j + n]:
                n += 1
            found.append((-n, j, i))
    heapify(found)
    return found


def _free_windows(free: np.ndarray, length: int) -> np.ndarray:
    """The starts of runs of so many unmarked words."""
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[length:] - total[:-length] == length) if len(free) >= length else np.empty(0, int)


class Index:
    """The seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed: int, hashes: WordHashes):
        self.items = [(item_id, own) for item_id, text in items if len(own := hashes.array(tokens(text)))]
        self.seeds = {}
        for size in sorted({min(seed, len(own)) for _, own in self.items}):
            rows = [(windows(own, size), k) for k, (_, own) in enumerate(self.items) if min(seed, len(own)) == size]
            value = np.concatenate([h for h, _ in rows])
            owner = np.concatenate([np.full(len(h), k) for h, k in rows])
            order = np.argsort(value, kind="stable")
            near = np.zeros(1 << 20, bool)
            near[value & np.uint64((1 << 20) - 1)] = True
            self.seeds[size] = value[order], owner[order], near

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, seed length, where its seeds start in the text)"""
        for size, (value, owner, near) in self.seeds.items():
            own = windows(words, size)
            at = np.flatnonzero(near[own & np.uint64(len(near) - 1)])
            first, last = np.searchsorted(value, own[at], "left"), np.searchsorted(value, own[at], "right")
            at, first, last = at[last > first], first[last > first], last[last > first]
            if len(at):
                starts = np.repeat(at, last - first)
                owners = owner[np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])]
                for k in np.unique(owners):
                    yield int(k), size, np.unique(starts[owners == k])


def coverage(words: np.ndarray, item: np.ndarray, size: int, starts: np.ndarray, least: float) -> tuple[int, int] | None:
    """Words of the item that tiles cover, and the number of tiles; None if even all seeds cover too few."""
    shared = np.isin(windows(item, size), windows(words, size)[starts])
    held = np.zeros(len(item) + 1, int)
    np.add.at(held, np.flatnonzero(shared), 1)
    np.add.at(held, np.flatnonzero(shared) + size, -1)
    if (np.cumsum(held)[:-1] > 0).sum() < least * len(item):
        return None
    # only words in seeds can lie in tiles: join the runs of them, with a word between that no item has
    keep = np.zeros(len(words) + 1, int)
    np.add.at(keep, starts, 1)
    np.add.at(keep, starts + size, -1)
    inside = np.cumsum(keep)[:-1] > 0
    cuts = np.flatnonzero(np.diff(inside.astype(int)) != 0) + 1
    runs = [run for run, on in ((words[a:b], inside[a]) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(words)], strict=True)) if on]
    gap = np.array([np.uint64(0)])
    tiles = tile(np.concatenate([x for run in runs for x in (run, gap)]), item, size)
    return sum(n for _, _, n in tiles), len(tiles)


#: Bits of the seeds' bitmap: 16 MB, whatever the size of the benchmark.
_BITS = 27


def _bits(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(64 - _BITS)).astype(np.int64)


def _seeded(own: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """The rows of ``own`` that have a seed of an item, or a run as long as a shorter item, whose bit is set."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            own = [w for t in b.column(0).to_pylist() if len(w := hashes.array(tokens(t)))]
            sizes = [(min(seed, len(w)), _bits(windows(w, min(seed, len(w))))) for w in own]
            at = np.concatenate([bits for _, bits in sizes]) if sizes else np.empty(0, np.int64)
            size = np.concatenate([np.full(len(bits), k) for k, bits in sizes]) if sizes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63)), pa.array(size)], names=["word", "bit", "size"])

    rows = items.select("text").mapInArrow(released(of_items), "word long, bit long, size long")
    # at most 2**21 rows, by construction
    words = rows.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.collect_set("size").alias("sizes")).toPandas()
    bitmap = np.zeros(1 << (_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    sizes = sorted({int(k) for own in words["sizes"] for k in own})

    def with_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keep = []
            for text in b.column(2).to_pylist():
                words = hashes.array(tokens(text))
                bits = [_bits(windows(words, k)) for k in sizes]
                keep.append(any((bitmap[at >> 6] >> (at & 63) & 1).any() for at in bits))
            yield b.filter(pa.array(keep, pa.bool_()))

    return own.mapInArrow(released(with_seeds), own.schema)


def matches(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = LEAST, block_words: int = 2_000_000) -> DataFrame:
    """Per document and item: doc_id, text_key (xxhash64 of the text), item_id, covered, item_words, tiles, coverage."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\W+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    scratch = Scratch(spark, "benchmark")
    if blocks > 1:
        own = scratch.write(_seeded(own, items, seed), "seeded")

    def one(block: int) -> DataFrame:
        held = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            index = Index(held, seed, hashes)
            for b in batches:
                rows = []
                for doc_id, key, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    words = hashes.array(tokens(text))
                    for k, size, starts in index.hits(words):
                        item_id, item = index.items[k]
                        got = coverage(words, item, size, starts, least)
                        if got and got[0] >= least * len(item):
                            rows.append((doc_id, key, item_id, got[0], len(item), got[1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 6)], names=["doc_id", "text_key", "item_id", "covered", "item_words", "tiles"])

        return own.mapInArrow(released(run), _OUT)

    # with several blocks, each is written before the next is collected
    found = one(0) if blocks == 1 else reduce(DataFrame.unionAll, [scratch.write(one(k), f"block-{k}") for k in range(blocks)])
    return found.withColumn("coverage", F.col("covered") / F.col("item_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, least: float = LEAST) -> DataFrame:
    """The documents, columns as they are, without those that hold an item."""
    found = Scratch(docs.sparkSession, "contaminated").write(matches(docs, benchmark, seed, least).select("doc_id", "text_key").distinct(), "rows")
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["text_key"])
    return docs.join(found, same, "left_anti")
