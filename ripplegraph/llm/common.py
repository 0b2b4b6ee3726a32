"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow batch bounds, word hashing."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import Tables, hadoop_fs, shared_folder

__all__ = ["Scratch", "WordHashes", "bound_batches", "hadoop_fs", "held", "mix", "released", "shared_folder", "shuffle_parts", "windows", "words_of"]


class Scratch(Tables):
    """Intermediate tables of one operator run."""

    def write(self, df: DataFrame, table: str) -> DataFrame:
        return self.put(df, table)


_HELD = "_ripplegraph_held"


def held(owner: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by the worker process for further tasks of one owner; another owner's is let go."""
    box = sys.modules.setdefault(_HELD, types.ModuleType(_HELD)).__dict__
    if box.get("owner") != owner:
        box.pop("value", None)
        box.update(owner=owner, value=make())
    return box["value"]


def released(run: Callable[[Iterator], Iterator], owner: str | None = None) -> Callable[[Iterator], Iterator]:
    """The same function over batches, with a bound on what a worker that Spark keeps for later tasks holds.

    What another owner has in ``held`` goes first; memory that the task has let go returns to the system at its end.
    """

    def task(batches: Iterator) -> Iterator:
        if _HELD in sys.modules and sys.modules[_HELD].__dict__.get("owner") != owner:
            del sys.modules[_HELD]
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library

    return task


def bound_batches(spark: SparkSession, rows: int = 256, size: int = 2 << 20) -> None:
    """Hold Arrow batches to few enough rows and bytes that batches of very long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shuffle_parts(spark: SparkSession, size: int, each: int = 128 << 20) -> int:
    """Partitions for a shuffle of about ``size`` bytes: those of the session, and more if they would exceed ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; words beyond ``limit`` are hashed each time, so that memory stays bounded."""

    def __init__(self, limit: int = 120_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of n words; none if there are fewer."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : k + count] + np.uint64(k + 1))
    return out


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs of other than ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
