"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled rows (``max_rows``, chosen by hash), flattened
into arrays, and traversed level by level with numpy for a whole batch at once.

Defined results: a null or empty text has the statistics of an empty text and is scored like any other; rows without
an id are scored and never learnt from; an id with several labels counts as its lowest, and with
several texts as that of the least hash; without labels, or with labels
of one class, the score is that class's smoothed share (0.5 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released

FEATURES = (
    "log_chars", "log_words", "bytes_per_word", "upper", "digit", "ascii_punct", "symbol", "non_ascii", "space", "bang", "bar", "line_bytes",
    "distinct_words", "top_word", "distinct_lines", "distinct_pairs", "word_end_punct", "entropy", "longest_word", "short_words", "caps_words", "symbol_words",
)

_BYTES = np.arange(256)
_CLASS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "ascii_punct": np.isin(_BYTES, list(b".,;:!?'\"()-")),
    "symbol": np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    "non_ascii": _BYTES >= 128,
    "space": np.isin(_BYTES, list(b" \t\n\r\x0b\f")),
    "bang": _BYTES == 33,
    "bar": _BYTES == 124,
}
_SYMBOLS = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES for one text, whole."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    w = len(words)
    freq = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = {k: float(counts[m].sum()) / n for k, m in _CLASS.items()}
    p = counts[counts > 0] / n
    each = max(w, 1)
    types = max(len(freq), 1)
    kinds = list(freq)
    return [
        math.log1p(n), math.log1p(w), sum(map(len, words)) / each, share["upper"], share["digit"], share["ascii_punct"], share["symbol"], share["non_ascii"], share["space"], share["bang"], share["bar"], math.log1p(n / max(len(lines), 1)),
        len(freq) / each, max(freq.values(), default=0) / each, len(set(lines)) / max(len(lines), 1), len(set(zip(words, words[1:]))) / max(w - 1, 1), sum(x[-1] in b".,;:!?" for x in kinds) / types, float(-(p * np.log2(p)).sum()), math.log1p(max(map(len, kinds), default=0)), sum(len(x) <= 3 for x in kinds) / types, sum(x.isupper() for x in kinds) / types, sum(x[-1] in _SYMBOLS for x in kinds) / types,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Complete binary trees of one depth: node k has the children 2k+1 and 2k+2; a node that isn't split sends all left."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # value <= threshold goes left
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 thresholds, each between two values."""
    distinct = np.unique(values)
    between = (distinct[1:] + distinct[:-1]) / 2
    return between if len(between) < bins else np.unique(between[np.searchsorted(distinct, np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])).clip(0, len(between) - 1)])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least_hessian: float = 1.0) -> Trees:
    """Grow the trees level by level on histograms of gradients, with logistic loss and balanced class weights."""
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    pos = float(y.sum())
    if not 0 < pos < n:
        base = 0.0 if not n else math.log((pos + 1) / (n - pos + 1))
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    weight = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    edges = [_edges(x[:, j], bins) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    model = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), 0.0, depth)
    margin = np.zeros(n)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for j in range(m):
                k = len(edges[j]) + 1
                if k < 2:
                    continue
                key = at * k + binned[:, j]
                g = np.bincount(key, grad, width * k).reshape(width, k).cumsum(axis=1)
                h = np.bincount(key, hess, width * k).reshape(width, k).cumsum(axis=1)
                gl, hl, ga, ha = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < least_hessian) | (ha - hl < least_hessian)] = -1
                cut = gain.argmax(axis=1)
                for q in np.flatnonzero(gain[np.arange(width), cut] > best):
                    best[q] = gain[q, cut[q]]
                    model.feature[t, first + q], model.threshold[t, first + q] = j, edges[j][cut[q]]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t, node]] > model.threshold[t, node])
        leaf = node - inner
        step = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        model.leaf[t] = step
        margin += step[leaf]
    return model


def train(docs: DataFrame, labels: DataFrame, keep, max_rows: int = 20_000, label_col: str = "quality") -> Trees:
    """Fit on the labelled documents that ``keep`` (a condition on doc_id) admits; at most ``max_rows`` ids, by hash."""
    bound_batches(docs.sparkSession)
    own = labels.select("doc_id", F.col(label_col).alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).filter(keep(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # max_rows ids at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "key", "x"])

    rows = sample.select("doc_id", "text", F.col("y").cast("double"), F.xxhash64("text").alias("key")).mapInArrow(released(features), "doc_id long, y double, key long, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("x", F.struct("key", "x")).alias("x")).toPandas().sort_values("doc_id")  # max_rows rows at most
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, (rows["y"].to_numpy() > 0).astype(float) if len(rows) else np.zeros(0))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = model.score(matrix(b.column(1).to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, score double")


def held_out(doc_id):
    """A third of the ids, by CRC; labels of these are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def keep(docs: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """The documents, columns as they are, with a score of at least ``least``."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(model.score(matrix(b.column(at).to_pylist())) >= least))

    return docs.mapInArrow(released(run), docs.schema)
