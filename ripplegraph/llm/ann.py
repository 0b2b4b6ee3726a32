"""Approximate nearest neighbours over learned partitions.

On a bounded sample, the neighbour graph is cut into balanced partitions, and a small network learns which partitions
the neighbours of a vector lie in.  Every vector is indexed in its most probable partition; a query is routed to its
several most probable partitions, all members of which are ranked by the exact inner product in double precision.  How
many partitions a query visits is set on rows of the sample that the fit has not seen, so that ``target`` of their true
neighbours in the sample lie in them.  Rows of the sample that lie in a query's own partitions give a floor, below which
its partitions need not answer; nothing outside these partitions is ranked.

Equal vectors are one point of the index, which keeps the ``k`` + 1 smallest ids: no other of them can be among the k
nearest of any query.  Partitions are searched in blocks of bounded size.

Defined results: rows without an id and vectors that are null, zero, or hold null or non-finite components take no
part, nor do vectors of another length than most rows have; rows that repeat an id and its vector are one; without
other vectors a query has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, released


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row by inner product, itself left out."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each row, no part above ``slack`` times the mean.

    Halved along principal axes at first; then rows move to the part that most of their neighbours are in, as long as
    it has room.
    """
    label = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        label[rows] = first
        if count > 1 and len(rows) > 1:
            centred = x[rows] - x[rows].mean(axis=0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order, left = rows[np.argsort(centred @ axis, kind="stable")], count // 2
            cut = len(rows) * left // count
            todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    room = math.ceil(slack * len(x) / parts)
    rng = np.random.default_rng(4)
    links = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1])[:, None], graph.reshape(-1, 1)], axis=1)
    links = np.concatenate([links, links[:, ::-1]])
    links = links[np.argsort(links[:, 0], kind="stable")]
    bounds = np.searchsorted(links[:, 0], np.arange(len(x) + 1))
    size = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[links[bounds[i] : bounds[i + 1], 1]], minlength=parts)
            votes[size >= room] = -1
            votes[label[i]] = max(votes[label[i]], 0)
            best = int(votes.argmax())
            if votes[best] > votes[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i], moved = best, moved + 1
        if moved < len(x) // 200:
            break
    return label


@dataclass
class Router:
    """One hidden layer; probabilities of the partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 40, rate: float = 3e-3) -> Router:
        """Adam on the cross-entropy to target, a distribution over the partitions for each row."""
        rng = np.random.default_rng(5)
        d, parts = x.shape[1], target.shape[1]
        p = [rng.normal(0, math.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                h = np.maximum(x[rows] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                q = np.exp(z - z.max(axis=1, keepdims=True))
                g = (q / q.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
                gh = (g @ p[2].T) * (h > 0)
                t += 1
                for k, grad in enumerate((x[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return cls(*p)


@dataclass
class Index:
    router: Router | None
    parts: int
    visits: int
    scale: float

    def assign(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The most probable partitions of each row, as many as asked for."""
        if self.router is None:
            return np.zeros((len(x), 1), dtype=np.int64)
        return np.argsort(-self.router.logits(x / self.scale), axis=1, kind="stable")[:, :visits]


def fit_index(x: np.ndarray, rows: int, k: int, target: float, part_rows: int = 1000, most_parts: int = 256, graph_k: int = 10) -> Index:
    """Learn on a sample x of ``rows`` points: a part for each ``part_rows``, four at least, ``most_parts`` at most.

    A part has 32 rows of the sample at least, so that fewer than 64 points make one part.
    """
    parts = min(most_parts, max(4, rows // part_rows), len(x) // 32)
    if parts < 2:
        return Index(None, 1, 1, 1.0)
    scale = float(np.sqrt((x**2).sum(axis=1).mean())) or 1.0
    # visits: on rows of the sample that the fit leaves out, with their true neighbours in it
    probe, seen = np.split(np.random.default_rng(6).permutation(len(x)), [min(1000, len(x) // 5)])
    y = x[np.sort(seen)]
    graph = neighbour_graph(y, min(graph_k, len(y) - 1))
    label = balanced_partition(y, graph, parts)
    soft = np.zeros((len(y), parts))
    np.add.at(soft, (np.repeat(np.arange(len(y)), graph.shape[1]), label[graph.ravel()]), 1 / (graph.shape[1] + 1))
    soft[np.arange(len(y)), label] += 1 / (graph.shape[1] + 1)
    index = Index(Router.fit(y / scale, soft), parts, parts, scale)
    s = x[probe] @ x.T
    s[np.arange(len(probe)), probe] = -np.inf
    true = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    home, order = index.assign(x, 1)[:, 0], index.assign(x[probe], parts)
    place = np.empty_like(order)
    place[np.arange(len(probe))[:, None], order] = np.arange(parts)
    found = np.cumsum(np.bincount(place[np.arange(len(probe))[:, None], home[true]].ravel(), minlength=parts)) / true.size
    index.visits = min(parts, int(np.searchsorted(found, target) + 1))
    return index


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0)


def points_of(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """x, y (128 bits of hash), v, ids (the ``keep`` smallest of its rows, sorted): a row for each vector."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v")))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("v") == (length[0] if length else 0)).withColumns({"x": F.xxhash64("v"), "y": F.xxhash64(F.lit(1), "v")})
    rows = rows.groupBy("x", "y", "id").agg(F.first("v").alias("v"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).filter(F.col("place") <= keep)
    return ranked.groupBy("x", "y").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = 8192, target: float = 0.98, block: int = 2048) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found of every row for which ``is_query(id)`` holds."""
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "ann")
    points = scratch.write(points_of(vectors, id_col, vector_col, k + 1), "points")
    n = points.count()
    sample = points.select("v", "x", "y").orderBy("x", "y").limit(sample_rows).toPandas()
    x = np.array(sample["v"].to_list(), dtype=np.float64)
    index = fit_index(x, n, k, target)
    x_home = index.assign(x, 1)[:, 0] if len(x) else np.zeros(0, dtype=np.int64)

    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & is_query(F.col("id")))
    asked = asked.select("id", F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y")).distinct()
    asked = scratch.write(asked, "asked")
    queries = points.select("x", "y", "v").join(asked.select("x", "y").distinct(), ["x", "y"], "left_semi")

    def route(visits: int, with_floor: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.array(b.column(2).to_pylist(), dtype=np.float64)
                to, floor = index.assign(v, visits), np.full(len(v), -np.inf)
                if with_floor and len(x) > k + 1:
                    # k + 1 rows in the visited partitions reach it, so none below can be among the nearest there; one
                    # more is asked for, as rounding may put a row on the edge of two partitions into the other
                    visited = np.zeros((len(v), index.parts), dtype=bool)
                    visited[np.arange(len(v))[:, None], to] = True
                    s = np.where(visited[:, x_home], v @ x.T, -np.inf)
                    s = np.partition(s, len(x) - k - 2, axis=1)[:, len(x) - k - 2]
                    floor = np.where(np.isfinite(s), s - 1e-9 * (1 + np.abs(s)), -np.inf)
                each = np.repeat(np.arange(len(v)), to.shape[1])
                rows = b.take(pa.array(each))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), pa.array(to.ravel()), pa.array([v[i].tobytes() for i in each], pa.binary()), pa.array(floor[each])], names=["x", "y", "ids", "part", "v", "floor"])

        return run

    schema = "x long, y long, ids array<long>, part long, v binary, floor double"
    homes = points.select("x", "y", "v", "ids").mapInArrow(released(route(1, False)), schema)
    visits = queries.select("x", "y", "v", F.array().cast("array<long>").alias("ids")).mapInArrow(released(route(index.visits, True)), schema)

    def blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
        """part and lists of about ``size`` of its rows."""
        rows = scratch.write(rows, name)
        chunks = rows.groupBy("part").agg(F.ceil(F.count("*") / size).alias("chunks"))
        chunk = F.pmod(F.xxhash64("x", "y"), F.col("chunks")).alias("chunk")
        dealt = rows.join(F.broadcast(chunks), "part")  # most_parts rows at most
        return dealt.groupBy("part", chunk).agg(F.collect_list(F.struct("x", "y", "ids", "v", "floor")).alias(name)).drop("chunk")

    pairs = blocks(visits, "query", block // 4).join(blocks(homes, "member", block), "part")

    def nearest(asked: tuple[int, int], q: np.ndarray, own: np.ndarray, c: np.ndarray, ids: list[list[int]]) -> list[tuple]:
        # one fixed order of summation, so that a score does not depend on the block
        exact = np.einsum("ij,ij->i", np.broadcast_to(q, (len(own), len(q))), c[own])
        found = sorted((-s, m) for s, j in zip(exact.tolist(), own.tolist(), strict=True) for m in ids[j])
        return [(*asked, m, -s) for s, m in found[: k + 1]]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names=["x", "y", "id", "score"])

    def near(scores: np.ndarray, floor: float) -> np.ndarray:
        """All points that may be among the k + 1 best of one query: equals at the edge are settled by id later."""
        if len(scores) > k + 1:
            edge = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
            floor = max(floor, edge - 1e-9 * (1 + abs(edge)))
        return np.flatnonzero(scores >= floor)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                asked, members = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                q = np.frombuffer(b"".join(a["v"] for a in asked)).reshape(len(asked), -1)
                c = np.frombuffer(b"".join(a["v"] for a in members)).reshape(len(members), -1)
                scores, ids = q @ c.T, [m["ids"] for m in members]
                yield batch([r for i, a in enumerate(asked) for r in nearest((a["x"], a["y"]), q[i], near(scores[i], a["floor"]), c, ids)])

    scored = pairs.select("query", "member").mapInArrow(released(rank), "x long, y long, id long, score double")
    order = Window.partitionBy("x", "y").orderBy(F.desc("score"), "id")
    best = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    best = scratch.write(best.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found")), "best")
    own = asked.join(best, ["x", "y"]).select(F.col("id").alias("query_id"), "found")
    own = own.select("query_id", F.posexplode(F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)).alias("pos", "f"))
    return own.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.id").alias("id"), F.col("f.score").alias("score"))
