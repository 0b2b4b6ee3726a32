"""Near-duplicates by an LSH forest of minhash signatures.

Documents with equal shingle sets form a class, and one signature stands for it.  The forest holds TREES orders of the
classes, each sorted by the signature rotated to start at another place; classes are candidates if they share DEPTH
leading values in some order (a region).

1. In each order, a class is compared with its neighbours of longest common prefix: their prefix
   has DEPTH values at least, the same depth in every region.  The best of these candidates are confirmed on the full sets, which joins nearly all copies.
2. Regions that still hold several components are compared whole, in blocks, across components; candidates are
   confirmed where they meet, on the full sets.  Regions inside one component need no further look, for links within
   it change nothing.

Sharing no region at a similarity of s has the probability (1 - s**DEPTH)**TREES: 2e-6 at 0.75.  A candidate whose
signature agrees in under AGREE of its VALUES values (6.5 standard deviations below what 0.75 gives, which a link has
with a probability of 5e-10) is not confirmed.  Blocks are bounded in classes and in shingles, so a task's memory does not
grow with the region.

Defined results: null and empty texts, and texts of white space, have no shingles and stand alone; rows without an id
are compared like others but have no component of their own name; rows that repeat an id and its text are one document
and share one result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, bound_batches, released, windows, words_of
from .components import components

WORDS, TREES, DEPTH = 5, 24, 3
VALUES = TREES * DEPTH
AGREE = 30
#: Candidates of each class that step 1 confirms; step 2 covers the rest.
BEST = 3
#: Classes of a region, and shingles that they have together, which one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 768, 600_000
_RNG = np.random.default_rng(6)
_A = _RNG.integers(1, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32)


def shingle_set(text: str | None, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of fewer words, their whole sequence as one."""
    words = hashes.array(words_of(text))
    return np.unique(windows(words, min(n, len(words)))) if len(words) else words


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of VALUES minima."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 2**32 - 1, dtype=np.uint32)
    for k in range(0, len(x), 4096):
        least = np.minimum(least, (x[k : k + 4096, None] * _A + _B).min(axis=0))
    return least.astype("<u2").tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n (size of the set), node (digest of the set, null if empty), sig."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes) for t in b.column(2).to_pylist()]
            node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sig = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, sets), pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "text_key", "n", "node", "sig"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return own.mapInArrow(released(run), "doc_id long, text_key long, n long, node binary, sig binary")


def _fixed(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A binary column of values of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width // np.dtype(dtype).itemsize)


def _regions() -> Column:
    """The region of a class in each tree, an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("sig", t * 2 * DEPTH + 1, F.lit(2 * DEPTH))))


def _shared_regions(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(region, node) of the regions with several classes; all else goes no further than this."""
    rows = classes.select("node", F.explode(_regions()).alias("region"))
    several = rows.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1").select("region")
    several = scratch.write(several, "several")
    return scratch.write(rows.join(several.hint("merge"), "region", "left_semi").select("region", "node"), "shared")


def _tree() -> Column:
    """The tree of a region, from the class's signature."""
    return (F.array_position(_regions(), F.col("region")) - 1).cast("int")


def _neighbours(classes: DataFrame, shared: DataFrame, reach: int = 2) -> DataFrame:
    """(a, b) of classes at most ``reach`` places apart in some order that share DEPTH values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_t, tail_k, tail_n = np.empty(0, np.int32), np.empty((0, 8), "<u2"), []
        for b in batches:
            tree = np.concatenate([tail_t, b.column(0).to_numpy()])
            key = np.concatenate([tail_k, _fixed(b.column(1), 16, "<u2")])
            node = tail_n + b.column(2).to_pylist()
            left, right = [], []
            for step in range(1, reach + 1):
                same = (tree[step:] == tree[:-step]) & (key[step:, :DEPTH] == key[:-step, :DEPTH]).all(axis=1)
                for k in np.flatnonzero(same).tolist():
                    x, y = node[k], node[k + step]
                    left.append(min(x, y)), right.append(max(x, y))
            tail_t, tail_k, tail_n = tree[-reach:], key[-reach:], node[-reach:]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    # the key: 8 values of the signature from the tree's place on, round its end
    rows = shared.join(classes.select("node", "sig"), "node").withColumns({"tree": _tree(), "twice": F.concat("sig", "sig")})
    rows = rows.select("tree", F.expr(f"substring(twice, tree * {2 * DEPTH} + 1, 16)").alias("key"), "node")
    rows = rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    return rows.mapInArrow(released(run), "a binary, b binary").distinct()


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree well enough, with ``agree``."""
    sigs = classes.select("node", "sig")
    both = pairs.join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            agree = (_fixed(b.column(2), 2 * VALUES, "<u2") == _fixed(b.column(3), 2 * VALUES, "<u2")).sum(axis=1).astype(np.int32) if b.num_rows else np.empty(0, np.int32)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(agree)], names=["a", "b", "agree"])
            yield out.filter(pa.array(agree >= AGREE))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(released(run), "a binary, b binary, agree int")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of sorted batches, in lists of equal keys."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and any(held[0][k] != r[k] for k in keys):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


_GROUP = ("region", "left", "right")


class _Block:
    """Classes of one region (or of two blocks of it), and which of them may be linked across components."""

    def __init__(self, rows: list[dict]):
        self.rows, self.tree, self.cross = rows, rows[0]["tree"], rows[0]["left"] != rows[0]["right"]
        names, self.label = np.unique([r["label"] for r in rows], return_inverse=True)
        self.main = np.bincount(self.label).argmax()
        self.block = np.array([r["block"] for r in rows])
        self.n = np.array([r["n"] for r in rows])
        self.sig = np.frombuffer(b"".join(r["sig"] for r in rows), "<u2").reshape(len(rows), VALUES)

    def partners(self, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(i, others): every pair across components has an end outside the largest one.

        Left out are pairs whose sizes or signatures rule a link out, and those that share a region of a tree before.
        """
        at = np.arange(len(self.rows))
        for i in np.flatnonzero(self.label != self.main):
            other = (label != label[i]) & ((self.label == self.main) | (at > i))
            other &= 100 * np.minimum(self.n, self.n[i]) >= 75 * np.maximum(self.n, self.n[i])
            if self.cross:
                other &= self.block != self.block[i]
            j = np.flatnonzero(other)
            same = self.sig[j] == self.sig[i]
            first = same.reshape(len(j), TREES, DEPTH).all(axis=2).argmax(axis=1)
            j = j[(same.sum(axis=1) >= AGREE) & (first == self.tree)]
            if len(j):
                yield int(i), j


def _participants(rows: DataFrame) -> DataFrame:
    """region, left, right, node of the classes that have a partner in some group of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, _GROUP):
            block, found = _Block(held), set()
            for i, j in block.partners(block.label):
                found.update((i, *j.tolist()))
            out = [held[k] for k in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip((*_GROUP, "node"), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=[*_GROUP, "node"])

    dealt = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")
    return dealt.select(*_GROUP, "tree", "block", "node", "label", "n", "sig").mapInArrow(released(run), "region long, left int, right int, node binary")


def _links_across(rows: DataFrame) -> DataFrame:
    """(a, b): links on full sets that join the components of each group; rows as before, with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for held in _groups(batches, _GROUP):
            block, out = _Block(held), []
            ends = np.cumsum([0, *(r["n"] for r in held)])
            codes = np.empty(ends[-1], np.uint64)
            for k, r in enumerate(held):
                codes[ends[k] : ends[k + 1]] = shingle_set(r.pop("text"), hashes)
            names = np.unique(codes)
            codes = np.searchsorted(names, codes).astype(np.int32)
            mark, label = np.zeros(len(names), bool), block.label.copy()
            del names
            for i, j in block.partners(label):
                mark[codes[ends[i] : ends[i + 1]]] = True
                for k in j:
                    # a link inside what other links have joined meanwhile changes nothing
                    if label[k] == label[i]:
                        continue
                    both = int(np.count_nonzero(mark[codes[ends[k] : ends[k + 1]]]))
                    if 100 * both >= 75 * (block.n[i] + block.n[k] - both):
                        out.append((held[i]["node"], held[k]["node"]))
                        label[label == label[k]] = label[i]
                mark[codes[ends[i] : ends[i + 1]]] = False
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    dealt = rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")
    return dealt.select(*_GROUP, "tree", "block", "node", "label", "n", "sig", "text").mapInArrow(released(run), "a binary, b binary").distinct()


def _mixed_regions(classes: DataFrame, shared: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of regions that hold several components, dealt to pairs of blocks of about BLOCK classes."""
    labelled = classes.join(roots, "node", "left").select("node", "sig", "n", F.xxhash64(F.coalesce("root", "node")).alias("label"))
    labelled = scratch.write(labelled, "labelled")
    members = scratch.write(shared.join(labelled.select("node", "label", "n"), "node"), "labels")
    mixed = members.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("low != high")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    mixed = scratch.write(mixed.select("region", blocks.alias("blocks")), "mixed")
    rows = members.join(mixed, "region").join(labelled.select("node", "sig"), "node")
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), "tree": _tree()})
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    return scratch.write(rows.select(*_GROUP, "tree", "block", "node", "label", "n", "sig"), "members")


def _texts(docs: DataFrame, need: DataFrame, classes: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """(node, text) of the classes in ``need``, from the row that represents each."""
    keys = scratch.write(need.join(classes.select("node", "rep", "rep_key"), "node"), f"{table}-keys")
    own = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("rep_key"), "text")
    same = own["rep"].eqNullSafe(keys["rep"]) & (own["rep_key"] == keys["rep_key"])
    # a merge join at any size: the plan does not flip between small and large inputs
    found = own.join(keys.hint("merge"), same).select("node", "text")
    return scratch.write(found.dropDuplicates(["node"]), table)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have an intersection of at least 75 % of their union."""
    with_b = pairs.select("a", "b").hint("merge").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    both = with_b.hint("merge").join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), OrderedDict()

        def of(node: bytes, text: str) -> np.ndarray:
            if node in held:
                held.move_to_end(node)
                return held[node]
            held[node] = shingle_set(text, hashes)
            if len(held) > 500:
                held.popitem(last=False)
            return held[node]

        for b in batches:
            ok = []
            for a, c, text_a, text_b in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = of(a, text_a), of(c, text_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(released(run), "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (smallest id reachable by links) of every row."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    rows = scratch.write(sketches(docs), "sketches")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key")))
    grouped = rows.filter("node is not null").groupBy("node").agg(first.alias("r"), F.min("text_key").alias("some_key"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = grouped.select("node", F.col("r.doc_id").alias("rep"), F.coalesce("r.text_key", "some_key").alias("rep_key"), "sig", "n")
    classes = scratch.write(classes, "classes")

    shared = _shared_regions(classes, scratch)
    near = scratch.write(_agreeing(_neighbours(classes, shared), classes), "neighbours")
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("end")), F.struct(F.col("b").alias("end")))).alias("x"), "a", "b", "agree").select("x.end", "a", "b", "agree")
    ranked = ends.withColumn("place", F.row_number().over(Window.partitionBy("end").orderBy(F.desc("agree"), "a", "b")))
    best = scratch.write(ranked.filter(F.col("place") <= BEST).select("a", "b").distinct(), "best")
    nodes = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts(docs, nodes(best), classes, scratch, "texts")
    links = scratch.write(_confirmed(best, texts), "links")
    roots = components(links, scratch, "first")

    members = _mixed_regions(classes, shared, roots, scratch)
    rest = scratch.write(_participants(members), "rest")
    more = _texts(docs, rest.select("node").distinct().join(texts.select("node"), "node", "left_anti"), classes, scratch, "more-texts")
    texts = texts.unionByName(more)
    links_2 = scratch.write(_links_across(rest.hint("merge").join(members, [*_GROUP, "node"]).hint("merge").join(texts, "node")), "links-2")
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    lifted = links_2.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    roots_2 = components(lifted, scratch, "second").select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = classes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(roots_2, "root", "left")
    final = scratch.write(final.select("node", "rep", F.coalesce("top", "root").alias("top")), "final")
    least = scratch.write(final.groupBy("top").agg(F.min("rep").alias("component_id")), "least")
    named = scratch.write(final.join(least, "top").select("node", "component_id"), "named")
    out = rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    scratch.drop("shared", "labels", "labelled", "mixed", "members", "texts", "more-texts", "neighbours")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents, columns as they are, of which one of each group stays: that with the smallest id.

    Documents without an id stay.
    """
    groups = near_duplicates(docs)
    gone = Scratch(docs.sparkSession, "near-gone").write(groups.filter("doc_id != component_id").select("doc_id", "text_key"), "rows")
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_key"])
    return docs.join(gone, same, "left_anti")
