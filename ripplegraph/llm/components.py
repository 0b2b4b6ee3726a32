"""Connected components by alternating large-star and small-star steps, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node that has an edge, the root itself included; root is the component's smallest node.

    ``edges`` has the columns a and b, of one orderable type.  The minima are written before they are joined, so that
    both sides of each join are exchanges of their own and Spark can split a hub's partition.
    """
    ends = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, state, turn = scratch.write(ends, f"{name}-0"), None, 0
    while True:
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state, turn = now, turn + 1
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-large")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.write(large, f"{name}-star")
        least = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-small")
        moved = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = scratch.write(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return scratch.write(current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), f"{name}-roots")
