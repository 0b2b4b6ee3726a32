"""Sharding by a two-pass external shuffle (native: DataFrame functions only).

Pass one scatters the records with a seeded hash over buckets that fit in memory, dealt out evenly to as many tasks as
their bytes ask for; pass two permutes each bucket by Fisher-Yates (Spark's ``shuffle`` of an array) and writes it.  The buckets in order form one long permutation, which
is cut into shards whose row counts differ by one at most (the law ``rows``).

Defined results: a null text has no bytes; a null or repeated id is a record like any other; an empty table gives an
empty result.  A record larger than a bucket is held by one task, as any record is.  Records are kept whole in
``record``, so clashing column names do not matter.  One seed gives one order for the same files read in the same splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_parts

#: Buckets whose sizes are summed in one window partition.
_SUPER = 4096


def shuffled_shards(docs: DataFrame, shards: int = 40, seed: int = 20_11, bucket_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every record of ``docs`` with its place: record struct, size, shard (0 to shards-1), slot (gapless from 0).

    ``bucket_bytes`` is the mean size of a bucket, the unit that one task holds in memory.  The row's position in
    the input is part of the scatter's key, so that repeated rows spread over all buckets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), size.alias("size"), F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_rid"))
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    parts = min(buckets, shuffle_parts(spark, total, 64 << 20))
    scattered = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "_id", "_rid"), F.lit(buckets)))
    permuted = (
        scattered.withColumn("part", F.pmod("bucket", F.lit(parts)).cast("int"))
        .repartitionById(parts, F.col("part"))
        .groupBy("part", "bucket")
        .agg(F.array_sort(F.collect_list(F.struct("_rid", "size", "record"))).alias("rows"))
        .select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("pos", "row"))
        .select("bucket", "pos", "row.size", "row.record")
    )
    written = scratch.write(permuted, "permuted")

    counts = written.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("super", F.expr(f"bucket div {_SUPER}"))
    above = counts.groupBy("super").agg(F.sum("n").alias("super_n"))
    above = above.select("super", (F.sum("super_n").over(Window.orderBy("super")) - F.col("super_n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("super").orderBy("bucket")) - F.col("n")
    offsets = counts.join(above, "super").select("bucket", (F.col("before") + within).alias("first"))
    offsets = scratch.write(offsets, "offsets")

    n = max(1, written.count())
    placed = written.join(offsets, "bucket").withColumn("place", F.col("first") + F.col("pos"))
    # shard s holds the places from ceil(s * n / shards) up to, not including, ceil((s + 1) * n / shards)
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards} div {n} as int)"))
    slot = F.expr(f"place - (shard * {n}L + {shards - 1}) div {shards}")
    return placed.select("record", "size", "shard", slot.alias("slot"))
