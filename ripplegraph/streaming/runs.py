"""Streams run to their end: every micro-batch is written, then read as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..scratch import Tables


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and give its rows; state and output lie in the shared folder.

    Aggregations run in update mode and are written by batch; of a key's rows those of the last batch count.
    """
    spark = stream.sparkSession
    tables = Tables(spark, name)
    path = f"{tables.root}/rows"

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tables.root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from its last batch."""
    from pyspark.sql import functions as F

    values = [c for c in rows.columns if c not in (*keys, "_batch", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")
