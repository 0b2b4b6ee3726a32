"""Incremental indexing: files arrive in micro-batches, their facts are appended once for each content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.extract import extract, unseen


def index_batch(files: DataFrame, cache_path: str, facts_path: str, number: int) -> None:
    """Extract what the cache lacks. A batch that runs again overwrites its own folders, so each is applied once."""
    from pyspark.errors import AnalysisException

    spark = files.sparkSession
    try:
        cache = spark.read.parquet(cache_path).filter(F.col("batch") != number)
    except AnalysisException:
        cache = spark.createDataFrame([], "path string, content_sha string")
    new = unseen(files, cache).dropDuplicates(["path", "content_sha"])
    extract(new).write.mode("overwrite").parquet(f"{facts_path}/batch={number}")
    new.select("path", "content_sha").write.mode("overwrite").parquet(f"{cache_path}/batch={number}")


def index_stream(files: DataFrame, cache_path: str, facts_path: str, state_path: str) -> None:
    """Index a stream of files (path, content) to its present end."""
    write = lambda batch, number: index_batch(batch, cache_path, facts_path, number)
    files.writeStream.foreachBatch(write).option("checkpointLocation", state_path).trigger(availableNow=True).start().awaitTermination()
