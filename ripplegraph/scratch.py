"""Intermediate tables, written in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, in local mode only, a temporary folder of this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="ripplegraph-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def hadoop_fs(spark: SparkSession, uri: str):
    """The Hadoop file system of a URI and the URI as its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Tables:
    """Tables of one run; a written table cuts the lineage and outlives lost executors.

    The run's folder goes when the driver's JVM ends, and a table before that when ``drop`` names it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        fs, path = hadoop_fs(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, df: DataFrame, table: str) -> DataFrame:
        """Write the rows and give the table; the shuffle files that this took go at once, as nothing reads them again."""
        conf, before = self.spark.conf, self.spark.conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(table))
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Remove tables that no later plan reads."""
        for table in tables:
            fs, path = hadoop_fs(self.spark, self.path(table))
            fs.delete(path, True)
