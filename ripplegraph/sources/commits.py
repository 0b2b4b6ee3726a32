"""Atomic replacement of stored tables: data goes to a folder of its own, then one new small file makes it current.

States are numbered files, of which the last counts.  A state is created where none of its number exists, so that of
two writers that started from the same state one fails (``Conflict``) and changes nothing; so does a writer that breaks
off, as readers never see its folder.  (A rename that does not replace is the store's: HDFS has it; a local disk looks
just before.)
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..scratch import hadoop_fs


def publish(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Create a small file whole, if there is none of that name; whether it was this call that did."""
    fs, file = hadoop_fs(spark, f"{folder}/{name}")
    _, temporary = hadoop_fs(spark, f"{folder}/_{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.exists(file) and fs.rename(temporary, file):
        return True
    fs.delete(temporary, False)
    return False


class Conflict(RuntimeError):
    """Another writer has made a state meanwhile."""


class Commits:
    """The states of one folder; a state is a dictionary."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> tuple[int, dict]:
        """The number of the last state and the state; 0 and an empty one before the first."""
        fs, folder = hadoop_fs(self.spark, f"{self.path}/_states")
        if not fs.exists(folder):
            return 0, {}
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit())
        if not names:
            return 0, {}
        _, file = hadoop_fs(self.spark, f"{self.path}/_states/{names[-1]}")
        stream = fs.open(file)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return int(names[-1]), json.loads(text)

    def commit(self, before: int, state: dict) -> None:
        """Make ``state`` the one after number ``before``."""
        if not publish(self.spark, f"{self.path}/_states", f"{before + 1:012d}", json.dumps(state)):
            raise Conflict(f"{self.path} has changed since state {before}")

    def attempt(self, rows: DataFrame, name: str) -> str:
        """Write rows that no state names yet; the folder's name."""
        folder = f"{name}-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(f"{self.path}/{folder}")
        except Exception:
            self.remove(folder)
            raise
        return folder

    def read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def remove(self, *folders: str) -> None:
        for folder in folders:
            fs, path = hadoop_fs(self.spark, f"{self.path}/{folder}")
            fs.delete(path, True)
