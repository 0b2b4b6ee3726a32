"""Reports as tables and files: comments that are created, updated and deleted, and structured logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commits


class Comments:
    """A table of comments (pull request, marker, body); each change makes a new table current, or fails and changes nothing."""

    SCHEMA = "repository string, number long, marker string, body string, revision long"
    KEY = ["repository", "number", "marker"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    def _at(self, state: dict) -> DataFrame:
        return self.commits.read(state["rows"], self.SCHEMA) if "rows" in state else self.spark.createDataFrame([], self.SCHEMA)

    def rows(self) -> DataFrame:
        return self._at(self.commits.current()[1])

    def publish(self, rows: DataFrame) -> None:
        """Create comments (repository, number, marker, body), or give existing ones a new body and revision."""

        def change(old: DataFrame) -> DataFrame:
            before = old.select(*self.KEY, F.col("revision").alias("before"))
            new = rows.select(*self.KEY, "body").join(before, self.KEY, "left").withColumn("revision", F.coalesce(F.col("before") + 1, F.lit(1).cast("long"))).drop("before")
            return old.join(new.select(*self.KEY), self.KEY, "left_anti").select(new.columns).unionByName(new)

        self._replace(change)

    def delete(self, keys: DataFrame) -> None:
        self._replace(lambda old: old.join(keys.select(*self.KEY), self.KEY, "left_anti").select("repository", "number", "marker", "body", "revision"))

    def _replace(self, change: Callable[[DataFrame], DataFrame]) -> None:
        before, state = self.commits.current()
        folder = self.commits.attempt(change(self._at(state)), "rows")
        try:
            self.commits.commit(before, {"rows": folder, "replaced": [state["rows"]] if "rows" in state else []})
        except Exception:
            self.commits.remove(folder)
            raise
        self.commits.remove(*state.get("replaced", []))


def write_log(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


class Registry:
    """Named readers and writers of several kinds."""

    def __init__(self):
        self._held: dict[tuple[str, str], object] = {}

    def register(self, kind: str, name: str, value) -> None:
        if (kind, name) in self._held:
            raise ValueError(f"{kind} {name} is registered already")
        self._held[kind, name] = value

    def get(self, kind: str, name: str):
        return self._held[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._held if k == kind)
