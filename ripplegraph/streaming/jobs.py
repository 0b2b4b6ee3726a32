"""A queue of analyses as a table: jobs are added once, worked off in order, and tried again when they fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Commits

#: Tries after the first.
MAX_RETRIES = 2


class JobQueue:
    """Jobs (job_id, payload) with status (pending, done, failed), attempts and the last error.

    Every change is one commit: a worker that breaks off leaves its jobs pending, so a job runs at least once, and its
    work must bear that.
    """

    SCHEMA = "job_id string, payload string, added long, status string, attempts int, error string"

    def __init__(self, spark: SparkSession, path: str, max_retries: int = MAX_RETRIES):
        self.spark, self.commits, self.max_retries = spark, Commits(spark, path), max_retries

    def _at(self, state: dict) -> DataFrame:
        return self.commits.read(state["rows"], self.SCHEMA) if "rows" in state else self.spark.createDataFrame([], self.SCHEMA)

    def rows(self) -> DataFrame:
        return self._at(self.commits.current()[1])

    def _commit(self, change: Callable[[DataFrame], DataFrame]) -> None:
        before, state = self.commits.current()
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        folder = self.commits.attempt(change(self._at(state)).select(*names), "rows")
        try:
            self.commits.commit(before, {"rows": folder, "replaced": [state["rows"]] if "rows" in state else []})
        except Exception:
            self.commits.remove(folder)
            raise
        self.commits.remove(*state.get("replaced", []))

    def submit(self, jobs: DataFrame) -> None:
        """Add the jobs whose id is new; of equal ids one counts."""
        number = self.commits.current()[0]
        fresh = jobs.groupBy("job_id").agg(F.min("payload").alias("payload"))
        fresh = fresh.withColumns({"added": F.lit(number).cast("long"), "status": F.lit("pending"), "attempts": F.lit(0), "error": F.lit(None).cast("string")})
        self._commit(lambda old: old.unionByName(fresh.join(old.select("job_id"), "job_id", "left_anti").select(old.columns)))

    def work(self, handler: Callable[[str, str], None], most: int = 20) -> int:
        """Run the handler on the next ``most`` pending jobs (job_id, payload); how many there were."""
        todo = self.rows().filter("status = 'pending'").orderBy("added", "job_id").limit(most).collect()
        if not todo:
            return 0
        results = []
        for job in todo:
            error = None
            try:
                handler(job["job_id"], job["payload"])
            except Exception as e:  # a job's failure is the job's own
                error = f"{type(e).__name__}: {e}"
            status = "done" if error is None else "failed" if job["attempts"] >= self.max_retries else "pending"
            results.append((job["job_id"], status, job["attempts"] + 1, error))
        now = self.spark.createDataFrame(results, "job_id string, status string, attempts int, error string")
        names = ["status", "attempts", "error"]

        def change(old: DataFrame) -> DataFrame:
            new = now.withColumnsRenamed({c: f"new_{c}" for c in names}).withColumn("tried", F.lit(True))
            joined = old.join(new, "job_id", "left")
            return joined.withColumns({c: F.when(F.col("tried"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in names})

        self._commit(change)
        return len(results)
