"""Facts from source text: one walk of each file gives all of its facts, as rows of one schema.

Columns: path, language, fact (symbol, import, call, type, endpoint, event, model, field,
relationship, repository, config, test, fixture), name, owner (the
enclosing class, or class.function for what happens inside a function), target, detail, line, end_line.  A file that
doesn't parse has no facts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import java_facts, python_facts, typescript_facts

SCHEMA = "path string, language string, fact string, name string, owner string, target string, detail string, line int, end_line int"
READERS = {"python": python_facts.facts, "java": java_facts.facts, "typescript": typescript_facts.facts}
EXTENSIONS = {".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "typescript"}


def language_of(path) -> F.Column:
    """The language of a path's extension, or unknown."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.element_at(table, F.regexp_extract(path, r"(\.[^./]+)$", 1)), F.lit("unknown"))


def extract(files: DataFrame) -> DataFrame:
    """The facts of files (path, content)."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, content, language in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader := READERS.get(language):
                    for fact in reader(content or ""):
                        rows.append({"path": path, "language": language, "end_line": fact.get("line")} | fact)
                        if len(rows) >= 10_000:
                            yield out(rows)
                            rows = []
        yield out(rows)

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(columns, kinds, strict=True)], names=columns)

    return files.select("path", "content", language_of(F.col("path")).alias("language")).mapInArrow(run, SCHEMA)


def unseen(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, content_sha) the cache lacks."""
    keyed = files.withColumn("content_sha", F.sha1(F.col("content").cast("binary")))
    return keyed.join(cache.select("path", "content_sha"), ["path", "content_sha"], "left_anti")
