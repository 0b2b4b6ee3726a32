"""Unified diffs as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, file, hunk, sign, line, text of every added and removed line; diffs: diff_id, diff.

    The line is that of the head for added and of the base for removed lines.  A hunk without a length has one line.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\n")).alias("pos", "text"))
    order = Window.partitionBy("diff_id").orderBy("pos")
    start, hunk = F.col("text").startswith("diff --git "), F.col("text").rlike(HUNK)
    marked = lines.withColumn("file", F.last(F.when(start, F.regexp_extract("text", r"^diff --git \S+ b/(\S+)", 1)), True).over(order))
    marked = marked.withColumn("head", F.last(F.when(start, F.lit(-1)).when(hunk, F.col("pos")), True).over(order))
    marked = marked.withColumn("old_start", F.last(F.when(hunk, F.regexp_extract("text", HUNK, 1).cast("int")), True).over(order))
    marked = marked.withColumn("new_start", F.last(F.when(hunk, F.regexp_extract("text", HUNK, 3).cast("int")), True).over(order))
    body = marked.filter((F.col("head") >= 0) & (F.col("pos") > F.col("head"))).withColumn("sign", F.substring("text", 1, 1)).filter(F.col("sign").isin("+", "-", " "))
    inside = Window.partitionBy("diff_id", "head").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda own: F.coalesce(F.count_if(F.col("sign").isin(own, " ")).over(inside), F.lit(0))
    body = body.withColumns({"new_line": F.col("new_start") + seen("+"), "old_line": F.col("old_start") + seen("-")})
    line = F.when(F.col("sign") == "+", F.col("new_line")).otherwise(F.col("old_line"))
    return body.filter("sign <> ' '").select("diff_id", "file", F.col("head").alias("hunk"), "sign", line.cast("int").alias("line"), F.substring("text", 2, 1 << 20).alias("text"))


def diff_files(lines: DataFrame) -> DataFrame:
    """diff_id, file, added_lines, removed_lines (sorted arrays)."""
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("sign") == s, F.col("line"))))
    return lines.groupBy("diff_id", "file").agg(of("+").alias("added_lines"), of("-").alias("removed_lines"))
