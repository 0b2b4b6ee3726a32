"""Demand-driven resolution: candidate files for requirements, budgets, and the loop that works through them."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What marks entry points and consumers in source text.
ENTRY_MARKS = ("@app.", "FastAPI", "Blueprint", "def main", "if __name__", "@router.", "@RequestMapping", "@GetMapping", "app.get(")
CONSUMER_MARKS = ("subscribe", "consumer")
KINDS = ("file", "symbol", "importers", "event", "entry_points")
LANGUAGES = (("python", (".py",)), ("java", (".java",)), ("typescript", (".ts", ".tsx")))


@dataclass(frozen=True)
class Budget:
    files: int = 500
    bytes: int = 50_000_000
    requests: int = 100
    depth: int = 20
    symbols: int = 1000


def content_scan(blobs: DataFrame, keywords: list[str]) -> DataFrame:
    """path, keyword of blobs (path, text) whose text holds it; a plan asks for Budget.requests keywords at most."""
    held = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("text"), k))
    return blobs.select("path", F.explode(held).alias("keyword"))


def budget_decision(plan: DataFrame, budget: Budget) -> DataFrame:
    """files, bytes and the first limit that a plan (path, size) breaks, null if none."""
    used = plan.dropDuplicates(["path"]).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    reason = F.when(F.col("files") > budget.files, "files").when(F.col("bytes") > budget.bytes, "bytes")
    return used.withColumn("exceeded", reason)


def within_budget(plan: DataFrame, budget: Budget) -> DataFrame:
    """The paths, in order, up to the budget: what the loop may still fetch."""
    first = plan.dropDuplicates(["path"]).orderBy("path").limit(budget.files)
    order = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)  # budget.files rows
    return first.withColumn("total", F.sum("size").over(order)).filter(F.col("total") <= budget.bytes).select("path", "size")


def _words(kind: str, key: str) -> tuple[str, ...]:
    """What a file that answers the requirement holds, any of them."""
    if kind == "symbol":
        return (key,)
    if kind == "importers":
        return tuple(w for w in (posixpath.splitext(posixpath.basename(key))[0],) if w)
    return (key, *CONSUMER_MARKS) if kind == "event" else ENTRY_MARKS


def candidates(requirements: list[tuple[str, str]], tree: DataFrame, status: DataFrame) -> DataFrame:
    """kind, key, path: what may answer each requirement (one of KINDS, key) and isn't indexed yet.

    The key of file and importers is a path, of symbol a name, of event an id; entry_points has any. Importers are found
    by the module's name, the path's last part without its ending.
    """
    if unknown := sorted({kind for kind, _ in requirements} - set(KINDS)):
        raise ValueError(f"unknown kinds of requirements: {', '.join(unknown)}")
    todo = tree.filter("type = 'blob'").join(status.filter("indexed_status = 'indexed'").select("path"), "path", "left_anti")
    files = [key for kind, key in requirements if kind == "file"]
    by_file = todo.filter(F.col("path").isin(files)).select(F.lit("file").alias("kind"), F.col("path").alias("key"), "path")
    scans = [(kind, key, words) for kind, key in dict.fromkeys(requirements) if kind != "file" and (words := _words(kind, key))]
    if not scans:
        return by_file
    held = lambda words: reduce(lambda a, b: a | b, [F.contains(F.col("text"), F.lit(w)) for w in words])
    met = F.array(*[F.when(held(words), F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"))) for kind, key, words in scans])
    by_text = todo.select("path", F.explode(met).alias("met")).filter("met is not null").select("met.kind", "met.key", "path")
    return by_file.unionByName(by_text)


def language_vote(paths: DataFrame) -> DataFrame:
    """The language with most files (path), and its votes; of equals the first in LANGUAGES."""
    vote = lambda ends: F.count_if(F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$"))
    votes = paths.agg(*[vote(ends).alias(name) for name, ends in LANGUAGES])
    rows = votes.select(F.inline(F.array(*[F.struct(F.lit(name).alias("language"), F.col(name).alias("votes"), F.lit(k).alias("k")) for k, (name, _) in enumerate(LANGUAGES)])))
    return rows.orderBy(F.desc("votes"), "k").limit(1).select("language", "votes")


def materialization_plan(paths: DataFrame, tree: DataFrame, status: DataFrame) -> DataFrame:
    """path, action: what is to be done for each path asked for, once: index, skip (indexed from this blob) or missing.

    paths: path, with slashes either way; tree: path, type, blob_sha; status: path, indexed_status, blob_sha.
    """
    from ..functions.names import normal_path

    asked = paths.select(normal_path(F.col("path")).alias("path")).distinct()
    blobs = tree.filter("type = 'blob'").select("path", F.col("blob_sha").alias("now"))
    done = status.filter("indexed_status = 'indexed'").select("path", F.col("blob_sha").alias("before"))
    joined = asked.join(blobs, "path", "left").join(done, "path", "left")
    action = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("before"), "skip").otherwise("index")
    return joined.select("path", action.alias("action"))


def blobs_at(paths: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the blobs at the paths, each once, and the paths that have none: what came does not wait for what failed."""
    asked = paths.select("path").distinct()
    blobs = tree.filter("type = 'blob' and text is not null").select("path", "text")
    return blobs.join(asked, "path", "left_semi"), asked.join(blobs, "path", "left_anti")
