"""Name resolution: imports, callees and base classes, as ordered left joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import bfs


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, name, symbol_id: imported names (file_id, module, name) that a symbol of another file carries whose path holds the module.

    symbols: id, name, file_id, path.  An empty module fits every path.
    """
    other = symbols.select(F.col("id").alias("symbol_id"), "name", F.col("file_id").alias("symbol_file"), "path")
    joined = imports.join(other, "name").filter(F.col("file_id") != F.col("symbol_file"))
    return joined.filter(F.contains("path", F.coalesce("module", F.lit("")))).groupBy("file_id", "name").agg(F.min("symbol_id").alias("symbol_id"))


def ancestors(type_rels: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """class_id, ancestor_id, depth along (source_id, target_id), the class itself at 0."""
    edges = type_rels.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    seeds = type_rels.select(F.col("source_id").alias("class_id"), F.col("source_id").alias("id")).distinct()
    return bfs(edges, seeds, max_depth, keys=("class_id",)).select("class_id", F.col("id").alias("ancestor_id"), "depth")


def resolve_callees(raw: DataFrame, symbols: DataFrame, imported: DataFrame, closure: DataFrame) -> DataFrame:
    """call_id, callee_id, rule: the first rule that finds a symbol.

    raw: call_id, file_id, class_id (of the caller, null outside classes), receiver, name.  symbols: id, name,
    file_id, parent_symbol_id.  imported: file_id, name, symbol_id.  closure: class_id, ancestor_id, depth.

    1 a method of the caller's own class, for the receivers self, cls and this; 2 one of its nearest ancestor;
    3 a method of an imported class that is the receiver; 4 a symbol of the same file; 5 an imported symbol;
    6 the smallest symbol of that name anywhere.  Of several symbols the smallest id is taken.
    """
    methods = symbols.filter("parent_symbol_id is not null").groupBy(F.col("parent_symbol_id").alias("owner"), "name").agg(F.min("id").alias("found"))
    own = F.col("receiver").isin("self", "cls", "this")
    up = closure.join(methods.withColumnRenamed("owner", "ancestor_id"), "ancestor_id").groupBy("class_id", "name").agg(F.min(F.struct("depth", "found")).alias("m"))
    r12 = up.select("class_id", "name", F.col("m.depth").alias("up_depth"), F.col("m.found").alias("f12"))
    r1 = methods.select(F.col("owner").alias("class_id"), "name", F.col("found").alias("f1"))
    classes = imported.select("file_id", F.col("name").alias("receiver"), F.col("symbol_id").alias("owner"))
    r3 = classes.join(methods, "owner").select("file_id", "receiver", "name", F.col("found").alias("f3"))
    r4 = symbols.groupBy("file_id", "name").agg(F.min("id").alias("f4"))
    r5 = imported.select("file_id", "name", F.col("symbol_id").alias("f5"))
    r6 = symbols.groupBy("name").agg(F.min("id").alias("f6"))
    joined = raw.join(r1, ["class_id", "name"], "left").join(r12, ["class_id", "name"], "left").join(r3, ["file_id", "receiver", "name"], "left")
    joined = joined.join(r4, ["file_id", "name"], "left").join(r5, ["file_id", "name"], "left").join(r6, "name", "left")
    steps = [(own, "f1"), (own, "f12"), (F.lit(True), "f3"), (F.lit(True), "f4"), (F.lit(True), "f5"), (F.lit(True), "f6")]
    hits = F.array_compact(F.array(*[F.when(cond & F.col(c).isNotNull(), F.struct(F.lit(k + 1).alias("rule"), F.col(c).alias("callee_id"))) for k, (cond, c) in enumerate(steps)]))
    best = F.when(F.size(hits) > 0, F.element_at(hits, 1))
    return joined.select("call_id", best.alias("b")).select("call_id", "b.callee_id", "b.rule")


def resolve_bases(type_rels: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """class_id, base_name, base_id, rule of base classes that are found: 1 in the same file, 2 imported, 3 any of that name.

    type_rels: class_id, file_id, base_name; symbols: id, name, file_id, kind, parent_symbol_id; imported: file_id, name,
    symbol_id.  Rule 3 takes classes that are members of nothing; of several the smallest id counts.
    """
    classes = symbols.filter("kind in ('class', 'interface') and parent_symbol_id is null")
    local = classes.groupBy("file_id", F.col("name").alias("base_name")).agg(F.min("id").alias("b1"))
    known = imported.groupBy("file_id", F.col("name").alias("base_name")).agg(F.min("symbol_id").alias("b2"))
    named = classes.groupBy(F.col("name").alias("base_name")).agg(F.min("id").alias("b3"))
    joined = type_rels.join(local, ["file_id", "base_name"], "left").join(known, ["file_id", "base_name"], "left").join(named, "base_name", "left")
    rule = F.when(F.col("b1").isNotNull(), 1).when(F.col("b2").isNotNull(), 2).when(F.col("b3").isNotNull(), 3)
    return joined.select("class_id", "base_name", F.coalesce("b1", "b2", "b3").alias("base_id"), rule.alias("rule")).filter("base_id is not null")


def resolve_callees_by_name(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, callee_id: the first symbol of that name if it is the only one, else that of the same file, else the first."""
    named = symbols.groupBy("name").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    local = symbols.groupBy("file_id", "name").agg(F.min("id").alias("own"))
    joined = raw.join(named, "name").join(local, ["file_id", "name"], "left")
    return joined.select("call_id", F.when(F.col("n") == 1, F.col("first")).otherwise(F.coalesce("own", "first")).alias("callee_id"))


def reverse_index(edges: DataFrame) -> DataFrame:
    """dst, sources: who points at each symbol, sorted; a hub's list is as long as it has callers."""
    return edges.select("src", "dst").distinct().groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("sources"))


def waiting_index(raw: DataFrame, resolved: DataFrame) -> DataFrame:
    """name, file_id: the files whose calls (call_id, file_id, name) wait for a symbol of that name."""
    return raw.join(resolved.filter("callee_id is not null").select("call_id"), "call_id", "left_anti").select("name", "file_id").distinct()


def affected_files(changed: DataFrame, deleted_symbols: DataFrame, added_names: DataFrame, calls: DataFrame, imports: DataFrame, waiting: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files (id) whose edges an incremental update must resolve anew.

    Those that changed, those that call a deleted symbol or import its file, and those that wait (file_id, name) for a
    name that was added.
    """
    callers = calls.join(deleted_symbols.select(F.col("id").alias("callee_id")), "callee_id", "left_semi").join(symbols.select(F.col("id").alias("caller_id"), "file_id"), "caller_id")
    importers = imports.join(deleted_symbols.select(F.col("file_id").alias("target_file_id")).distinct(), "target_file_id", "left_semi").select(F.col("source_file_id").alias("file_id"))
    waiters = waiting.join(added_names.select("name").distinct(), "name", "left_semi").select("file_id")
    rows = changed.select(F.col("id").alias("file_id")).union(callers.select("file_id")).union(importers).union(waiters)
    return rows.distinct().withColumnRenamed("file_id", "id")


def patch(edges: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with a file_id: those of the affected files are replaced by the fresh ones."""
    own = files.select(F.col("id").alias("file_id"))
    return edges.join(own, "file_id", "left_anti").select(edges.columns).unionByName(fresh.join(own, "file_id", "left_semi").select(edges.columns))
