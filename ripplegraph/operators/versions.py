"""Versions: one level of inheritance, the layered view of a change, coverage, and the lookups over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_files(current: DataFrame, parent: DataFrame) -> DataFrame:
    """Active files of a version: its own rows win, the parent's hold where the version doesn't mention the file."""
    return current.unionByName(parent.join(current.select("id"), "id", "left_anti")).filter("state = 'active'")


def resolve(current: DataFrame, parent: DataFrame, current_files: DataFrame, parent_files: DataFrame, file_key: str = "file_id") -> DataFrame:
    """Facts of a version: its own, and the parent's of files that the version doesn't mention; active files only."""
    inherited = parent.join(current_files.select(F.col("id").alias(file_key)), file_key, "left_anti")
    active = resolve_files(current_files, parent_files).select(F.col("id").alias(file_key))
    return current.unionByName(inherited.select(current.columns)).join(active, file_key, "left_semi").select(current.columns)


@dataclass
class Overlay:
    """A change over a base: files touched, and the head's facts of them."""

    changed_files: DataFrame  # id: added, modified or removed
    head_symbols: DataFrame  # all symbols of the head's touched files


@dataclass
class Change:
    """What a change does to a base version: files and symbols by id, and the facts that come and go, by table.

    Added facts are the head's of files that were added or modified; a table that is not named has none.
    """

    added_files: DataFrame  # id
    modified_files: DataFrame  # id
    removed_files: DataFrame  # id
    added_symbols: DataFrame  # the head's symbols of added and modified files
    removed_symbols: DataFrame  # id
    added: dict[str, DataFrame]
    removed: dict[str, DataFrame]


def change_between(base_files: DataFrame, head_files: DataFrame, base_symbols: DataFrame, head_symbols: DataFrame, base: dict[str, DataFrame], head: dict[str, DataFrame], keys: dict[str, str]) -> Change:
    """The change from a base to a head: files by id and content_sha; facts by table, with the column that names their file."""
    both = base_files.select("id", F.col("content_sha").alias("old")).join(head_files.select("id", F.col("content_sha").alias("new")), "id")
    modified = both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("id")
    added = head_files.select("id").join(base_files.select("id"), "id", "left_anti")
    removed = base_files.select("id").join(head_files.select("id"), "id", "left_anti")
    now, before = added.unionByName(modified), removed.unionByName(modified)
    of = lambda rows, files, key: rows.join(files.select(F.col("id").alias(key)), key, "left_semi").select(rows.columns)
    symbols = of(head_symbols, now, "file_id")
    gone = of(base_symbols, before, "file_id").select("id").join(symbols.select("id"), "id", "left_anti")
    return Change(added, modified, removed, symbols, gone, {t: of(rows, now, keys[t]) for t, rows in head.items()}, {t: of(rows, before, keys[t]) for t, rows in base.items()})


class View:
    """The lookups of a base version under a change, each over all keys at once.

    A symbol of the base counts as unchanged if its file is untouched and the change neither adds nor removes it; what
    hangs on other symbols comes from the change alone.
    """

    def __init__(self, files: DataFrame, symbols: DataFrame, facts: dict[str, DataFrame], change: Change):
        self.base_files, self.base_symbols, self.facts, self.change = files, symbols, facts, change
        self.touched = change.modified_files.select("id").unionByName(change.removed_files.select("id"))

    @property
    def files(self) -> DataFrame:
        """id of every file, touched or not."""
        return self.base_files.select("id").join(self.touched, "id", "left_anti").unionByName(self.change.added_files.select("id")).unionByName(self.change.modified_files.select("id")).distinct()

    @property
    def unchanged(self) -> DataFrame:
        """Symbols of the base that the change leaves as they are."""
        own = self.base_symbols.join(self.touched.select(F.col("id").alias("file_id")), "file_id", "left_anti")
        other = self.change.removed_symbols.select("id").unionByName(self.change.added_symbols.select("id"))
        return own.join(other, "id", "left_anti").select(self.base_symbols.columns)

    @property
    def symbols(self) -> DataFrame:
        return self.unchanged.unionByName(self.change.added_symbols.select(self.base_symbols.columns))

    def _layered(self, table: str, kept: DataFrame) -> DataFrame:
        """Kept facts of the base without those that the change removes, and with those that it adds."""
        columns = self.facts[table].columns
        if table in self.change.removed:
            same = [kept[c].eqNullSafe(self.change.removed[table][c]) for c in columns]
            kept = kept.join(self.change.removed[table].select(columns), reduce(lambda a, b: a & b, same), "left_anti")
        return kept.select(columns).unionByName(self.change.added[table].select(columns)) if table in self.change.added else kept.select(columns)

    def _where_unchanged(self, rows: DataFrame, *keys: str) -> DataFrame:
        for key in keys:
            rows = rows.join(self.unchanged.select(F.col("id").alias(key)), key, "left_semi")
        return rows

    def outward(self, table: str, source: str, target: str) -> DataFrame:
        """Edges by their source (callees, references and type relations of a symbol): both ends must be unchanged."""
        return self._layered(table, self._where_unchanged(self.facts[table], source, target))

    def inward(self, table: str, source: str) -> DataFrame:
        """Edges by their target (callers, references and type relations to a symbol, tests): the source must be unchanged."""
        return self._layered(table, self._where_unchanged(self.facts[table], source))

    def of_symbols(self, table: str, key: str = "symbol_id") -> DataFrame:
        """Facts of symbols (endpoints, database relations, events published and consumed)."""
        return self._layered(table, self._where_unchanged(self.facts[table], key))

    def imports(self) -> DataFrame:
        """Imports by their source; what they import must still be there, if it is known."""
        rows = self._of_untouched(self.facts["imports"])
        known = self.files.select(F.col("id").alias("target_file_id"))
        kept = rows.filter("target_file_id is null").unionByName(rows.join(known, "target_file_id", "left_semi").select(rows.columns))
        return self._layered("imports", kept)

    def importers(self) -> DataFrame:
        """Imports by their target, which must still be there."""
        own = self._layered("imports", self._of_untouched(self.facts["imports"]))
        return own.join(self.files.select(F.col("id").alias("target_file_id")), "target_file_id", "left_semi").select(own.columns)

    def _of_untouched(self, imports: DataFrame) -> DataFrame:
        sources = self.base_files.select("id").join(self.touched, "id", "left_anti")
        return imports.join(sources.select(F.col("id").alias("source_file_id")), "source_file_id", "left_semi").select(imports.columns)

    def entry_points(self) -> DataFrame:
        """kind, route, handler_id: the base's of unchanged handlers, the change's endpoints, and its event consumers."""
        route = F.concat("method", F.lit(" "), "path").alias("route")
        rest = self._where_unchanged(self.facts["endpoints"], "symbol_id").select(F.lit("rest_endpoint").alias("kind"), route, F.col("symbol_id").alias("handler_id"))
        if "endpoints" in self.change.added:
            rest = rest.unionByName(self.change.added["endpoints"].select(F.lit("rest_endpoint").alias("kind"), route, F.col("symbol_id").alias("handler_id")))
        if "event_subs" in self.change.added:
            rest = rest.unionByName(self.change.added["event_subs"].select(F.lit("event_consumer").alias("kind"), F.concat(F.lit("event:"), "event_id").alias("route"), F.col("symbol_id").alias("handler_id")))
        return rest

    def symbols_in_files(self) -> DataFrame:
        """Symbols by file: of files that were added or modified the change's, of removed ones none, of others the base's."""
        now = self.change.added_files.select("id").unionByName(self.change.modified_files.select("id"))
        columns = self.base_symbols.columns
        kept = self.base_symbols.join(now.unionByName(self.change.removed_files.select("id")).select(F.col("id").alias("file_id")), "file_id", "left_anti")
        kept = kept.join(self.change.removed_symbols.select("id"), "id", "left_anti").select(columns)
        return kept.unionByName(self.change.added_symbols.join(now.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(columns))


def symbols_view(base: DataFrame, overlay: Overlay) -> DataFrame:
    kept = base.join(overlay.changed_files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    return kept.select(base.columns).unionByName(overlay.head_symbols.select(base.columns))


def edges_view(base: DataFrame, head: DataFrame, overlay: Overlay, symbols: DataFrame) -> DataFrame:
    """Edges (src, dst, file_id) under the change: an edge goes if its source's file is touched or its target is gone."""
    kept = base.join(overlay.changed_files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    kept = kept.join(symbols.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept.select("src", "dst", "file_id").unionByName(head.select("src", "dst", "file_id"))


def repoint_unresolved(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges (src, dst, callee_name) without a target get the smallest symbol of that name; then they are distinct."""
    named = symbols.groupBy(F.col("name").alias("callee_name")).agg(F.min("id").alias("found"))
    joined = edges.join(named, "callee_name", "left")
    return joined.select("src", F.coalesce("dst", "found").alias("dst")).filter(F.col("dst").isNotNull()).distinct()


def tree_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """path and change (added, deleted, modified) of two trees (path, blob_sha)."""
    both = base.select("path", F.col("blob_sha").alias("old"), F.lit(True).alias("in_base")).join(head.select("path", F.col("blob_sha").alias("new"), F.lit(True).alias("in_head")), "path", "full_outer")
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_head").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select("path", change.alias("change")).filter("change is not null")


def materialization_stats(status: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("indexed_status") == s).alias(s)
    return status.agg(F.count("*").alias("total"), n("indexed"), n("failed"), n("pending"))


def materialization_coverage(tree: DataFrame, status: DataFrame) -> DataFrame:
    """Files and bytes that are known and indexed, their shares, and the files' in percent (one place, half up), of a tree's blobs."""
    done = status.filter("indexed_status = 'indexed'").select("path", F.lit(1).alias("done"))
    joined = tree.filter("type = 'blob'").join(done, "path", "left")
    out = joined.agg(
        F.count("*").alias("known_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("known_bytes"),
        F.count("done").alias("indexed_files"), F.coalesce(F.sum(F.when(F.col("done") == 1, F.col("size"))), F.lit(0)).alias("indexed_bytes"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    tenths = F.when(F.col("known_files") > 0, F.expr("(2000 * indexed_files + known_files) div (2 * known_files)")).otherwise(0)
    return out.withColumns({"ratio": share("indexed_files", "known_files"), "bytes_ratio": share("indexed_bytes", "known_bytes"), "percent": tenths / 10})


def remaining_paths(tree: DataFrame, status: DataFrame) -> DataFrame:
    return tree.filter("type = 'blob'").join(status.filter("indexed_status = 'indexed'"), "path", "left_anti").select("path")


def latest_status(rows: DataFrame) -> DataFrame:
    """The last status of each path (path, indexed_status, indexed_at)."""
    last = F.max_by(F.struct("indexed_status"), F.struct("indexed_at", "indexed_status"))
    return rows.groupBy("path").agg(last.alias("s"), F.max("indexed_at").alias("indexed_at")).select("path", "s.indexed_status", "indexed_at")
