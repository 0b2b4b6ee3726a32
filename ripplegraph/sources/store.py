"""A fact store over Parquet: versions of repositories, their fact tables, and what is known of their completeness."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from ..scratch import hadoop_fs
from .commits import Commits, publish

#: Columns of each fact table.
SCHEMAS = {
    "files": "id long, path string, language string, state string",
    "symbols": "id long, name string, file_id long, kind string, language string, start_line int, end_line int, visibility string, parent_symbol_id long, body_hash string, signature string, decorators array<string>",
    "calls": "file_id long, caller_id long, callee_id long, call_type string",
    "refs": "file_id long, source_id long, target_id long, relation_type string",
    "imports": "source_file_id long, target_file_id long, module string, imported_name string, import_type string",
    "type_rels": "file_id long, source_id long, target_id long, relationship_type string",
    "endpoints": "id long, file_id long, symbol_id long, method string, path string, framework string",
    "db_rels": "file_id long, symbol_id long, resource_id long, relationship_type string",
    "event_pubs": "file_id long, symbol_id long, event_id long, publication_type string",
    "event_subs": "file_id long, symbol_id long, event_id long, subscription_type string",
    "test_rels": "file_id long, test_symbol_id long, target_symbol_id long, relationship_type string",
    "tree": "path string, type string, blob_sha string, size long",
    "materialization": "path string, blob_sha string, indexed_status string, indexed_at timestamp",
}
FILE_KEY = {"imports": "source_file_id"}
FLAGS = ("tree_complete", "indexed_complete")


def columns(table: str) -> list[tuple[str, str]]:
    """(name, type) of a table's columns."""
    return [tuple(c.split(" ", 1)) for c in SCHEMAS[table].split(", ")]


class Transaction:
    """Changes to one version that become visible together, or not at all."""

    def __init__(self, store: FactStore, repository: str, version: str):
        self.store, self.commits = store, store._commits(repository, version)
        self.before, self.state = self.commits.current()
        self.old, self.new = dict(self.state.get("tables", {})), {}
        self.flags = {f: self.state.get(f, False) for f in FLAGS}

    def read(self, table: str) -> DataFrame:
        """The table as this transaction has left it; empty if it was never written."""
        folder = self.new.get(table, self.old.get(table))
        return self.commits.read(folder, SCHEMAS[table]) if folder else self.store.spark.createDataFrame([], SCHEMAS[table])

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace the table; columns that the rows lack are null."""
        known = set(rows.columns)
        own = rows.select(*[(F.col(name) if name in known else F.lit(None)).cast(kind).alias(name) for name, kind in columns(table)])
        folder = self.commits.attempt(own, table)
        if table in self.new:
            self.commits.remove(self.new[table])
        self.new[table] = folder

    def delete_file(self, file_id: int) -> None:
        """Remove a file's facts from every table that has any."""
        for table in SCHEMAS:
            key = "id" if table == "files" else FILE_KEY.get(table, "file_id")
            if key in dict(columns(table)) and (table in self.new or table in self.old):
                self.write(table, self.read(table).filter(~F.col(key).eqNullSafe(file_id)))

    def replace_file(self, file_id: int, facts: dict[str, DataFrame]) -> None:
        """The facts of a file in place of those it had."""
        for table, rows in facts.items():
            key = "id" if table == "files" else FILE_KEY.get(table, "file_id")
            names = [name for name, _ in columns(table)]
            fresh = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in columns(table)])
            self.write(table, self.read(table).filter(~F.col(key).eqNullSafe(file_id)).select(*names).unionByName(fresh))

    def record_tree(self, rows: DataFrame, complete: bool = True) -> None:
        """Replace the tree, and say whether it is whole."""
        self.write("tree", rows)
        self.flags["tree_complete"] = complete

    def upsert_status(self, rows: DataFrame) -> None:
        """Add materialization rows; of each path the last by indexed_at stays."""
        own = rows.select("path", "blob_sha", "indexed_status", F.col("indexed_at").cast("timestamp"))
        own = self.read("materialization").select(own.columns).unionByName(own)
        last = own.groupBy("path").agg(F.max_by(F.struct("blob_sha", "indexed_status", "indexed_at"), F.struct("indexed_at", "indexed_status")).alias("s"))
        self.write("materialization", last.select("path", "s.*"))

    def set_flag(self, flag: str, value: bool = True) -> None:
        if flag not in FLAGS:
            raise ValueError(f"unknown flag: {flag}")
        self.flags[flag] = value

    def commit(self) -> None:
        try:
            replaced = [self.old[t] for t in self.new if t in self.old]
            self.commits.commit(self.before, {"tables": self.old | self.new, "replaced": replaced, **self.flags})
        except Exception:
            self.rollback()
            raise
        # readers of the state before this one may still be at work; what that state had replaced goes
        self.commits.remove(*self.state.get("replaced", []))

    def rollback(self) -> None:
        self.commits.remove(*self.new.values())


class FactStore:
    """Facts by repository and version.  Reads touch one version's table; writes of a transaction replace tables at once.

    A version must be written before it is read (``LookupError``); a table of it that was never written is empty.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self, repository: str, version: str) -> Commits:
        return Commits(self.spark, f"{self.path}/facts/{quote(repository, safe='')}/{quote(version, safe='')}")

    @contextmanager
    def transaction(self, repository: str, version: str) -> Iterator[Transaction]:
        """Commits at the end of the block; an exception rolls back."""
        own = Transaction(self, repository, version)
        try:
            yield own
        except BaseException:
            own.rollback()
            raise
        own.commit()

    def write(self, table: str, repository: str, version: str, rows: DataFrame) -> None:
        with self.transaction(repository, version) as t:
            t.write(table, rows)

    def read(self, table: str, repository: str, version: str) -> DataFrame:
        if not self._commits(repository, version).current()[0]:
            raise LookupError(f"no facts of {repository} at {version}")
        return Transaction(self, repository, version).read(table)

    def flag(self, flag: str, repository: str, version: str) -> bool:
        return bool(self._commits(repository, version).current()[1].get(flag, False))

    def resolved(self, table: str, repository: str, version: str, parent: str | None) -> DataFrame:
        """The facts of a version with its parent's of files that it doesn't mention."""
        files = self.read("files", repository, version)
        if parent is None:
            active = files.filter("state = 'active'")
            return active if table == "files" else self._of(self.read(table, repository, version), active, table)
        old = self.read("files", repository, parent)
        if table == "files":
            return versions.resolve_files(files, old)
        return versions.resolve(self.read(table, repository, version), self.read(table, repository, parent), files, old, FILE_KEY.get(table, "file_id"))

    @staticmethod
    def _of(rows: DataFrame, active: DataFrame, table: str) -> DataFrame:
        key = FILE_KEY.get(table, "file_id")
        return rows.join(active.select(F.col("id").alias(key)), key, "left_semi").select(rows.columns)

    def delete_file(self, repository: str, version: str, file_id: int) -> None:
        """Remove a file's facts from every table that has any for the version."""
        with self.transaction(repository, version) as t:
            t.delete_file(file_id)

    def upsert_status(self, repository: str, version: str, rows: DataFrame) -> None:
        with self.transaction(repository, version) as t:
            t.upsert_status(rows)

    def next_id(self, table: str, repository: str, version: str) -> int:
        """One more than the largest id of a table that has ids."""
        return (self.read(table, repository, version).agg(F.max("id")).first()[0] or 0) + 1

    def register(self, repository: str, commit: str, parent: str | None = None) -> str:
        """The version id of a commit (repository@commit); it is recorded once, with its parent's version.

        Each version is a file of its own, which only the first of several writers creates.
        """
        version = f"{repository}@{commit}"
        row = {"id": version, "repository": repository, "commit_sha": commit, "parent_version_id": f"{repository}@{parent}" if parent else None}
        publish(self.spark, f"{self.path}/versions", f"{quote(version, safe='')}.json", json.dumps(row) + "\n")
        return version

    def versions(self) -> DataFrame:
        schema = "id string, repository string, commit_sha string, parent_version_id string"
        fs, folder = hadoop_fs(self.spark, f"{self.path}/versions")
        return self.spark.read.schema(schema).json(f"{self.path}/versions") if fs.exists(folder) else self.spark.createDataFrame([], schema)
