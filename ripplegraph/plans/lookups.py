"""Queries over the lookups of a version with its parent, and of a base version under a change.

Both are derived from the benchmark's facts: a version mentions every tenth file; a change adds, removes and modifies files.
Rows of one side only are told apart by the sum of two of their columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions
from ..sources.testdata import Facts
from .core import CHANGED_FILES, RESOLVED, _changed_files, _files, query

#: By table: the symbol (or file) that a row belongs to, another column, and what a lookup returns.
OWNERS = {
    "calls": ("caller_id", "callee_id"), "refs": ("source_id", "target_id"), "type_rels": ("source_id", "target_id"), "endpoints": ("symbol_id", "id"), "db_rels": ("symbol_id", "resource_id"),
    "event_pubs": ("symbol_id", "event_id"), "event_subs": ("symbol_id", "event_id"), "test_rels": ("test_symbol_id", "target_symbol_id"), "imports": ("source_file_id", "target_file_id"),
}


def _owned(f: Facts, table: str, lost: int) -> DataFrame:
    """The rows of one side, with owner_file."""
    owner, other = OWNERS[table]
    rows = getattr(f, table).filter((F.col(owner) + F.col(other)) % 10 != lost)
    if table == "imports":
        return rows.withColumn("owner_file", F.col(owner))
    return rows.join(f.symbols.select(F.col("id").alias(owner), F.col("file_id").alias("owner_file")), owner)


def _owned_sql(table: str, lost: int) -> str:
    owner, other = OWNERS[table]
    file = "t.source_file_id" if table == "imports" else "s.file_id"
    join = "" if table == "imports" else f" JOIN symbols s ON s.id = t.{owner}"
    return f"SELECT t.*, {file} AS owner_file FROM {table} t{join} WHERE (t.{owner} + t.{other}) % 10 <> {lost}"


# --- a version and its parent -----------------------------------------------------------------------------------------


def _of_version(name: str, table: str, columns: tuple[str, ...], where: str, of: str, key: str) -> None:
    sql = f", rows AS (SELECT * FROM ({_owned_sql(table, 0)}) WHERE owner_file IN (SELECT id FROM cur WHERE state = 'active') UNION ALL SELECT * FROM ({_owned_sql(table, 1)}) WHERE owner_file NOT IN (SELECT id FROM cur)) SELECT {', '.join(columns)} FROM rows WHERE {where}"

    @query(name, f"files base_symbols head_symbols symbols changed {table}", RESOLVED + sql)
    def _(f: Facts) -> DataFrame:
        cur, parent = _files(f)
        mentioned = _owned(f, table, 0).join(cur.select(F.col("id").alias("owner_file")), "owner_file", "left_semi")
        rows = versions.resolve(mentioned, _owned(f, table, 1).select(mentioned.columns), cur, parent, "owner_file")
        keys = {"changed": f.changed, "files": _changed_files(f)}.get(of)
        rows = rows.filter(where) if keys is None else rows.join(keys.select(F.col("id").alias(key)), key, "left_semi")
        return rows.select(*columns)


for _name, _table, _key, _other in (
    ("references_from", "refs", "source_id", "target_id"), ("references_to", "refs", "target_id", "source_id"), ("type_relationships", "type_rels", "source_id", "target_id"), ("type_dependents", "type_rels", "target_id", "source_id"),
    ("endpoints_of_symbol", "endpoints", "symbol_id", "path"), ("db_relationships", "db_rels", "symbol_id", "resource_id"), ("published_events", "event_pubs", "symbol_id", "event_id"), ("tests_of_symbol", "test_rels", "target_symbol_id", "test_symbol_id"),
):
    _of_version(_name, _table, (_key, _other), f"{_key} IN (SELECT id FROM changed)", "changed", _key)
_of_version("event_consumers", "event_subs", ("symbol_id", "event_id"), "event_id = 5", "", "")
_of_version("imports", "imports", ("source_file_id", "module"), f"source_file_id IN ({CHANGED_FILES})", "files", "source_file_id")
_of_version("importers", "imports", ("target_file_id", "source_file_id"), f"target_file_id IN ({CHANGED_FILES})", "files", "target_file_id")


# --- a base under a change --------------------------------------------------------------------------------------------

ADDED, REMOVED = "id % 40 = 21", "id % 40 = 9"
TABLES = tuple(OWNERS)
_VIEW = f"""@ fa AS (SELECT id FROM files WHERE {ADDED}), fr AS (SELECT id FROM files WHERE {REMOVED}),
fm AS (SELECT file_id AS id FROM ({CHANGED_FILES}) EXCEPT SELECT id FROM fa EXCEPT SELECT id FROM fr), ft AS (SELECT id FROM fm UNION ALL SELECT id FROM fr), fn AS (SELECT id FROM fm UNION ALL SELECT id FROM fa),
vb AS (SELECT * FROM base_symbols WHERE file_id NOT IN (SELECT id FROM fa)), ads AS (SELECT * FROM head_symbols WHERE file_id IN (SELECT id FROM fn)),
rms AS (SELECT id FROM vb WHERE file_id IN (SELECT id FROM ft) AND id NOT IN (SELECT id FROM ads)),
unch AS (SELECT * FROM vb WHERE file_id NOT IN (SELECT id FROM ft) AND id NOT IN (SELECT id FROM rms) AND id NOT IN (SELECT id FROM ads)), vf AS (SELECT id FROM files WHERE id NOT IN (SELECT id FROM fr)) """
_FACTS = "files symbols base_symbols head_symbols changed"


def _sides(table: str) -> str:
    return f", b AS (SELECT * FROM ({_owned_sql(table, 1)}) WHERE owner_file NOT IN (SELECT id FROM fa)), h AS (SELECT * FROM ({_owned_sql(table, 0)}) WHERE owner_file IN (SELECT id FROM fn)) "


class Change:
    """The view over the benchmark's facts."""

    def __init__(self, f: Facts):
        self.f = f

    @cached_property
    def view(self) -> versions.View:
        f = self.f
        modified = _changed_files(f).select("id", F.lit("new").alias("now"))
        head_files = f.files.join(modified, "id", "left").filter(f"not ({REMOVED})").select("id", F.coalesce("now", F.lit("old")).alias("content_sha"))
        base_files = f.files.filter(f"not ({ADDED})").select("id", F.lit("old").alias("content_sha"))
        of = lambda rows, files, key: rows.join(files.select(F.col("id").alias(key)), key, "left_semi").select(rows.columns)
        base_symbols, head_symbols = of(f.base_symbols, base_files, "file_id"), of(f.head_symbols, head_files, "file_id")
        base = {t: of(_owned(f, t, 1), base_files, "owner_file") for t in TABLES}
        head = {t: of(_owned(f, t, 0), head_files, "owner_file").select(base[t].columns) for t in TABLES}
        change = versions.change_between(base_files, head_files, base_symbols, head_symbols, base, head, dict.fromkeys(TABLES, "owner_file"))
        return versions.View(base_files, base_symbols, base, change)


def _of_view(name: str, table: str, columns: tuple[str, ...], unchanged: tuple[str, ...], lookup) -> None:
    where = " AND ".join(f"{c} IN (SELECT id FROM unch)" for c in unchanged)

    @query(name, f"{_FACTS} {table}", _VIEW + _sides(table) + f"SELECT {', '.join(columns)} FROM b WHERE {where} UNION ALL SELECT {', '.join(columns)} FROM h")
    def _(f: Facts) -> DataFrame:
        return lookup(Change(f).view).select(*columns)


for _name, _table, _lookup in (("view_callees", "calls", "outward"), ("view_callers", "calls", "inward"), ("view_references_from", "refs", "outward"), ("view_references_to", "refs", "inward"), ("view_type_relationships", "type_rels", "outward"), ("view_type_dependents", "type_rels", "inward"), ("view_tests", "test_rels", "inward")):
    _source, _target = OWNERS[_table]
    _out = _lookup == "outward"
    _of_view(_name, _table, (_source, _target), (_source, _target) if _out else (_source,), (lambda t, s, g: lambda v: v.outward(t, s, g))(_table, _source, _target) if _out else (lambda t, s: lambda v: v.inward(t, s))(_table, _source))
for _name, _table, _other in (("view_endpoints", "endpoints", "path"), ("view_db_relationships", "db_rels", "resource_id"), ("view_published_events", "event_pubs", "event_id"), ("view_event_consumers", "event_subs", "event_id")):
    _of_view(_name, _table, ("symbol_id", _other), ("symbol_id",), (lambda t: lambda v: v.of_symbols(t))(_table))


@query("view_imports", f"{_FACTS} imports", _VIEW + _sides("imports") + "SELECT source_file_id, target_file_id, module FROM b WHERE source_file_id NOT IN (SELECT id FROM ft) AND target_file_id IN (SELECT id FROM vf) UNION ALL SELECT source_file_id, target_file_id, module FROM h")
def _(f: Facts) -> DataFrame:
    return Change(f).view.imports().select("source_file_id", "target_file_id", "module")


@query("view_importers", f"{_FACTS} imports", _VIEW + _sides("imports") + "SELECT target_file_id, source_file_id FROM (SELECT * FROM b WHERE source_file_id NOT IN (SELECT id FROM ft) UNION ALL SELECT * FROM h) WHERE target_file_id IN (SELECT id FROM vf)")
def _(f: Facts) -> DataFrame:
    return Change(f).view.importers().select("target_file_id", "source_file_id")


@query("view_entry_points", f"{_FACTS} endpoints event_subs", _VIEW + _sides("endpoints") + f", hs AS (SELECT * FROM ({_owned_sql('event_subs', 0)}) WHERE owner_file IN (SELECT id FROM fn)) SELECT 'rest_endpoint' AS kind, method || ' ' || path AS route, symbol_id AS handler_id FROM b WHERE symbol_id IN (SELECT id FROM unch) UNION ALL SELECT 'rest_endpoint', method || ' ' || path, symbol_id FROM h UNION ALL SELECT 'event_consumer', 'event:' || event_id, symbol_id FROM hs")
def _(f: Facts) -> DataFrame:
    return Change(f).view.entry_points()


@query("view_symbols", _FACTS, _VIEW + "SELECT id, name, file_id, end_line FROM unch UNION ALL SELECT id, name, file_id, end_line FROM ads")
def _(f: Facts) -> DataFrame:
    return Change(f).view.symbols.select("id", "name", "file_id", "end_line")


@query("view_symbol", _FACTS, _VIEW + "SELECT id, name, file_id, end_line FROM (SELECT * FROM unch UNION ALL SELECT * FROM ads) WHERE id = 42")
def _(f: Facts) -> DataFrame:
    return Change(f).view.symbols.filter("id = 42").select("id", "name", "file_id", "end_line")


@query("view_files", _FACTS, _VIEW + "SELECT id FROM vf")
def _(f: Facts) -> DataFrame:
    return Change(f).view.files


@query("view_symbols_in_file", _FACTS, _VIEW + "SELECT file_id, id, name FROM vb WHERE file_id NOT IN (SELECT id FROM ft) AND id NOT IN (SELECT id FROM rms) UNION ALL SELECT file_id, id, name FROM ads")
def _(f: Facts) -> DataFrame:
    return Change(f).view.symbols_in_files().select("file_id", "id", "name")
