"""Queries over the compact context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..operators import change, context, encode, planner, resolver
from ..sources.testdata import Facts
from .core import CHANGES, _changes, query


def _case(table: str, text: str) -> str:
    return f"CASE {text} " + " ".join(f"WHEN '{v}' THEN {k + 1}" for k, v in enumerate(C.CODES[table])) + " ELSE 0 END"


_CF = CHANGES.replace("coalesce(h.kind, b.kind)", "coalesce(h.name, b.name) AS name, coalesce(h.start_line, b.start_line) AS start_line, coalesce(h.end_line, b.end_line) AS end_line, coalesce(h.kind, b.kind)") + """,
cf AS (SELECT file_id AS id, CASE WHEN count(DISTINCT change) > 1 THEN 'mixed' ELSE lower(min(change)) END AS change_type FROM ch GROUP BY file_id),
fr AS (SELECT f.id AS row, regexp_extract(path, '^(.*/)?([^/]*)$', 1) AS folder, regexp_extract(path, '^(.*/)?([^/]*)$', 2) AS file, """ + _case("lang", "language") + " AS lang, " + _case("ct", "change_type") + """ AS ct FROM cf JOIN files f ON f.id = cf.id),
sr AS (SELECT id AS row, name, file_id AS file, """ + _case("kind", "kind") + " AS kind, " + _case("ct", "lower(change)") + """ AS ct, start_line, end_line FROM ch),
er AS (SELECT min(id) AS row, path, """ + _case("method", "method") + """ AS method, min(symbol_id) AS symbol FROM endpoints GROUP BY method, path),
used AS (SELECT 0 AS t, row, 0 AS col, folder AS s FROM fr UNION ALL SELECT 0, row, 1, file FROM fr UNION ALL SELECT 1, row, 0, name FROM sr UNION ALL SELECT 2, row, 0, path FROM er),
st AS (SELECT s, row_number() OVER (ORDER BY min((t, row, col)), s) AS code FROM used WHERE s <> '' GROUP BY s) """
_CT = "base_symbols head_symbols files endpoints"


def _tables(f: Facts) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    changes = _changes(f)
    files = change.change_files(changes).select(F.col("file_id").alias("id"), "change_type").join(f.files.select("id", "path", "language"), "id")
    own = F.coalesce("new", "old")
    symbols = changes.select("id", "change", *[own[c].alias(c) for c in ("name", "file_id", "kind", "start_line", "end_line")])
    fr, sr, er = encode.file_rows(files), encode.symbol_rows(symbols), encode.endpoint_rows(f.endpoints)
    return fr, sr, er, encode.string_table([(fr, ["folder", "file"]), (sr, ["name"]), (er, ["path"])])


@query("context_strings", _CT, _CF + "SELECT s, code FROM st")
def _(f: Facts) -> DataFrame:
    return _tables(f)[3]


@query("context_files", _CT, _CF + "SELECT row, a.code AS folder, b.code AS file, lang, ct FROM fr JOIN st a ON a.s = folder JOIN st b ON b.s = file")
def _(f: Facts) -> DataFrame:
    fr, _, _, strings = _tables(f)
    return encode.encoded(fr, ["folder", "file"], strings)


@query("context_symbols", _CT, _CF + "SELECT row, st.code AS name, file, kind, ct, start_line, end_line FROM sr JOIN st ON st.s = name")
def _(f: Facts) -> DataFrame:
    _, sr, _, strings = _tables(f)
    return encode.encoded(sr, ["name"], strings)


@query("context_endpoints", _CT, _CF + "SELECT row, '[' || st.code || ',' || method || ',' || symbol || ']' AS json FROM er JOIN st ON st.s = path")
def _(f: Facts) -> DataFrame:
    _, _, er, strings = _tables(f)
    return encode.as_json(encode.encoded(er, ["path"], strings), ["path", "method", "symbol"])


@query("context_round_trip", _CT, _CF + "SELECT row, name, file, kind, ct, start_line, end_line FROM sr")
def _(f: Facts) -> DataFrame:
    _, sr, _, strings = _tables(f)
    return encode.decoded(encode.encoded(sr, ["name"], strings), ["name"], strings)


_LIVE = _CF + ", rm AS (SELECT s, row_number() OVER (ORDER BY code) AS code FROM st WHERE s IN (SELECT name FROM sr)) "


@query("context_remapped", _CT, _LIVE + "SELECT row, rm.code AS name, file, kind, ct, start_line, end_line FROM sr JOIN rm ON rm.s = name")
def _(f: Facts) -> DataFrame:
    """The symbols alone, once the other tables and their strings have gone."""
    _, sr, _, strings = _tables(f)
    coded = encode.encoded(sr, ["name"], strings)
    return encode.remapped(coded, ["name"], encode.live_codes([(coded, ["name"])]))


_OBJECT = lambda *columns: "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {v}" for c, v in columns) + " || '}'"


@query("context_document", _CT, _CF + "SELECT 'files' AS section, " + _OBJECT(("row", "row"), ("folder", "a.code"), ("file", "b.code"), ("lang", "lang"), ("ct", "ct")) + " AS json FROM fr JOIN st a ON a.s = folder JOIN st b ON b.s = fr.file UNION ALL SELECT 'symbols', " + _OBJECT(("row", "row"), ("name", "st.code"), ("file", "file"), ("kind", "kind")) + " FROM sr JOIN st ON st.s = name UNION ALL SELECT 'strings', " + _OBJECT(("code", "code"), ("s", "'\"' || s || '\"'")) + " FROM st")
def _(f: Facts) -> DataFrame:
    fr, sr, _, strings = _tables(f)
    files = encode.encoded(fr, ["folder", "file"], strings).select("row", "folder", "file", "lang", "ct")
    symbols = encode.encoded(sr, ["name"], strings).select("row", "name", "file", "kind")
    return context.document_rows(files=files, symbols=symbols, strings=strings.select("code", "s"))


@query("framework_kinds", "files", "SELECT id, CASE id % 4 WHEN 0 THEN 'rest_endpoint' WHEN 1 THEN 'cli_command' WHEN 2 THEN 'worker_entry' ELSE 'unknown' END AS entry_kind FROM files")
def _(f: Facts) -> DataFrame:
    framework = F.element_at(F.array(*[F.lit(x) for x in ("flask", "click", "celery", "none")]), (F.col("id") % 4 + 1).cast("int"))
    return f.files.select("id", C.looked_up(framework, C.ENTRY_KINDS, "unknown").alias("entry_kind"))


@query("resolved_paths", "tree materialization", "@ todo AS (SELECT * FROM tree WHERE type = 'blob' AND path NOT IN (SELECT path FROM materialization WHERE indexed_status = 'indexed')) SELECT path FROM materialization WHERE indexed_status = 'indexed' UNION SELECT path FROM todo WHERE contains(text, 'token') OR contains(text, 'License')")
def _(f: Facts) -> DataFrame:
    follow = iter([[("symbol", "License"), ("symbol", "token")]])
    done, _ = resolver.resolve(f.tree, f.materialization, [("symbol", "token")], lambda paths: next(follow, []), planner.Budget(files=100_000, bytes=1 << 40))
    return done


@query("resolved_paths_fallback", "tree materialization", "SELECT path FROM materialization WHERE indexed_status = 'indexed' UNION SELECT path FROM tree WHERE type = 'blob'")
def _(f: Facts) -> DataFrame:
    return resolver.resolve(f.tree, f.materialization, [("symbol", "th")], lambda paths: [], planner.Budget(files=3))[0]
