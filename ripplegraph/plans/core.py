"""The queries of the impact engine over the benchmark's tables, each with equivalent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import change, impact, operational, versions
from ..sources.testdata import Facts, duckdb_with

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, facts: str = "", sql: str | None = None):
    """Register fn(Facts) as a query; ``sql`` goes behind the WITH of the facts named."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Facts(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = (duckdb_with(*facts.split()) + ("," if sql.lstrip().startswith("@") else " ") + sql.lstrip().removeprefix("@")) if facts else sql
        return fn

    return register


def holds(text: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


# --- impact -----------------------------------------------------------------------------------------------------------

UP = "@ walk AS (SELECT id, 0 AS depth FROM changed UNION SELECT c.caller_id, w.depth + 1 FROM walk w JOIN calls c ON c.callee_id = w.id WHERE w.depth < 15), up AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) "
DOWN = "@ walk AS (SELECT id, 0 AS depth FROM changed UNION SELECT c.callee_id, w.depth + 1 FROM walk w JOIN calls c ON c.caller_id = w.id WHERE w.depth < 15), down AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) "
BOTH = UP + DOWN.replace("@", ",").replace("walk", "walk2")


@query("impact_upstream", "changed calls", UP + "SELECT id, depth FROM up")
def _(f: Facts) -> DataFrame:
    return impact.upstream(f.calls, f.changed)


@query("impact_downstream", "changed calls", DOWN + "SELECT id, depth FROM down")
def _(f: Facts) -> DataFrame:
    return impact.downstream(f.calls, f.changed)


def _surface(f: Facts) -> impact.ImpactSurface:
    return impact.impact(f.calls, f.endpoints, f.db_rels, f.event_pubs, f.changed)


@query("impact_endpoints", "changed calls endpoints", UP + "SELECT e.id, e.method, e.path, e.symbol_id FROM endpoints e WHERE symbol_id IN (SELECT id FROM up)")
def impact_endpoints(f: Facts) -> DataFrame:
    return _surface(f).endpoints.select("id", "method", "path", "symbol_id")


@query("impact_databases", "changed calls db_rels", DOWN + "SELECT symbol_id, resource_id, relationship_type FROM db_rels WHERE symbol_id IN (SELECT id FROM down)")
def _(f: Facts) -> DataFrame:
    return _surface(f).db_rels.select("symbol_id", "resource_id", "relationship_type")


@query("impact_events", "changed calls event_pubs", DOWN + "SELECT symbol_id, event_id FROM event_pubs WHERE symbol_id IN (SELECT id FROM down)")
def _(f: Facts) -> DataFrame:
    return _surface(f).event_pubs.select("symbol_id", "event_id")


@query("impact_full_counts", "changed calls endpoints db_rels event_pubs", BOTH + """SELECT (SELECT count(*) FROM (SELECT id FROM up UNION SELECT id FROM down)) AS symbols,
 (SELECT count(*) FROM endpoints WHERE symbol_id IN (SELECT id FROM up)) AS endpoints, (SELECT count(*) FROM db_rels WHERE symbol_id IN (SELECT id FROM down)) AS db_rels,
 (SELECT count(*) FROM event_pubs WHERE symbol_id IN (SELECT id FROM down)) AS event_pubs""")  # fmt: skip
def _(f: Facts) -> DataFrame:
    s = _surface(f)
    return operational.metrics(symbols=s.symbols, endpoints=s.endpoints, db_rels=s.db_rels, event_pubs=s.event_pubs)


@query("impact_seeds_only", "changed endpoints", "SELECT id, method, path FROM endpoints WHERE symbol_id IN (SELECT id FROM changed)")
def _(f: Facts) -> DataFrame:
    return impact.impact(f.calls, f.endpoints, f.db_rels, f.event_pubs, f.changed, has_calls=False).endpoints.select("id", "method", "path")


@query("reachable_ids", "changed calls", "@ walk AS (SELECT id FROM changed UNION SELECT c.callee_id FROM walk w JOIN calls c ON c.caller_id = w.id) SELECT id FROM walk EXCEPT SELECT id FROM changed")
def _(f: Facts) -> DataFrame:
    return operational.reachable(f.edges, f.changed)


@query("can_reach_affected", "changed calls", "@ walk AS (SELECT id, 0 AS d FROM changed UNION SELECT c.caller_id, d + 1 FROM walk w JOIN calls c ON c.callee_id = w.id WHERE d < 50) SELECT DISTINCT id FROM walk")
def _(f: Facts) -> DataFrame:
    return operational.can_reach(f.edges, f.changed)


@query("dependency_depth", "changed calls", "@ walk AS (SELECT id, 0 AS depth FROM changed UNION SELECT c.callee_id, depth + 1 FROM walk w JOIN calls c ON c.caller_id = w.id WHERE depth < 60) SELECT max(depth) AS dependency_depth FROM (SELECT id, min(depth) AS depth FROM walk GROUP BY id)")
def _(f: Facts) -> DataFrame:
    return operational.dependency_depth(f.edges, f.changed)


# --- lookups over the resolved version --------------------------------------------------------------------------------

# A version that mentions files 0, 10, 20 ...; of these every third is deleted.  Base and head rows hold the facts.
MENTIONED = "id % 10 = 0"
RESOLVED = f"""@ cur AS (SELECT *, CASE WHEN id % 30 = 0 THEN 'deleted' ELSE 'active' END AS state FROM files WHERE {MENTIONED}),
active AS (SELECT id FROM cur WHERE state = 'active' UNION ALL SELECT id FROM files WHERE id NOT IN (SELECT id FROM cur)),
res AS (SELECT * FROM head_symbols WHERE file_id IN (SELECT id FROM cur WHERE state = 'active') UNION ALL SELECT * FROM base_symbols WHERE file_id IN (SELECT id FROM active) AND file_id NOT IN (SELECT id FROM cur)) """


def _files(f: Facts) -> tuple[DataFrame, DataFrame]:
    state = F.when(F.col("id") % 30 == 0, "deleted").otherwise("active")
    return f.files.filter(MENTIONED).withColumn("state", state), f.files.withColumn("state", F.lit("active"))


def _resolved(f: Facts) -> DataFrame:
    cur, parent = _files(f)
    own = f.head_symbols.join(cur.select(F.col("id").alias("file_id")), "file_id", "left_semi").select(f.head_symbols.columns)
    return versions.resolve(own, f.base_symbols, cur, parent)


@query("resolved_symbols", "files base_symbols head_symbols", RESOLVED + "SELECT id, name, file_id, kind, start_line, end_line FROM res")
def _(f: Facts) -> DataFrame:
    return _resolved(f).select("id", "name", "file_id", "kind", "start_line", "end_line")


@query("symbol_by_id", "files base_symbols head_symbols", RESOLVED + "SELECT id, name, kind FROM res WHERE id = 42")
def _(f: Facts) -> DataFrame:
    return _resolved(f).filter("id = 42").select("id", "name", "kind")


@query("symbols_by_ids", "files base_symbols head_symbols changed", RESOLVED + "SELECT id, name, kind FROM res WHERE id IN (SELECT id FROM changed)")
def _(f: Facts) -> DataFrame:
    return _resolved(f).join(f.changed, "id", "left_semi").select("id", "name", "kind")


@query("symbols_in_file", "files base_symbols head_symbols", RESOLVED + "SELECT id, name FROM res WHERE file_id = 7")
def _(f: Facts) -> DataFrame:
    return _resolved(f).filter("file_id = 7").select("id", "name")


@query("file_by_id_or_path", "files", "SELECT id, path, language FROM files WHERE id = 3 OR path = 'svc1/mod_1.java'")
def _(f: Facts) -> DataFrame:
    return f.files.filter("id = 3 or path = 'svc1/mod_1.java'").select("id", "path", "language")


EDGES = RESOLVED + """, e AS (SELECT c.caller_id AS src, c.callee_id AS dst FROM calls c JOIN res s ON s.id = c.caller_id) """


def _call_rows(f: Facts) -> DataFrame:
    return f.edges.join(_resolved(f).select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")


@query("callers", "files base_symbols head_symbols calls changed", EDGES + "SELECT dst AS symbol_id, src AS caller_id FROM e WHERE dst IN (SELECT id FROM changed)")
def _(f: Facts) -> DataFrame:
    return _call_rows(f).join(f.changed.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("symbol_id"), F.col("src").alias("caller_id"))


@query("callees", "files base_symbols head_symbols calls changed", EDGES + "SELECT src AS symbol_id, dst AS callee_id FROM e WHERE src IN (SELECT id FROM changed)")
def _(f: Facts) -> DataFrame:
    return _call_rows(f).join(f.changed.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("symbol_id"), F.col("dst").alias("callee_id"))


CHANGED_FILES = "SELECT DISTINCT file_id FROM symbols WHERE id IN (SELECT id FROM changed)"


def _changed_files(f: Facts) -> DataFrame:
    return f.symbols.join(f.changed, "id", "left_semi").select(F.col("file_id").alias("id")).distinct()


@query("entry_points", "files base_symbols head_symbols endpoints", RESOLVED + "SELECT symbol_id, method || ' ' || path AS route FROM endpoints WHERE file_id IN (SELECT id FROM active)")
def _(f: Facts) -> DataFrame:
    cur, parent = _files(f)
    active = versions.resolve_files(cur, parent).select(F.col("id").alias("file_id"))
    return f.endpoints.join(active, "file_id", "left_semi").select("symbol_id", F.concat("method", F.lit(" "), "path").alias("route"))


# --- layered view -----------------------------------------------------------------------------------------------------

OVERLAY = f"""@ cf AS ({CHANGED_FILES}), view AS (SELECT * FROM base_symbols WHERE file_id NOT IN (SELECT file_id FROM cf) UNION ALL SELECT * FROM head_symbols WHERE file_id IN (SELECT file_id FROM cf)),
be AS (SELECT caller_id AS src, callee_id AS dst, file_id FROM calls JOIN symbols s ON s.id = caller_id WHERE (caller_id + callee_id) % 10 <> 1),
he AS (SELECT caller_id AS src, callee_id AS dst, file_id FROM calls JOIN symbols s ON s.id = caller_id WHERE (caller_id + callee_id) % 10 <> 0) """


def _overlay(f: Facts) -> tuple[versions.Overlay, DataFrame]:
    files = _changed_files(f)
    head = f.head_symbols.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    overlay = versions.Overlay(files, head.select(f.head_symbols.columns))
    return overlay, versions.symbols_view(f.base_symbols, overlay)


def _edge_rows(f: Facts, lost: int) -> DataFrame:
    return f.edges.join(f.symbols.select(F.col("id").alias("src"), "file_id"), "src").filter((F.col("src") + F.col("dst")) % 10 != lost).select("src", "dst", "file_id")


@query("overlay_symbols", "symbols base_symbols head_symbols changed", OVERLAY.split("be AS")[0].rstrip(", \n") + " SELECT id, name, file_id, end_line FROM view")
def _(f: Facts) -> DataFrame:
    return _overlay(f)[1].select("id", "name", "file_id", "end_line")


@query("overlay_calls", "symbols base_symbols head_symbols changed calls", OVERLAY + "SELECT src, dst, file_id FROM be WHERE file_id NOT IN (SELECT file_id FROM cf) AND dst IN (SELECT id FROM view) UNION ALL SELECT src, dst, file_id FROM he WHERE file_id IN (SELECT file_id FROM cf)")
def _(f: Facts) -> DataFrame:
    overlay, view = _overlay(f)
    head = _edge_rows(f, 0).join(overlay.changed_files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return versions.edges_view(_edge_rows(f, 1), head, overlay, view)


@query("overlay_entry_points", "symbols base_symbols head_symbols changed endpoints", OVERLAY.split("be AS")[0].rstrip(", \n") + " SELECT symbol_id, path FROM endpoints WHERE symbol_id IN (SELECT id FROM view)")
def _(f: Facts) -> DataFrame:
    return f.endpoints.join(_overlay(f)[1].select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select("symbol_id", "path")


@query("unresolved_names", "symbols calls", "@ nm AS (SELECT name, min(id) AS found FROM symbols GROUP BY name) SELECT DISTINCT c.caller_id AS src, CASE WHEN c.callee_id % 4 = 0 THEN nm.found ELSE c.callee_id END AS dst FROM calls c JOIN symbols s ON s.id = c.callee_id LEFT JOIN nm ON nm.name = s.name")
def _(f: Facts) -> DataFrame:
    named = f.edges.join(f.symbols.select(F.col("id").alias("dst"), F.col("name").alias("callee_name")), "dst")
    lost = named.select("src", F.when(F.col("dst") % 4 != 0, F.col("dst")).alias("dst"), "callee_name")
    return versions.repoint_unresolved(lost, f.symbols)


@query("view_counts", "symbols base_symbols head_symbols changed refs calls", OVERLAY + "SELECT (SELECT count(*) FROM view) AS symbols, (SELECT count(*) FROM be WHERE file_id NOT IN (SELECT file_id FROM cf) AND dst IN (SELECT id FROM view)) + (SELECT count(*) FROM he WHERE file_id IN (SELECT file_id FROM cf)) AS calls, (SELECT count(*) FROM refs WHERE source_id IN (SELECT id FROM view)) AS refs")
def _(f: Facts) -> DataFrame:
    overlay, view = _overlay(f)
    head = _edge_rows(f, 0).join(overlay.changed_files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    calls = versions.edges_view(_edge_rows(f, 1), head, overlay, view)
    return operational.metrics(symbols=view, calls=calls, refs=f.refs.join(view.select(F.col("id").alias("source_id")), "source_id", "left_semi"))


# --- materialization --------------------------------------------------------------------------------------------------


@query("materialization_stats", "materialization", "SELECT count(*) AS total, count(*) FILTER (WHERE indexed_status = 'indexed') AS indexed, count(*) FILTER (WHERE indexed_status = 'failed') AS failed, count(*) FILTER (WHERE indexed_status = 'pending') AS pending FROM materialization")
def _(f: Facts) -> DataFrame:
    return versions.materialization_stats(f.materialization)


@query("materialization_coverage", "tree materialization", "@ j AS (SELECT t.size, m.path AS done FROM tree t LEFT JOIN (SELECT * FROM materialization WHERE indexed_status = 'indexed') m USING (path) WHERE type = 'blob') SELECT count(*) AS known_files, CAST(sum(size) AS BIGINT) AS known_bytes, count(done) AS indexed_files, CAST(sum(size) FILTER (WHERE done IS NOT NULL) AS BIGINT) AS indexed_bytes, count(done) / count(*) AS ratio, sum(size) FILTER (WHERE done IS NOT NULL) / sum(size) AS bytes_ratio, ((2000 * count(done) + count(*)) // (2 * count(*))) / 10 AS percent FROM j")
def _(f: Facts) -> DataFrame:
    return versions.materialization_coverage(f.tree, f.materialization)


@query("remaining_paths", "tree materialization", "SELECT path FROM tree WHERE type = 'blob' AND path NOT IN (SELECT path FROM materialization WHERE indexed_status = 'indexed')")
def _(f: Facts) -> DataFrame:
    return versions.remaining_paths(f.tree, f.materialization)


@query("tree_entries", "tree changed", "SELECT path, type, size FROM tree WHERE doc_id IN (SELECT id FROM changed)")
def _(f: Facts) -> DataFrame:
    return f.tree.join(f.changed.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("path", "type", "size")


# --- change -----------------------------------------------------------------------------------------------------------

CHANGES = """@ ch AS (SELECT coalesce(h.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'ADDED' WHEN h.id IS NULL THEN 'REMOVED' ELSE 'MODIFIED' END AS change,
 coalesce(h.file_id, b.file_id) AS file_id, coalesce(h.kind, b.kind) AS kind, b.start_line AS bs, h.start_line AS hs, b.end_line AS be, h.end_line AS he, b.visibility AS bv, h.visibility AS hv, b.body_hash AS bb, h.body_hash AS hb, b.signature AS bg, h.signature AS hg, b.decorators AS bd, h.decorators AS hd
 FROM base_symbols b FULL JOIN head_symbols h ON b.id = h.id WHERE b.id IS NULL OR h.id IS NULL OR b.start_line <> h.start_line OR b.end_line <> h.end_line OR b.visibility <> h.visibility OR b.body_hash <> h.body_hash OR b.signature <> h.signature OR b.decorators <> h.decorators) """


def _changes(f: Facts, strict: bool = False) -> DataFrame:
    return change.changed_symbols(f.base_symbols, f.head_symbols, strict)


@query("changed_symbols", "base_symbols head_symbols", CHANGES + "SELECT id, change FROM ch")
def _(f: Facts) -> DataFrame:
    return _changes(f).select("id", "change")


@query("changed_symbols_strict", "base_symbols head_symbols", CHANGES.replace(" OR b.body_hash <> h.body_hash OR b.signature <> h.signature OR b.decorators <> h.decorators", "") + "SELECT id, change FROM ch")
def _(f: Facts) -> DataFrame:
    return _changes(f, True).select("id", "change")


@query("contract_changes", "base_symbols head_symbols", CHANGES + "SELECT id, 'body' AS contract FROM ch WHERE change = 'MODIFIED' AND (bs <> hs OR be <> he) UNION ALL SELECT id, 'visibility' FROM ch WHERE change = 'MODIFIED' AND bv <> hv UNION ALL SELECT id, 'decorators' FROM ch WHERE change = 'MODIFIED' AND bd <> hd UNION ALL SELECT id, 'signature' FROM ch WHERE change = 'MODIFIED' AND bg <> hg")
def _(f: Facts) -> DataFrame:
    return change.contract_changes(_changes(f))


# Both sides' edges and facts, told apart as in the lookups; a diff names the files with an id of 0 to 59.
_EDGE = "SELECT {a} AS src, {b} AS dst FROM {t} WHERE ({a} + {b}) % 10 <> {lost}"
_FACT = "SELECT * FROM {t} WHERE (symbol_id + {b}) % 10 <> {lost}"


def _facts_of(f: Facts, diff: bool = False) -> change.ChangeFacts:
    def side(symbols: DataFrame, lost: int) -> change.Side:
        edges = lambda rows, a, b: rows.select(F.col(a).alias("src"), F.col(b).alias("dst")).filter((F.col("src") + F.col("dst")) % 10 != lost)
        of = lambda rows, b: rows.filter((F.col("symbol_id") + F.col(b)) % 10 != lost)
        imports = f.imports.filter((F.col("source_file_id") + F.col("target_file_id")) % 10 != lost).select(F.col("source_file_id").alias("file_id"), "module")
        return change.Side(symbols, edges(f.calls, "caller_id", "callee_id"), edges(f.refs, "source_id", "target_id"), imports, of(f.endpoints, "id"), of(f.db_rels, "resource_id"), of(f.event_pubs, "event_id"))

    return change.ChangeFacts(side(f.base_symbols, 1), side(f.head_symbols, 0), f.files.filter("id < 60") if diff else None)


def _edge_diff(table: str, a: str, b: str) -> str:
    old, new = (f"(SELECT * FROM ({_EDGE.format(a=a, b=b, t=table, lost=lost)}) WHERE src IN (SELECT id FROM ch))" for lost in (1, 0))
    return f"SELECT src, dst, 'added' AS change FROM (SELECT * FROM {new} EXCEPT SELECT * FROM {old}) UNION ALL SELECT src, dst, 'removed' FROM (SELECT * FROM {old} EXCEPT SELECT * FROM {new})"


def _contracts_sql() -> str:
    arrow = lambda a, b: f"coalesce(CAST({a} AS VARCHAR), '') || ' -> ' || coalesce(CAST({b} AS VARCHAR), '')"
    parts = [f"SELECT id, '{k}' AS contract, 'modified' AS change_kind, {arrow(a, b)} AS detail FROM ch WHERE change = 'MODIFIED' AND ({w})" for k, a, b, w in (("body", "bb", "hb", "bs <> hs OR be <> he"), ("visibility", "bv", "hv", "bv <> hv"), ("decorators", "bd", "hd", "bd <> hd"), ("signature", "bg", "hg", "bg <> hg"))]
    for kind, lost in (("ADDED", 0), ("REMOVED", 1)):
        for contract, table, b, text in (("api", "endpoints", "id", "method || ' ' || path"), ("database", "db_rels", "resource_id", "CAST(resource_id AS VARCHAR)"), ("event_publish", "event_pubs", "event_id", "CAST(event_id AS VARCHAR)")):
            parts.append(f"SELECT symbol_id, '{contract}', '{kind.lower()}', {text} FROM ({_FACT.format(t=table, b=b, lost=lost)}) WHERE symbol_id IN (SELECT id FROM ch WHERE change = '{kind}')")
    return " UNION ALL ".join(parts)


_DIFFED = CHANGES.replace("FROM base_symbols b FULL JOIN head_symbols h", "FROM (SELECT * FROM base_symbols WHERE file_id < 60) b FULL JOIN (SELECT * FROM head_symbols WHERE file_id < 60) h")


@query("change_contracts", "base_symbols head_symbols endpoints db_rels event_pubs", CHANGES + _contracts_sql())
def _(f: Facts) -> DataFrame:
    return _facts_of(f).contracts


@query("change_contracts_in_diff", "base_symbols head_symbols endpoints db_rels event_pubs", _DIFFED + _contracts_sql())
def _(f: Facts) -> DataFrame:
    return _facts_of(f, diff=True).contracts


@query("change_calls", "base_symbols head_symbols calls", CHANGES + _edge_diff("calls", "caller_id", "callee_id"))
def _(f: Facts) -> DataFrame:
    return _facts_of(f).calls


@query("change_references", "base_symbols head_symbols refs", CHANGES + _edge_diff("refs", "source_id", "target_id"))
def _(f: Facts) -> DataFrame:
    return _facts_of(f).references


@query("change_views", "base_symbols head_symbols", CHANGES + "SELECT id, change, kind, file_id FROM ch")
def _(f: Facts) -> DataFrame:
    from functools import reduce

    facts = _facts_of(f)
    return reduce(DataFrame.unionByName, [facts.of_kind(k).withColumn("change", F.lit(k)) for k in ("ADDED", "REMOVED", "MODIFIED")])


@query("rename_detection", "base_symbols head_symbols", CHANGES + "SELECT min(id) FILTER (WHERE change = 'REMOVED') AS old_id, min(id) FILTER (WHERE change = 'ADDED') AS new_id FROM ch GROUP BY kind, file_id HAVING count(*) FILTER (WHERE change = 'REMOVED') = 1 AND count(*) FILTER (WHERE change = 'ADDED') = 1")
def _(f: Facts) -> DataFrame:
    return change.renames(_changes(f))


def _diff_sql(table: str, key: str, old: str, new: str) -> str:
    return f"SELECT {key}, 'added' AS change FROM (SELECT DISTINCT {key} FROM {table} WHERE {new} EXCEPT SELECT {key} FROM {table} WHERE {old}) UNION ALL SELECT {key}, 'removed' FROM (SELECT DISTINCT {key} FROM {table} WHERE {old} EXCEPT SELECT {key} FROM {table} WHERE {new})"


@query("call_diff", "calls", _diff_sql("calls", "caller_id, callee_id", "(caller_id + callee_id) % 10 <> 1", "(caller_id + callee_id) % 10 <> 0"))
def _(f: Facts) -> DataFrame:
    return change.set_difference(f.calls.filter("(caller_id + callee_id) % 10 <> 1"), f.calls.filter("(caller_id + callee_id) % 10 <> 0"), ["caller_id", "callee_id"])


@query("reference_diff", "refs", _diff_sql("refs", "source_id, target_id", "source_id % 3 <> 1", "source_id % 3 <> 2"))
def _(f: Facts) -> DataFrame:
    return change.set_difference(f.refs.filter("source_id % 3 <> 1"), f.refs.filter("source_id % 3 <> 2"), ["source_id", "target_id"])


@query("import_diff", "imports", _diff_sql("imports", "source_file_id, module", "target_file_id % 4 <> 1", "target_file_id % 4 <> 2"))
def _(f: Facts) -> DataFrame:
    return change.set_difference(f.imports.filter("target_file_id % 4 <> 1"), f.imports.filter("target_file_id % 4 <> 2"), ["source_file_id", "module"])


@query("endpoint_diff", "endpoints", "@ b AS (SELECT symbol_id, method, path FROM endpoints WHERE symbol_id % 4 <> 1), h AS (SELECT symbol_id, CASE WHEN symbol_id % 3 = 0 THEN 'ANY' ELSE method END AS method, path FROM endpoints WHERE symbol_id % 4 <> 2) SELECT coalesce(b.symbol_id, h.symbol_id) AS symbol_id, CASE WHEN b.symbol_id IS NULL THEN 'added' WHEN h.symbol_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN h ON b.symbol_id = h.symbol_id WHERE b.symbol_id IS NULL OR h.symbol_id IS NULL OR b.method <> h.method OR b.path <> h.path")
def _(f: Facts) -> DataFrame:
    head = f.endpoints.filter("symbol_id % 4 <> 2").withColumn("method", F.when(F.col("symbol_id") % 3 == 0, "ANY").otherwise(F.col("method")))
    return change.row_difference(f.endpoints.filter("symbol_id % 4 <> 1"), head, "symbol_id", ["method", "path"])


@query("tree_diff", "tree", "@ b AS (SELECT path, blob_sha FROM tree WHERE doc_id % 9 <> 1), h AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE blob_sha END AS blob_sha FROM tree WHERE doc_id % 9 <> 2) SELECT coalesce(b.path, h.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN h.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM b FULL JOIN h ON b.path = h.path WHERE b.path IS NULL OR h.path IS NULL OR b.blob_sha <> h.blob_sha")
def _(f: Facts) -> DataFrame:
    head = f.tree.filter("doc_id % 9 <> 2").withColumn("blob_sha", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("blob_sha")))
    return versions.tree_diff(f.tree.filter("doc_id % 9 <> 1"), head)


@query("review_change_files", "base_symbols head_symbols", CHANGES + "SELECT file_id, CASE WHEN count(DISTINCT change) > 1 THEN 'mixed' ELSE lower(min(change)) END AS change_type, count(*) AS symbols FROM ch GROUP BY file_id")
def _(f: Facts) -> DataFrame:
    return change.change_files(_changes(f))


@query("review_change_summary", "base_symbols head_symbols endpoints", CHANGES + "SELECT count(DISTINCT file_id) AS files, count(*) AS symbols, (SELECT count(*) FROM endpoints) AS behaviors, CASE WHEN count(DISTINCT file_id) > 5 THEN 'wide' WHEN count(DISTINCT file_id) > 1 THEN 'multi_file' ELSE 'local' END AS scope, CASE WHEN bool_or(change = 'ADDED') AND bool_or(change = 'REMOVED') THEN 'mixed' WHEN bool_or(change = 'ADDED') AND NOT bool_or(change = 'MODIFIED') THEN 'addition' WHEN bool_or(change = 'REMOVED') AND NOT bool_or(change = 'ADDED') THEN 'removal' ELSE 'modification' END AS classification FROM ch")
def _(f: Facts) -> DataFrame:
    changes = _changes(f)
    return change.change_summary(change.change_files(changes), f.endpoints, changes)


@query("consistency_errors", "calls head_symbols", "SELECT DISTINCT 'call ends in unknown symbol ' || callee_id AS message FROM calls WHERE callee_id NOT IN (SELECT id FROM head_symbols)")
def _(f: Facts) -> DataFrame:
    return change.referential_errors(f.calls, "callee_id", f.head_symbols, "call ends in unknown symbol %d")
