"""Queries over the review context, dictionary encoding, name resolution and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import names as N
from ..operators import behavior, planner, resolve, review
from ..sources.testdata import Facts
from .behavior import _NF, _NODES, _nodes, _roots
from .core import CHANGED_FILES, CHANGES, _changed_files, _changes, holds, query


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def _category(name: str, path: str, kind: str) -> str:
    first = f"string_split({name}, '.')[1]"
    tops = " OR ".join(f"starts_with({path}, '{s}')" for s in ("tests/", "test/"))
    rules = [
        (holds(path, K.BUILD_PATHS), "Build"), (holds(path, K.TOOL_PATHS), "Tooling"),
        (f"{holds(path, K.TEST_PATHS)} OR {tops} OR {holds(name, K.TEST_NAMES)} OR lower({kind}) = 'test'", "Test"),
        (_in(name, K.PRIMITIVES), "Runtime"), (_in(first, K.standard_library()), "Standard Library"),
        (f"{_in(first, K.FRAMEWORK_MODULES)} OR {_in(name, K.FRAMEWORK_NAMES)} OR {holds(name, ('middleware', 'router', 'route'))}", "Framework"),
        (f"{_in(first, K.ORM_MODULES)} OR {_in(name, K.ORM_NAMES)} OR {holds(name, K.INFRASTRUCTURE)}", "Infrastructure"),
        (f"{_in(kind, ('worker', 'task', 'event'))} OR {holds(name, K.EVENT)}", "Event"), (f"{_in(kind, ('endpoint', 'route'))} OR {holds(name, K.API)}", "API"),
        (holds(name, K.VALIDATION), "Validation"), (holds(name, K.EXTERNAL), "Integration"), (holds(name, K.SCHEMA), "Database Schema"), (_in(kind, ("class", "interface", "enum")), "Domain Model"),
    ]
    return "CASE " + " ".join(f"WHEN {w} THEN '{c}'" for w, c in rules) + " ELSE 'Business Logic' END"


_CATS = f"@ cats AS (SELECT s.id, {_category('s.name', 'f.path', 's.kind')} AS category FROM symbols s JOIN files f ON f.id = s.file_id) "


@query("symbol_category", "symbols files", _CATS + "SELECT id, category FROM cats")
def _(f: Facts) -> DataFrame:
    return f.symbol_services.select("id", K.symbol_category(F.col("name"), F.col("path"), F.col("kind")).alias("category"))


@query("scope_pruned_symbols", "symbols files changed", _CATS + f"SELECT id, category FROM cats WHERE NOT {_in('category', review.NOISE)} OR id IN (SELECT id FROM changed)")
def _(f: Facts) -> DataFrame:
    return review.pruned_symbols(f.symbols, f.files, f.changed)


_TIER = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in review.TIERS.items()) + " ELSE 5 END"
_REFS = "SELECT source_id % 20 AS grp, ['change', 'endpoint', 'fan_in', 'unit', 'other', 'operational'][1 + target_id % 6] AS kind, 'ref' || target_id % 300 AS ref_id, source_id * 1000000 + target_id AS seq FROM refs"


@query("review_references_top10", "refs", f"@ r AS ({_REFS}), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp, ref_id ORDER BY seq) AS n FROM r) WHERE n = 1), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_TIER}, ref_id) AS place FROM d) SELECT grp, place, kind, ref_id FROM p WHERE place <= 10")
def _(f: Facts) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("change", "endpoint", "fan_in", "unit", "other", "operational")])
    refs = f.refs.select((F.col("source_id") % 20).alias("group"), F.element_at(kinds, (F.col("target_id") % 6 + 1).cast("int")).alias("kind"), F.concat(F.lit("ref"), F.col("target_id") % 300).alias("ref_id"), (F.col("source_id") * 1000000 + F.col("target_id")).alias("seq"))
    return review.top_references(refs).withColumnRenamed("group", "grp")


@query("compressed_chain", _NF, _NODES + "SELECT behavior_id, symbol_id, place FROM (SELECT *, count(*) OVER w AS n, max(place) OVER w AS last FROM nodes WINDOW w AS (PARTITION BY behavior_id)) WHERE n < 4 OR place IN (0, last) OR symbol_id IN (SELECT id FROM changed)")
def _(f: Facts) -> DataFrame:
    return behavior.compressed_nodes(f.kept_edges, _roots(f), f.changed)


@query("capped_steps", _NF, _NODES + "SELECT behavior_id, symbol_id, place FROM (SELECT *, symbol_id IN (SELECT id FROM changed) AS c, count(*) FILTER (WHERE symbol_id NOT IN (SELECT id FROM changed)) OVER (PARTITION BY behavior_id ORDER BY place) AS o FROM nodes) WHERE c OR o <= 20")
def _(f: Facts) -> DataFrame:
    return behavior.capped_nodes(f.kept_edges, _roots(f), f.changed)


@query("endpoint_selection", "endpoints changed symbols", f"@ e AS (SELECT *, CASE WHEN file_id IN ({CHANGED_FILES}) THEN 1 ELSE 0 END AS touch FROM endpoints), r AS (SELECT *, row_number() OVER (PARTITION BY touch ORDER BY method, path, id) AS n FROM e) SELECT id, method, path, touch FROM r WHERE touch = 1 OR n <= 50 - (SELECT sum(touch) FROM e)")
def _(f: Facts) -> DataFrame:
    return review.selected_endpoints(f.endpoints, _changed_files(f))


@query("shortest_chains", "endpoints calls changed", _NODES + ", k AS (SELECT e.method, e.symbol_id % 4 AS path, n.behavior_id, count(*) AS n FROM nodes n JOIN endpoints e ON e.symbol_id = n.behavior_id GROUP BY ALL) SELECT method, path, n, behavior_id FROM (SELECT *, row_number() OVER (PARTITION BY method, path ORDER BY n, behavior_id) AS r FROM k) WHERE r = 1")
def _(f: Facts) -> DataFrame:
    n = _nodes(f).groupBy("behavior_id").agg(F.count("*").alias("n"))
    return review.shortest_chains(n.join(f.endpoints.select(F.col("symbol_id").alias("behavior_id"), "method", (F.col("symbol_id") % 4).alias("path")), "behavior_id"))


@query("execution_dag_edges", _NF, _NODES + "SELECT DISTINCT src, symbol_id AS dst FROM (SELECT *, lag(symbol_id) OVER (PARTITION BY behavior_id ORDER BY place) AS src FROM nodes) WHERE src <> symbol_id")
def _(f: Facts) -> DataFrame:
    return behavior.adjacent_steps(f.kept_edges, _roots(f)).filter("src <> dst")


_STRINGS = "@ parts AS (SELECT regexp_extract(url, '^(.*/)?([^/]*)$', 1) AS s, page_id AS k, 0 AS i FROM pages UNION ALL SELECT regexp_extract(url, '^(.*/)?([^/]*)$', 2), page_id, 1 FROM pages), strings AS (SELECT s, row_number() OVER (ORDER BY min((k, i)), s) AS code FROM parts GROUP BY s) "


def _string_parts(f: Facts) -> DataFrame:
    folder, file = review.split_path(F.col("url"))
    return f.pages.select("page_id", F.posexplode(F.array(folder, file)).alias("i", "s"))


@query("string_table", "files", _STRINGS + "SELECT s, code FROM strings")
def _(f: Facts) -> DataFrame:
    return review.dense_codes(_string_parts(f), "s", ["page_id", "i"])


@query("encoded_pages", "files", _STRINGS + "SELECT page_id, a.code AS folder_code, b.code AS file_code FROM pages JOIN strings a ON a.s = regexp_extract(url, '^(.*/)?([^/]*)$', 1) JOIN strings b ON b.s = regexp_extract(url, '^(.*/)?([^/]*)$', 2)")
def _(f: Facts) -> DataFrame:
    codes = review.dense_codes(_string_parts(f), "s", ["page_id", "i"])
    coded = _string_parts(f).join(codes, "s").groupBy("page_id").agg(F.max(F.when(F.col("i") == 0, F.col("code"))).alias("folder_code"), F.max(F.when(F.col("i") == 1, F.col("code"))).alias("file_code"))
    return coded


@query("live_strings", "files", _STRINGS + "SELECT code AS old_code, row_number() OVER (ORDER BY code) AS new_code FROM strings WHERE s IN (SELECT s FROM parts WHERE k % 3 = 0)")
def _(f: Facts) -> DataFrame:
    parts = _string_parts(f)
    codes = review.dense_codes(parts, "s", ["page_id", "i"])
    return review.live_strings(codes, parts.filter("page_id % 3 = 0").join(codes, "s"))


@query("file_table", "files changed symbols", f"SELECT path, row_number() OVER (ORDER BY id) AS code FROM files WHERE id IN ({CHANGED_FILES})")
def _(f: Facts) -> DataFrame:
    return review.dense_codes(f.files.join(_changed_files(f), "id", "left_semi"), "path", ["id"])


@query("symbol_table", "base_symbols head_symbols", CHANGES + "SELECT id, code FROM (SELECT id, row_number() OVER (ORDER BY change, id) AS code FROM ch)")
def _(f: Facts) -> DataFrame:
    return review.dense_codes(_changes(f).select("id", "change"), "id", ["change", "id"])


_KINDS = ("function", "class", "method", "interface", "enum", "variable")


@query("enum_codes", "symbols", "SELECT id, CASE kind " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(_KINDS)) + " ELSE 0 END AS code FROM symbols")
def _(f: Facts) -> DataFrame:
    table = F.create_map(*[x for i, k in enumerate(_KINDS) for x in (F.lit(k), F.lit(i + 1))])
    return f.symbols.select("id", F.coalesce(F.element_at(table, F.col("kind")), F.lit(0)).alias("code"))


@query("metadata_strings", "files", "SELECT path FROM tree WHERE regexp_matches(lower(path), '^(unit|ref|node|edge)://|graph') OR regexp_matches(blob_sha, '^[0-9a-fA-F]{32,}$')".replace("FROM tree", "FROM (SELECT source || '/' || doc_id AS path, sha256(text) AS blob_sha, doc_id FROM documents)"))
def _(f: Facts) -> DataFrame:
    return f.tree.filter(K.is_compiler_metadata(F.col("path")) | K.is_compiler_metadata(F.col("blob_sha"))).select("path")


@query("locations", "symbols files", "SELECT s.id, f.path AS file, s.start_line AS first_line, s.end_line AS last_line FROM symbols s JOIN files f ON f.id = s.file_id")
def _(f: Facts) -> DataFrame:
    text = F.format_string("%s:%d-%d", "path", "start_line", "end_line")
    file, first, last = N.location(F.col("text"))
    return f.symbol_services.select("id", text.alias("text")).select("id", file.alias("file"), first.alias("first_line"), last.alias("last_line"))


@query("service_names", "symbols files", "SELECT s.id, f.service, s.name, f.path FROM symbols s JOIN files f ON f.id = s.file_id")
def _(f: Facts) -> DataFrame:
    fqn = F.concat("language", F.lit("://"), "path", F.lit("::"), "name")
    named = f.symbols.join(f.files.select(F.col("id").alias("file_id"), "path", "language"), "file_id").select("id", fqn.alias("fqn"))
    return named.select("id", N.service_of(F.col("fqn")).alias("service"), N.name_of(F.col("fqn")).alias("name"), N.file_of(F.col("fqn")).alias("path"))


@query("routes", "endpoints", "SELECT id, method, path FROM endpoints")
def _(f: Facts) -> DataFrame:
    route = f.endpoints.select("id", F.concat("method", F.lit(" "), "path").alias("route"))
    return route.select("id", N.route_method(F.col("route")).alias("method"), N.route_path(F.col("route")).alias("path"))


# --- resolution -------------------------------------------------------------------------------------------------------

# Every file imports the names its calls end in; the module is the service's folder of the callee's file, or another.
_IMPORTS = "@ im AS (SELECT DISTINCT a.file_id, t.name, CASE WHEN c.callee_id % 4 = 0 THEN 'nowhere/' ELSE f.service || '/' END AS module FROM calls c JOIN symbols a ON a.id = c.caller_id JOIN symbols t ON t.id = c.callee_id JOIN files f ON f.id = t.file_id), ri AS (SELECT im.file_id, im.name, min(s.id) AS symbol_id FROM im JOIN symbols s ON s.name = im.name JOIN files f ON f.id = s.file_id WHERE s.file_id <> im.file_id AND contains(f.path, im.module) GROUP BY ALL) "


def _imported(f: Facts) -> DataFrame:
    own = f.symbols.select(F.col("id").alias("src"), "file_id")
    target = f.symbol_services.select(F.col("id").alias("dst"), "name", "service")
    module = F.when(F.col("dst") % 4 == 0, "nowhere/").otherwise(F.concat("service", F.lit("/")))
    names = f.edges.join(own, "src").join(target, "dst").select("file_id", "name", module.alias("module")).distinct()
    return resolve.resolve_imports(names, f.symbol_services)


@query("import_resolution", "calls symbols files", _IMPORTS + "SELECT file_id, name, symbol_id FROM ri")
def _(f: Facts) -> DataFrame:
    return _imported(f)


_CALLEES = """, tree AS (SELECT DISTINCT source_id AS class_id, source_id AS ancestor_id, 0 AS depth FROM type_rels UNION SELECT t.class_id, r.target_id, depth + 1 FROM tree t JOIN type_rels r ON r.source_id = t.ancestor_id WHERE depth < 20),
raw AS (SELECT c.caller_id * 1000000 + c.callee_id AS call_id, a.file_id, a.parent_symbol_id AS class_id, CASE WHEN c.callee_id % 3 = 0 THEN 'self' ELSE 'other' END AS receiver, t.name FROM calls c JOIN symbols a ON a.id = c.caller_id JOIN symbols t ON t.id = c.callee_id),
mt AS (SELECT parent_symbol_id AS owner, name, min(id) AS found FROM symbols WHERE parent_symbol_id IS NOT NULL GROUP BY ALL),
up AS (SELECT class_id, name, arg_min(found, (depth, found)) AS found FROM tree JOIN mt ON owner = ancestor_id GROUP BY ALL),
res AS (SELECT call_id, CASE WHEN receiver = 'self' THEN m.found END AS f1, CASE WHEN receiver = 'self' THEN up.found END AS f2, l.found AS f4, ri.symbol_id AS f5, g.found AS f6
 FROM raw LEFT JOIN mt m ON m.owner = raw.class_id AND m.name = raw.name LEFT JOIN up ON up.class_id = raw.class_id AND up.name = raw.name LEFT JOIN (SELECT file_id, name, min(id) AS found FROM symbols GROUP BY ALL) l ON l.file_id = raw.file_id AND l.name = raw.name
 LEFT JOIN ri ON ri.file_id = raw.file_id AND ri.name = raw.name LEFT JOIN (SELECT name, min(id) AS found FROM symbols GROUP BY ALL) g ON g.name = raw.name)
SELECT call_id, coalesce(f1, f2, f4, f5, f6) AS callee_id, CASE WHEN f1 IS NOT NULL THEN 1 WHEN f2 IS NOT NULL THEN 2 WHEN f4 IS NOT NULL THEN 4 WHEN f5 IS NOT NULL THEN 5 WHEN f6 IS NOT NULL THEN 6 END AS rule FROM res"""


@query("callee_resolution", "calls symbols files type_rels", _IMPORTS + _CALLEES)
def _(f: Facts) -> DataFrame:
    own = f.symbols.select(F.col("id").alias("src"), "file_id", F.col("parent_symbol_id").alias("class_id"))
    named = f.edges.join(own, "src").join(f.symbols.select(F.col("id").alias("dst"), "name"), "dst")
    raw = named.select((F.col("src") * 1000000 + F.col("dst")).alias("call_id"), "file_id", "class_id", F.when(F.col("dst") % 3 == 0, "self").otherwise("other").alias("receiver"), "name")
    return resolve.resolve_callees(raw, f.symbols, _imported(f), resolve.ancestors(f.type_rels))


@query("inheritance_closure", "symbols type_rels", "@ tree AS (SELECT DISTINCT source_id AS class_id, source_id AS ancestor_id, 0 AS depth FROM type_rels UNION SELECT t.class_id, r.target_id, depth + 1 FROM tree t JOIN type_rels r ON r.source_id = t.ancestor_id WHERE depth < 20) SELECT class_id, ancestor_id, min(depth) AS depth FROM tree GROUP BY ALL")
def _(f: Facts) -> DataFrame:
    return resolve.ancestors(f.type_rels)


@query("affected_files", "symbols calls imports changed", f"SELECT DISTINCT file_id AS id FROM ({CHANGED_FILES} UNION SELECT s.file_id FROM calls c JOIN symbols s ON s.id = c.caller_id WHERE c.callee_id % 97 = 3 UNION SELECT source_file_id FROM imports WHERE target_file_id IN (SELECT file_id FROM symbols WHERE id % 97 = 3) UNION SELECT file_id FROM symbols WHERE id % 89 = 5)")
def _(f: Facts) -> DataFrame:
    gone = f.symbols.filter("id % 97 = 3")
    return resolve.affected_files(_changed_files(f), gone, f.symbols.filter("id % 89 = 5"), f.calls, f.imports, f.symbols.select("file_id", "name"), f.symbols)


@query("incremental_equals_full", "symbols calls changed", "SELECT c.caller_id AS src, c.callee_id AS dst, s.file_id FROM calls c JOIN symbols s ON s.id = c.caller_id")
def _(f: Facts) -> DataFrame:
    full = f.edges.join(f.symbols.select(F.col("id").alias("src"), "file_id"), "src").select("src", "dst", "file_id")
    files = _changed_files(f)
    stale = full.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("src", (F.col("dst") + 1).alias("dst"), "file_id")
    before = full.join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti").select("src", "dst", "file_id").unionByName(stale)
    return resolve.patch(before, full, files)


# --- planning ---------------------------------------------------------------------------------------------------------


@query("content_scan", "tree materialization", "SELECT path, k AS keyword FROM tree JOIN (VALUES ('token'), ('License'), ('thth')) v(k) ON contains(text, k) WHERE type = 'blob' AND path NOT IN (SELECT path FROM materialization WHERE indexed_status = 'indexed')")
def _(f: Facts) -> DataFrame:
    todo = f.tree.filter("type = 'blob'").join(f.materialization.filter("indexed_status = 'indexed'"), "path", "left_anti")
    return planner.content_scan(todo, ["token", "License", "thth"])


@query("candidates", "tree materialization", "@ todo AS (SELECT * FROM tree WHERE type = 'blob' AND path NOT IN (SELECT path FROM materialization WHERE indexed_status = 'indexed')) SELECT 'file' AS kind, path AS key, path FROM todo WHERE path IN ('src1/21', 'src3/3') UNION ALL SELECT 'symbol', 'token', path FROM todo WHERE contains(text, 'token')")
def _(f: Facts) -> DataFrame:
    return planner.candidates([("file", "src1/21"), ("file", "src3/3"), ("symbol", "token")], f.tree, f.materialization)


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


@query("candidates_by_content", "tree materialization", f"@ todo AS (SELECT * FROM tree WHERE type = 'blob' AND path NOT IN (SELECT path FROM materialization WHERE indexed_status = 'indexed')) SELECT 'importers' AS kind, 'lib/token.py' AS key, path FROM todo WHERE contains(text, 'token') UNION ALL SELECT 'event', '17', path FROM todo WHERE {_any(('17', *planner.CONSUMER_MARKS))} UNION ALL SELECT 'entry_points', '', path FROM todo WHERE {_any(planner.ENTRY_MARKS)}")
def _(f: Facts) -> DataFrame:
    return planner.candidates([("importers", "lib/token.py"), ("event", "17"), ("entry_points", "")], f.tree, f.materialization)


@query("budget_decision", "tree", "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN count(*) > 500 THEN 'files' WHEN sum(size) > 50000000 THEN 'bytes' END AS exceeded FROM tree WHERE type = 'blob'")
def _(f: Facts) -> DataFrame:
    return planner.budget_decision(f.tree.filter("type = 'blob'"), planner.Budget())


@query("within_budget", "tree", "SELECT path, size FROM (SELECT path, size, sum(size) OVER (ORDER BY path) AS total, row_number() OVER (ORDER BY path) AS n FROM tree WHERE type = 'blob') WHERE n <= 500 AND total <= 600000")
def _(f: Facts) -> DataFrame:
    return planner.within_budget(f.tree.filter("type = 'blob'"), planner.Budget(bytes=600_000))


@query("language_vote", "files", "SELECT language, votes FROM (SELECT language, count(*) AS votes FROM files GROUP BY 1) ORDER BY votes DESC, CASE language WHEN 'python' THEN 0 WHEN 'java' THEN 1 ELSE 2 END LIMIT 1")
def _(f: Facts) -> DataFrame:
    return planner.language_vote(f.files)


@query("languages", "files", "SELECT DISTINCT language FROM files")
def _(f: Facts) -> DataFrame:
    return f.files.select("language").distinct()


@query("symbols_capped_per_file", "symbols", "SELECT id, file_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line, id) AS n FROM symbols) WHERE n <= 50")
def _(f: Facts) -> DataFrame:
    return review.capped_per_group(f.symbols.select("id", "file_id", "start_line"), "file_id", ["start_line", "id"]).select("id", "file_id")


_NAMED = "SELECT id FROM symbols WHERE name IN (SELECT name FROM symbols WHERE id IN (SELECT id FROM changed))"


@query("reachable_files", "symbols calls refs endpoints changed", f"SELECT DISTINCT file_id FROM (SELECT file_id FROM symbols WHERE id IN (SELECT caller_id FROM calls WHERE callee_id IN ({_NAMED}) UNION SELECT source_id FROM refs WHERE target_id IN ({_NAMED})) UNION SELECT file_id FROM endpoints WHERE symbol_id IN ({_NAMED}))")
def _(f: Facts) -> DataFrame:
    from ..operators import graph

    names = f.symbols.join(f.changed, "id", "left_semi").select("name").distinct()
    return graph.reachable_files(names, f.symbols, f.calls, f.refs, f.endpoints)
