"""Queries over entry points, detectors, resolution by name, ids and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import keywords as K
from ..functions import names as N
from ..operators import behavior, operational, planner, resolve, review
from ..sources.testdata import Facts
from .behavior import _NODES, _roots
from .core import CHANGES, _facts_of, holds, query

# Entry points of every kind, by the endpoint's id; some have a detail.
_KINDS = ("rest_endpoint", "graphql_resolver", "rpc_handler", "cli_command", "scheduled_job", "worker_entry", "event_consumer")
_ENTRIES = "@ en AS (SELECT symbol_id AS handler_id, [" + ", ".join(f"'{k}'" for k in _KINDS) + "][CAST(1 + (id // 20) % 7 AS INT)] AS kind, CASE (id // 20) % 7 WHEN 0 THEN method || ' ' || path WHEN 3 THEN 'run-' || id ELSE substr(path, 2) END AS route, CASE WHEN id % 3 = 0 THEN 'detail' || id % 4 END AS detail FROM endpoints) "


def _entries(f: Facts) -> DataFrame:
    kinds, k = F.array(*[F.lit(x) for x in _KINDS]), F.expr("(id div 20) % 7").cast("int")
    route = F.when(k == 0, F.concat("method", F.lit(" "), "path")).when(k == 3, F.concat(F.lit("run-"), "id")).otherwise(F.expr("substr(path, 2)"))
    return f.endpoints.select(F.col("symbol_id").alias("handler_id"), F.element_at(kinds, k + 1).alias("kind"), route.alias("route"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("detail"), F.col("id") % 4)).alias("detail"))


_NEAR = ", near(one, id, depth) USING KEY (one, id) AS (SELECT 1, id, 0 FROM changed UNION SELECT 1, c.caller_id, min(w.depth) + 1 FROM near w JOIN calls c ON c.callee_id = w.id LEFT JOIN recurring.near r ON r.id = c.caller_id WHERE r.id IS NULL AND w.depth < 50 GROUP BY ALL) "


@query("api_tables", "endpoints calls changed", _ENTRIES + _NEAR + """SELECT DISTINCT CASE kind WHEN 'rest_endpoint' THEN 'rest' WHEN 'graphql_resolver' THEN 'graphql' WHEN 'rpc_handler' THEN 'rpc' WHEN 'cli_command' THEN 'cli' WHEN 'scheduled_job' THEN 'cron' ELSE 'workers' END AS "table",
 CASE kind WHEN 'rest_endpoint' THEN split_part(route, ' ', 1) WHEN 'graphql_resolver' THEN coalesce(detail, 'query') WHEN 'rpc_handler' THEN split_part(route, '/', 1) WHEN 'scheduled_job' THEN coalesce(detail, 'unknown') WHEN 'worker_entry' THEN coalesce(detail, route) ELSE route END AS first,
 CASE kind WHEN 'rest_endpoint' THEN split_part(route, ' ', 2) WHEN 'graphql_resolver' THEN split_part(route, '/', 2) WHEN 'rpc_handler' THEN split_part(route, '/', 2) WHEN 'scheduled_job' THEN route ELSE '' END AS second, handler_id FROM en WHERE kind <> 'event_consumer' AND handler_id IN (SELECT id FROM near)""")
def _(f: Facts) -> DataFrame:
    return operational.api_tables(_entries(f), operational.can_reach(f.edges, f.changed))


_BEHAVIORS = _ENTRIES + ", be AS (SELECT 'behavior://' || handler_id AS behavior_id, handler_id AS root_symbol_id, min(kind) AS kind, min(string_split(route, '/')[-1]) AS name, min(route) AS entry_point FROM en GROUP BY handler_id) "


@query("behaviors", "endpoints", _BEHAVIORS + "SELECT * FROM be")
def _(f: Facts) -> DataFrame:
    return behavior.behaviors(_entries(f).withColumnRenamed("handler_id", "symbol_id"))


@query("behavior_entry_points", "endpoints", _BEHAVIORS + "SELECT 'entry://' || behavior_id AS id, behavior_id, root_symbol_id AS symbol_id, kind, entry_point AS route FROM be")
def _(f: Facts) -> DataFrame:
    return behavior.entry_points(behavior.behaviors(_entries(f).withColumnRenamed("handler_id", "symbol_id")))


@query("discovery_projection", "endpoints calls changed db_rels event_pubs", _NODES + "SELECT 'unit://' || behavior_id || '#' || symbol_id AS unit_id, symbol_id, behavior_id, place, symbol_id IN (SELECT symbol_id FROM db_rels) AS data, symbol_id IN (SELECT symbol_id FROM event_pubs) AS event FROM nodes")
def _(f: Facts) -> DataFrame:
    models = operational.composed(repository=f.symbols, change=f.changed, behavior=f.entries, data=f.db_rels, event=f.event_pubs, api=None)
    own = {k: models[k].select(F.col("symbol_id").alias("id")) for k in ("data", "event")}
    return operational.discovery_projection(behavior.graph_nodes(f.kept_edges, _roots(f), attributes=behavior.marks(**own)), {k: models[k] for k in own})


@query("queues", "symbols", f"SELECT id, name FROM symbols WHERE {holds('name', K.QUEUE)}")
def _(f: Facts) -> DataFrame:
    return operational.named(f.symbols, K.QUEUE)


@query("replays", "symbols", f"SELECT id, name FROM symbols WHERE {holds('name', K.REPLAY)}")
def _(f: Facts) -> DataFrame:
    return operational.named(f.symbols, K.REPLAY)


@query("workers", "symbols", f"SELECT id FROM symbols WHERE {holds('name', K.WORKER)} OR {holds('decorators', K.WORKER)}")
def _(f: Facts) -> DataFrame:
    return operational.workers(f.symbols)


@query("coverage_references", "symbols files", f"SELECT id, r AS reference FROM (SELECT s.id, CASE WHEN {holds('s.name', K.COVERAGE)} THEN s.name WHEN {holds('f.path', K.COVERAGE)} THEN lower(f.path) END AS r FROM symbols s JOIN (SELECT id, CASE WHEN id % 6 = 1 THEN 'jacoco/' || path ELSE path END AS path FROM files) f ON f.id = s.file_id) WHERE r IS NOT NULL")
def _(f: Facts) -> DataFrame:
    files = f.files.select("id", F.when(F.col("id") % 6 == 1, F.concat(F.lit("jacoco/"), "path")).otherwise(F.col("path")).alias("path"))
    return operational.coverage_references(f.symbols, files)


# Base classes by name; a class extends the class numbered half as high, every fourth by the name of one in its file.
_BASES = """@ cl AS (SELECT * FROM symbols WHERE kind IN ('class', 'interface') AND parent_symbol_id IS NULL), tr AS (SELECT s.id AS class_id, s.file_id, t.name AS base_name FROM type_rels r JOIN symbols s ON s.id = r.source_id JOIN symbols t ON t.id = r.target_id),
im AS (SELECT s.file_id, t.name, t.id AS symbol_id FROM calls c JOIN symbols s ON s.id = c.caller_id JOIN symbols t ON t.id = c.callee_id),
l AS (SELECT file_id, name, min(id) AS b1 FROM cl GROUP BY ALL), i AS (SELECT file_id, name, min(symbol_id) AS b2 FROM im GROUP BY ALL), a AS (SELECT name, min(id) AS b3 FROM cl GROUP BY ALL) """


@query("base_resolution", "symbols type_rels calls", _BASES + "SELECT class_id, base_name, coalesce(b1, b2, b3) AS base_id, CASE WHEN b1 IS NOT NULL THEN 1 WHEN b2 IS NOT NULL THEN 2 ELSE 3 END AS rule FROM tr LEFT JOIN l ON l.file_id = tr.file_id AND l.name = base_name LEFT JOIN i ON i.file_id = tr.file_id AND i.name = base_name LEFT JOIN a ON a.name = base_name WHERE coalesce(b1, b2, b3) IS NOT NULL")
def _(f: Facts) -> DataFrame:
    own, other = f.symbols.select(F.col("id").alias("source_id"), "file_id"), f.symbols.select(F.col("id").alias("target_id"), F.col("name").alias("base_name"))
    rels = f.type_rels.join(own, "source_id").join(other, "target_id").select(F.col("source_id").alias("class_id"), "file_id", "base_name")
    imported = f.edges.join(f.symbols.select(F.col("id").alias("src"), "file_id"), "src").join(f.symbols.select(F.col("id").alias("dst"), "name"), "dst").select("file_id", "name", F.col("dst").alias("symbol_id"))
    return resolve.resolve_bases(rels, f.symbols, imported)


# Names are shortened, so that several symbols share one.
_SHORT = "@ sy AS (SELECT id, file_id, string_split(name, '_')[1] || id % 50 AS name FROM symbols), raw AS (SELECT c.caller_id * 1000000 + c.callee_id AS call_id, s.file_id, t.name FROM calls c JOIN sy s ON s.id = c.caller_id JOIN sy t ON t.id = c.callee_id) "


def _short(f: Facts) -> tuple[DataFrame, DataFrame]:
    symbols = f.symbols.select("id", "file_id", F.concat(F.substring_index("name", "_", 1), F.col("id") % 50).alias("name"))
    raw = f.edges.join(symbols.select(F.col("id").alias("src"), "file_id"), "src").join(symbols.select(F.col("id").alias("dst"), "name"), "dst")
    return symbols, raw.select((F.col("src") * 1000000 + F.col("dst")).alias("call_id"), "file_id", "name")


@query("callees_by_name", "symbols calls", _SHORT + ", n AS (SELECT name, min(id) AS first, count(*) AS n FROM sy GROUP BY 1), l AS (SELECT file_id, name, min(id) AS own FROM sy GROUP BY ALL) SELECT call_id, CASE WHEN n = 1 THEN first ELSE coalesce(own, first) END AS callee_id FROM raw JOIN n ON n.name = raw.name LEFT JOIN l ON l.file_id = raw.file_id AND l.name = raw.name")
def _(f: Facts) -> DataFrame:
    symbols, raw = _short(f)
    return resolve.resolve_callees_by_name(raw, symbols)


@query("waiting_names", "symbols calls", _SHORT + "SELECT DISTINCT name, file_id FROM raw WHERE name NOT IN (SELECT name FROM sy WHERE id % 3 = 0)")
def _(f: Facts) -> DataFrame:
    symbols, raw = _short(f)
    return resolve.waiting_index(raw, resolve.resolve_callees_by_name(raw, symbols.filter("id % 3 = 0")))


@query("reverse_index", "calls", "SELECT callee_id AS dst, string_agg(caller_id, ',' ORDER BY caller_id) AS sources FROM calls GROUP BY 1")
def _(f: Facts) -> DataFrame:
    return resolve.reverse_index(f.edges).select("dst", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("import_ids", "imports files", "SELECT i.source_file_id, i.target_file_id, f.language || '://' || f.path || '::import::' || string_split(i.module, '.')[1] AS import_id FROM imports i JOIN files f ON f.id = i.source_file_id")
def _(f: Facts) -> DataFrame:
    named = f.imports.join(f.files.select(F.col("id").alias("source_file_id"), "path", "language"), "source_file_id")
    return named.select("source_file_id", "target_file_id", N.import_id(F.col("language"), F.col("path"), F.col("module")).alias("import_id"))


@query("fallback_kinds", "symbols", f"SELECT id, CASE WHEN kind IN ({', '.join(repr(k) for k in C.FALLBACKS['kind'])}) THEN kind ELSE 'function' END AS kind, CASE WHEN visibility IN ('private', 'protected', 'internal') THEN visibility ELSE 'public' END AS visibility FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'strange' ELSE kind END AS kind, CASE WHEN id % 5 = 0 THEN NULL ELSE visibility END AS visibility FROM symbols)")
def _(f: Facts) -> DataFrame:
    kind, visibility = F.when(F.col("id") % 7 == 0, "strange").otherwise(F.col("kind")), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("visibility"))
    return f.symbols.select("id", C.fallen_back("kind", kind).alias("kind"), C.fallen_back("visibility", visibility).alias("visibility"))


@query("surrogate_ids", "symbols files", "@ s AS (SELECT f.path || '#' || s.name AS fqn, min((s.file_id, s.start_line, s.id)) AS first FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY 1) SELECT fqn, row_number() OVER (ORDER BY first, fqn) AS code FROM s")
def _(f: Facts) -> DataFrame:
    named = f.symbol_services.select(F.concat("path", F.lit("#"), "name").alias("fqn"), "file_id", "start_line", "id")
    return review.dense_codes(named, "fqn", ["file_id", "start_line", "id"])


@query("index_of_files", "symbols files changed", "SELECT s.id, s.kind, s.file_id FROM symbols s WHERE s.file_id IN (SELECT id FROM files WHERE language = 'python') AND s.kind IN ('class', 'method')")
def _(f: Facts) -> DataFrame:
    files = f.files.filter("language = 'python'").select(F.col("id").alias("file_id"))
    return f.symbols.join(files, "file_id", "left_semi").filter("kind in ('class', 'method')").select("id", "kind", "file_id")


@query("materialization_plan", "tree materialization", "SELECT path, CASE WHEN now IS NULL THEN 'missing' WHEN done AND d % 3 <> 0 THEN 'skip' ELSE 'index' END AS action FROM (SELECT a.path, t.blob_sha AS now, t.doc_id AS d, t.path IN (SELECT path FROM materialization WHERE indexed_status = 'indexed') AS done FROM (SELECT DISTINCT path FROM (SELECT path FROM tree WHERE doc_id % 2 = 0 UNION ALL SELECT 'lost/' || doc_id FROM tree WHERE doc_id < 20)) a LEFT JOIN (SELECT * FROM tree WHERE type = 'blob') t ON t.path = a.path)")
def _(f: Facts) -> DataFrame:
    asked = f.tree.filter("doc_id % 2 = 0").select(F.concat(F.lit("/"), F.translate("path", "/", "\\")).alias("path")).unionByName(f.tree.filter("doc_id < 20").select(F.concat(F.lit("lost/"), "doc_id").alias("path")))
    status = f.materialization.join(f.tree.select("path", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("blob_sha")).alias("blob_sha")), "path")
    return planner.materialization_plan(asked, f.tree, status)


@query("blobs_missing", "tree", "SELECT path FROM (SELECT DISTINCT 'lost/' || doc_id AS path FROM tree WHERE doc_id < 20 UNION SELECT path FROM tree WHERE type = 'tree' OR text IS NULL)")
def _(f: Facts) -> DataFrame:
    asked = f.tree.select("path").unionByName(f.tree.filter("doc_id < 20").select(F.concat(F.lit("lost/"), "doc_id").alias("path")))
    return planner.blobs_at(asked, f.tree)[1]


@query("modified_contracts", "base_symbols head_symbols", CHANGES + ", c AS (SELECT id, 'body' AS contract FROM ch WHERE change = 'MODIFIED' AND (bs <> hs OR be <> he) UNION ALL SELECT id, 'visibility' FROM ch WHERE change = 'MODIFIED' AND bv <> hv UNION ALL SELECT id, 'decorators' FROM ch WHERE change = 'MODIFIED' AND bd <> hd UNION ALL SELECT id, 'signature' FROM ch WHERE change = 'MODIFIED' AND bg <> hg) SELECT id, contract, false AS empty FROM c UNION ALL SELECT id, 'body', true FROM ch WHERE change = 'MODIFIED' AND id NOT IN (SELECT id FROM c)")
def _(f: Facts) -> DataFrame:
    return _facts_of(f).modified_contracts
