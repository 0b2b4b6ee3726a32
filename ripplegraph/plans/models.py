"""Queries over composed models, classifications and renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import change, impact, models
from ..sources.testdata import Facts
from .behavior import _NF, _NODES, _nodes
from .core import CHANGES, UP, _changes, query


@query("model_shared_execution", _NF, _NODES + "SELECT 'shared_execution' AS kind, CAST(symbol_id AS VARCHAR) AS subject, array_to_string(list_sort(list(DISTINCT CAST(behavior_id AS VARCHAR))), ',') AS members, count(*) AS n FROM nodes GROUP BY symbol_id HAVING count(*) > 1")
def _(f: Facts) -> DataFrame:
    return models.shared_execution(_nodes(f))


@query("model_coverage", "symbols test_rels", "SELECT count(*) AS symbols, count(*) FILTER (WHERE id NOT IN (SELECT target_symbol_id FROM test_rels)) AS untested, count(*) FILTER (WHERE id IN (SELECT target_symbol_id FROM test_rels)) * 100 // count(*) AS covered_percent FROM symbols")
def _(f: Facts) -> DataFrame:
    return models.coverage(f.symbols, f.test_rels)


def _group(kind: str, key: str, member: str, table: str, where: str, having: str = "") -> str:
    return f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS subject, array_to_string(list_sort(list(DISTINCT CAST({member} AS VARCHAR))), ',') AS members, count(DISTINCT {member}) AS n FROM {table} WHERE {where} GROUP BY {key} {having}"


@query("model_shared_dependency", "calls changed", UP + _group("shared_dependency", "callee_id", "caller_id", "calls", "caller_id IN (SELECT id FROM up)", "HAVING count(DISTINCT caller_id) > 1"))
def _(f: Facts) -> DataFrame:
    return models.shared_dependency(f.edges, impact.upstream(f.calls, f.changed))


@query("model_event_publication", "event_pubs changed", _group("event_publication", "event_id", "symbol_id", "event_pubs", "symbol_id IN (SELECT id FROM changed)"))
def _(f: Facts) -> DataFrame:
    return models.event_publication(f.event_pubs, f.changed)


@query("model_state_mutation", "db_rels changed", _group("state_mutation", "resource_id", "symbol_id", "db_rels", "relationship_type = 'write' AND symbol_id IN (SELECT id FROM changed)"))
def _(f: Facts) -> DataFrame:
    return models.state_mutation(f.db_rels, f.changed)


@query("model_public_interface_change", "endpoints changed", "SELECT 'public_interface_change' AS kind, method || ' ' || path AS subject, CAST(min(symbol_id) AS VARCHAR) AS members, CAST(1 AS BIGINT) AS n FROM endpoints WHERE symbol_id IN (SELECT id FROM changed) GROUP BY method, path")
def _(f: Facts) -> DataFrame:
    return models.public_interface_change(f.endpoints, f.changed)


@query("change_classification", "base_symbols head_symbols endpoints db_rels event_pubs", CHANGES + "SELECT id, 'api' AS class FROM ch WHERE id IN (SELECT symbol_id FROM endpoints) UNION ALL SELECT id, 'database' FROM ch WHERE id IN (SELECT symbol_id FROM db_rels) UNION ALL SELECT id, 'event' FROM ch WHERE id IN (SELECT symbol_id FROM event_pubs) UNION ALL SELECT id, 'signature' FROM ch WHERE bg <> hg UNION ALL SELECT id, 'visibility' FROM ch WHERE bv <> hv UNION ALL SELECT id, 'body' FROM ch WHERE bs <> hs OR be <> he OR bb <> hb UNION ALL SELECT id, 'symbol' FROM ch WHERE change <> 'MODIFIED'")
def _(f: Facts) -> DataFrame:
    return models.classified_changes(_changes(f), f.endpoints, f.db_rels, f.event_pubs)


_CAPS = (("python", "calls"), ("python", "events"), ("java", "calls"), ("java", "persistence"), ("typescript", "calls"), ("kotlin", "coroutines"))


@query("capabilities", "files", "SELECT capability, bool_or(language IN (SELECT language FROM files)) AS supported FROM (VALUES " + ", ".join(map(str, _CAPS)) + ") v(language, capability) GROUP BY 1")
def _(f: Facts) -> DataFrame:
    return models.capabilities(f.files, f.spark.createDataFrame(list(_CAPS), "language string, capability string"))


@query("query_statistics", "", "SELECT event_type AS query, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS results, CAST(sum(event_id % 100) AS BIGINT) AS total_ms, max(event_id % 100) AS max_ms, CAST(sum(event_id % 100) // count(*) AS BIGINT) AS mean_ms FROM events GROUP BY 1")
def _(f: Facts) -> DataFrame:
    return models.query_statistics(f.events.selectExpr("event_type AS query", "user_id AS results", "event_id % 100 AS ms"))


@query("tokens_by_section", "", r"SELECT source AS section, CAST(sum(len(regexp_extract_all(text, '[a-z]+'))) AS BIGINT) AS tokens FROM (SELECT source, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS text FROM documents) GROUP BY 1")
def _(f: Facts) -> DataFrame:
    plain = F.regexp_replace(F.lower("text"), "[^a-z]+", " ")
    return models.tokens_by_section(f.documents.select(F.col("source").alias("section"), plain.alias("text")))


@query("block_depths", "", "SELECT 'o' || l_orderkey AS path, row_number() OVER w AS line, CAST(sum(CASE WHEN l_returnflag = 'A' THEN -1 ELSE 2 END) OVER w AS BIGINT) AS depth FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS UNBOUNDED PRECEDING)")
def _(f: Facts) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    text = F.when(F.col("l_returnflag") == "A", "  }").otherwise("if (x) { while (y) {")
    return models.block_depths(f.lineitem.select(F.concat(F.lit("o"), "l_orderkey").alias("path"), F.row_number().over(order).cast("long").alias("line"), text.alias("text")))


_ENTRY = "SELECT id, CASE id // 20 % 4 WHEN 0 THEN 'rest' WHEN 1 THEN 'graphql' WHEN 2 THEN 'rpc' ELSE 'cron' END AS entry_kind, method, path FROM endpoints"


@query("entry_parts", "endpoints", f"@ e AS ({_ENTRY}) SELECT id, entry_kind, CASE entry_kind WHEN 'rest' THEN method WHEN 'graphql' THEN 'Query' WHEN 'rpc' THEN 'Svc' ELSE method || ' ' || path END AS first, CASE entry_kind WHEN 'rest' THEN path WHEN 'graphql' THEN 'f' || id WHEN 'rpc' THEN 'm' || id ELSE '' END AS second FROM e".replace(" AS first", ' AS "first"').replace(" AS second", ' AS "second"'))
def _(f: Facts) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in ("rest", "graphql", "rpc", "cron")]), (F.expr("id div 20 % 4") + 1).cast("int"))
    route = F.when(kind == "graphql", F.concat(F.lit("Query.f"), "id")).when(kind == "rpc", F.concat(F.lit("Svc/m"), "id")).otherwise(F.concat("method", F.lit(" "), "path"))
    return models.entry_parts(f.endpoints.select("id", kind.alias("entry_kind"), route.alias("route")))


@query("modified_by_name", "base_symbols head_symbols", "SELECT h.id, h.file_id, h.name FROM head_symbols h LEFT JOIN (SELECT file_id, name, arg_max(start_line, (start_line, end_line)) AS s, arg_max(end_line, (start_line, end_line)) AS e FROM base_symbols GROUP BY ALL) b ON b.file_id = h.file_id AND b.name = h.name WHERE b.name IS NULL OR b.s <> h.start_line OR b.e <> h.end_line")
def _(f: Facts) -> DataFrame:
    return models.modified_by_name(f.base_symbols, f.head_symbols)


@query("files_to_index", "tree", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' WHEN a.s <> b.s THEN 'update' ELSE 'skip' END AS action FROM (SELECT path, blob_sha AS s FROM tree WHERE doc_id % 6 <> 1) a FULL JOIN (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE blob_sha END AS s FROM tree WHERE doc_id % 6 <> 2) b ON a.path = b.path")
def _(f: Facts) -> DataFrame:
    now = f.tree.filter("doc_id % 6 <> 2").select("path", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("blob_sha")).alias("content_sha"))
    return models.files_to_index(f.tree.filter("doc_id % 6 <> 1").select("path", F.col("blob_sha").alias("content_sha")), now)


def _review(f: Facts) -> tuple[DataFrame, DataFrame]:
    changes = _changes(f)
    files = change.change_files(changes).join(f.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    own = F.coalesce("new", "old")
    return files, changes.select("id", own["file_id"].alias("file_id"), own["name"].alias("name"), "change")


_REVIEW = CHANGES.replace("coalesce(h.kind, b.kind)", "coalesce(h.name, b.name) AS name, coalesce(h.kind, b.kind)") + ", cf AS (SELECT file_id, CASE WHEN count(DISTINCT change) > 1 THEN 'mixed' ELSE lower(min(change)) END AS change_type FROM ch GROUP BY file_id) "


@query("review_markdown", "base_symbols head_symbols files", _REVIEW + "SELECT f.path, '### ' || f.path || ' (' || cf.change_type || ')' || chr(10) || array_to_string(list('- ' || lower(change) || ' `' || ch.name || '`' ORDER BY ch.id)[1:5], chr(10)) || CASE WHEN count(*) > 5 THEN chr(10) || '- and ' || (count(*) - 5) || ' more' ELSE '' END AS text FROM ch JOIN cf USING (file_id) JOIN files f ON f.id = file_id GROUP BY f.path, cf.change_type")
def _(f: Facts) -> DataFrame:
    return models.review_markdown(*_review(f))


@query("review_document", "base_symbols head_symbols files", _REVIEW + """SELECT f.path, '{"path":"' || f.path || '","change_type":"' || cf.change_type || '","symbols":[' || string_agg('{"id":' || ch.id || ',"name":"' || ch.name || '","change":"' || change || '"}', ',' ORDER BY ch.id) || ']}' AS document FROM ch JOIN cf USING (file_id) JOIN files f ON f.id = file_id GROUP BY f.path, cf.change_type""")
def _(f: Facts) -> DataFrame:
    return models.review_document(*_review(f))


@query("consistency_all", "calls symbols head_symbols base_symbols endpoints", "SELECT DISTINCT 'call starts in unknown symbol ' || caller_id AS message FROM calls WHERE caller_id NOT IN (SELECT id FROM head_symbols) UNION ALL SELECT DISTINCT 'call ends in unknown symbol ' || callee_id FROM calls WHERE callee_id NOT IN (SELECT id FROM head_symbols) UNION ALL SELECT DISTINCT 'endpoint of unknown symbol ' || symbol_id FROM endpoints WHERE symbol_id NOT IN (SELECT id FROM head_symbols) UNION ALL SELECT DISTINCT 'symbol with unknown parent ' || parent_symbol_id FROM head_symbols WHERE parent_symbol_id NOT IN (SELECT id FROM head_symbols)")
def _(f: Facts) -> DataFrame:
    from functools import reduce

    checks = ((f.calls, "caller_id", "call starts in unknown symbol %d"), (f.calls, "callee_id", "call ends in unknown symbol %d"), (f.endpoints, "symbol_id", "endpoint of unknown symbol %d"), (f.head_symbols, "parent_symbol_id", "symbol with unknown parent %d"))
    return reduce(DataFrame.unionAll, [change.referential_errors(rows, key, f.head_symbols, text) for rows, key, text in checks])
