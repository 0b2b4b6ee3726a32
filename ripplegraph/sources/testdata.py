"""Fact tables derived from the benchmark's star schema, as SQL that both Spark and DuckDB run.

``{name}`` stands for another table, ``{div}`` for integer division, ``{sha256}`` for the hex digest function.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")

VERBS = ("get", "save", "publish", "handle", "cache", "test", "worker", "transaction", "benchmark", "integration", "render", "OrderModel")
_VERB = "CASE p_partkey % 12 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(VERBS)) + " END"
_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'method' WHEN 3 THEN 'interface' ELSE 'variable' END"
_SYMBOL = f"""SELECT CAST(p_partkey AS BIGINT) AS id, {_VERB} || '_' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS name,
  CAST(p_partkey % (SELECT count(*) FROM {{supplier}}) AS BIGINT) AS file_id, {_KIND} AS kind, p_size AS start_line,
  p_size + 10 + {{more}} AS end_line, CASE WHEN p_partkey % 7 = {{private}} THEN 'private' ELSE 'public' END AS visibility,
  CAST(CASE WHEN p_partkey % 5 = 2 THEN p_partkey - 1 END AS BIGINT) AS parent_symbol_id, CAST({{body}} AS BIGINT) AS body_hash,
  {{signature}} AS signature, CASE WHEN p_partkey % 3 = 0 THEN 'cached' ELSE '' END || {{traced}} AS decorators FROM {{part}}"""

FACTS = {
    "files": """SELECT CAST(s_suppkey AS BIGINT) AS id, 'svc' || CAST(s_nationkey AS STRING) || '/mod_' || CAST(s_suppkey AS STRING)
  || CASE s_nationkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.ts' END AS path,
  CASE s_nationkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'typescript' END AS language,
  'svc' || CAST(s_nationkey AS STRING) AS service FROM {supplier}""",
    "base_symbols": _SYMBOL.replace("{signature}", "'f(a)'").replace("{traced}", "''").replace("{more}", "0").replace("{private}", "3").replace("{body}", "p_partkey") + " WHERE p_size <> 50",
    "head_symbols": _SYMBOL.replace("{signature}", "CASE WHEN p_size = 13 THEN 'f(a, b)' ELSE 'f(a)' END").replace("{traced}", "CASE WHEN p_size = 14 THEN ',traced' ELSE '' END").replace("{more}", "CASE WHEN p_size = 10 THEN 5 ELSE 0 END").replace("{private}", "CASE WHEN p_size = 11 THEN 4 ELSE 3 END").replace("{body}", "CASE WHEN p_size = 12 THEN p_partkey + 1 ELSE p_partkey END") + " WHERE p_size <> 1",
    "symbols": _SYMBOL.replace("{signature}", "'f(a)'").replace("{traced}", "''").replace("{more}", "0").replace("{private}", "3").replace("{body}", "p_partkey"),
    "changed": "SELECT CAST(p_partkey AS BIGINT) AS id FROM {part} WHERE p_size = 10",
    "calls": """SELECT DISTINCT caller_id, callee_id FROM (SELECT CAST(l_partkey AS BIGINT) AS caller_id, l_quantity,
  CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS BIGINT) AS callee_id
  FROM {lineitem}) AS x WHERE l_quantity >= 48 AND callee_id IS NOT NULL AND caller_id <> callee_id""",
    "refs": """SELECT DISTINCT source_id, target_id FROM (SELECT CAST(l_partkey AS BIGINT) AS source_id, l_quantity,
  CAST(lead(l_partkey, 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS BIGINT) AS target_id
  FROM {lineitem}) AS x WHERE l_quantity BETWEEN 40 AND 41 AND target_id IS NOT NULL AND source_id <> target_id""",
    "imports": """SELECT DISTINCT a.file_id AS source_file_id, b.file_id AS target_file_id, f.path AS module FROM {calls} AS c
  JOIN {symbols} AS a ON a.id = c.caller_id JOIN {symbols} AS b ON b.id = c.callee_id JOIN {files} AS f ON f.id = b.file_id WHERE a.file_id <> b.file_id""",
    "type_rels": "SELECT id AS source_id, id {div} 2 AS target_id FROM {symbols} WHERE kind = 'class' AND id > 0",
    "endpoints": """SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey AS BIGINT) AS symbol_id, CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS BIGINT) AS file_id,
  CASE (p_partkey {div} 20) % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' WHEN 3 THEN 'PATCH' ELSE 'DELETE' END AS method,
  '/' || replace(lower(p_type), ' ', '-') || '/' || CAST(p_partkey % 50 AS STRING) AS path FROM {part} WHERE p_partkey % 20 = 0""",
    "db_rels": "SELECT CAST(user_id AS BIGINT) AS symbol_id, CAST(event_id % 7 AS BIGINT) AS resource_id, CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS relationship_type FROM {events} WHERE event_type = 'purchase'",
    "event_pubs": "SELECT CAST(user_id AS BIGINT) AS symbol_id, CAST(event_id % 11 AS BIGINT) AS event_id FROM {events} WHERE event_type IN ('click', 'signup')",
    "event_subs": "SELECT CAST(user_id AS BIGINT) AS symbol_id, CAST(event_id % 11 AS BIGINT) AS event_id FROM {events} WHERE event_type = 'error'",
    "test_rels": """SELECT c.caller_id AS test_symbol_id, c.callee_id AS target_symbol_id, CASE c.callee_id % 3 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' ELSE 'e2e' END AS relationship_type
  FROM {calls} AS c JOIN {symbols} AS s ON s.id = c.caller_id WHERE s.name LIKE 'test%'""",
    "tree": "SELECT source || '/' || CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 50 = 0 THEN 'tree' ELSE 'blob' END AS type, {sha256} AS blob_sha, n_chars AS size, doc_id, text FROM {documents}",
    "materialization": """SELECT d.source || '/' || CAST(d.doc_id AS STRING) AS path, CASE l.quality WHEN 1 THEN 'indexed' WHEN 0 THEN 'failed' ELSE 'pending' END AS indexed_status
  FROM {documents} AS d LEFT JOIN {labels} AS l ON l.doc_id = d.doc_id""",
}


class Facts:
    """The fact tables of one data folder, as DataFrames made when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._held = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in FACTS and name not in BASE_TABLES:
            raise AttributeError(name)
        if name not in self._held:
            self._held[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet") if name in BASE_TABLES else self._derived(name)
        return self._held[name]

    def _derived(self, name: str) -> DataFrame:
        import re

        text = FACTS[name].replace("{div}", "div").replace("{sha256}", "sha2(text, 256)")
        return self.spark.sql(text, **{t: getattr(self, t) for t in set(re.findall(r"\{(\w+)\}", text))})

    @cached_property
    def kept_edges(self) -> DataFrame:
        """The edges, for queries that read them several times: calls are written once, and what is asked for later starts there."""
        from ..scratch import Tables

        self._held["calls"] = Tables(self.spark, "calls").put(self.calls, "calls")
        return self.edges

    @property
    def edges(self) -> DataFrame:
        return self.calls.selectExpr("caller_id AS src", "callee_id AS dst")

    @cached_property
    def entries(self) -> DataFrame:
        return self.endpoints.select("symbol_id")

    @cached_property
    def symbol_services(self) -> DataFrame:
        return self.symbols.join(self.files.selectExpr("id AS file_id", "service", "path"), "file_id")


def duckdb_with(*names: str) -> str:
    """WITH RECURSIVE and the facts of these names, and those that they need, for DuckDB."""
    import re

    order: list[str] = []

    def add(name: str) -> None:
        if name in FACTS and name not in order:
            for t in re.findall(r"\{(\w+)\}", FACTS[name]):
                add(t)
            order.append(name)

    for n in names:
        add(n)
    text = lambda n: re.sub(r"\{(\w+)\}", r"\1", FACTS[n].replace("{div}", "//").replace("{sha256}", "sha256(text)"))
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({text(n)})" for n in order)
