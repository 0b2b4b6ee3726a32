"""The queries opN_<name> and pipeline, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, license_scan, near_dedup, packing, quality, secret_scan, sharding, suffix_dedup, warc
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path)
    return records.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("secret_spans")
    found = secret_scan.scan_versions(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = secret_scan.span_text(spans)
    counts = [secret_scan.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS s, s + length(hits[i]) AS e FROM (
  SELECT doc_id, hits, vals, i, list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(h) FOR h IN hits[1:i-1]]), 0) AS s
  FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {group}) AS vals
        FROM d WHERE regexp_matches(text, '{p}')) x, unnest(range(1, len(hits) + 1)) AS u(i)
) WHERE length(vals[i]) >= {least}"""


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_spans_sql(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(secret_scan.BASE_RULES))}),
t AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (doc_id)"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)
    return found.withColumnRenamed("id", "vec_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), lambda doc_id: ~quality.held_out(doc_id))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i:i+4]) AS h FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, l.b FROM r JOIN links l ON l.a = r.reach),
c AS (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)"""


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in sorted(license_scan.TEMPLATES.items()))
_WORDS_SQL = f"string_split(trim(regexp_replace(translate({{}}, '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"

OP7_SQL = f"""
WITH t AS (SELECT license, {_WORDS_SQL.format("body")} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(license, body)),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i+4], ' ') AS shingle FROM t, unnest(range(1, len(w) - 3)) AS u(i)),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS_SQL.format("text")} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, r, array_to_string(w[i:i+4], ' ') AS shingle FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
n AS (SELECT license, count(*) AS n_template FROM ts GROUP BY license)
SELECT doc_id, license, count(*) AS n_found, any_value(n_template) AS n_template, count(*) / any_value(n_template) AS containment
FROM ds JOIN ts USING (shingle) JOIN n USING (license) GROUP BY r, doc_id, license HAVING count(*) >= 0.75 * any_value(n_template)"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "item_words", "tiles", "coverage")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents")).select("doc_id", F.col("start").alias("start_word"), F.col("stop").alias("stop_word"), "n_words")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffled_shards(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    crc = F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary"))
    return placed.select("record.doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_warc": op1_warc, "op2_secret_scan": op2_secret_scan, "op3_packing": op3_packing, "op4_ann": op4_ann, "op5_quality": op5_quality, "op6_near_dedup": op6_near_dedup, "op7_license_scan": op7_license_scan, "op8_decontamination": op8_decontamination, "op9_suffix_dedup": op9_suffix_dedup, "op10_sharding": op10_sharding}
ORACLE_SQL = {"op1_warc": OP1_SQL, "op2_secret_scan": OP2_SQL, "op6_near_dedup": OP6_SQL, "op7_license_scan": OP7_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
