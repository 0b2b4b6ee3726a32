"""A corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents, whatever further columns there are.

Defined results, in every stage: a null text is empty and stays null; rows that repeat an id and its text share one fate;
rows without an id are never copies of another and are otherwise treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import decontaminate, near_dedup, packing, quality, secret_scan
from ripplegraph.llm.common import Scratch
from ripplegraph.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go; it learns from the labels of ids outside the held-out third.

    Null and empty texts are scored like any other; without labels every score is 0.5, and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels, lambda doc_id: ~quality.held_out(doc_id)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Texts without words are no copies of each other.  Rows that repeat the id that stays, with its text, all stay.
    """
    return near_dedup.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text where that has changed, and null texts stay null."""
    columns, own = docs.columns, F.col("doc")
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias("doc"), F.col("text"))
    found = secret_scan.scan_versions(keyed)
    clean = secret_scan.redact(own["text"], F.col("secret_gaps"))
    changed = {"text": clean, "n_chars": F.when(F.size("secret_spans") > 0, F.length(clean)).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {"text": clean}
    return found.select(*[changed.get(c, own[c]).alias(c) for c in columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids whose lengths are powers of two; a null or empty text is its end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("secret_scan", secret_stage), ("packing", packing_stage)]

#: No SQL: it can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents at sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
