"""Review context and its dictionary-encoded form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keywords as K

#: Priority of reference kinds; others come last.
TIERS = {"change": 0, "behavior": 1, "entry_point": 1, "endpoint": 1, "boundary": 2, "operational": 2, "cross_service": 2, "discovery": 3, "fan_in": 3, "fan_out": 3, "symbol": 4, "execution": 4, "unit": 4}
NOISE = ("Build", "Tooling", "Test", "Runtime", "Standard Library", "Framework", "Infrastructure")


def tier(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(5))


def top_references(references: DataFrame, k: int = 10) -> DataFrame:
    """Of each group (group, kind, ref_id, seq): distinct ids, the first of each, the k of best tier, by id."""
    first = references.withColumn("n", F.row_number().over(Window.partitionBy("group", "ref_id").orderBy("seq"))).filter("n = 1")
    place = F.row_number().over(Window.partitionBy("group").orderBy(tier(F.col("kind")), "ref_id"))
    return first.withColumn("place", place.cast("long")).filter(F.col("place") <= k).select("group", "place", "kind", "ref_id")


def pruned_symbols(symbols: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """id, category of symbols that are changed or of no noise category."""
    named = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left").join(changed.select("id", F.lit(True).alias("is_changed")), "id", "left")
    category = K.symbol_category(F.col("name"), F.col("path"), F.col("kind"))
    return named.select("id", category.alias("category"), F.coalesce("is_changed", F.lit(False)).alias("is_changed")).filter(~F.col("category").isin(*NOISE) | F.col("is_changed")).select("id", "category")


def compressed_chain(nodes: DataFrame, changed: DataFrame, least: int = 4) -> DataFrame:
    """Chains of ``least`` or more keep their first, last and changed steps, others all (behavior_id, symbol_id, place)."""
    chain = Window.partitionBy("behavior_id")
    marked = nodes.join(changed.select(F.col("id").alias("symbol_id"), F.lit(True).alias("is_changed")), "symbol_id", "left")
    marked = marked.withColumns({"n": F.count("*").over(chain), "last": F.max("place").over(chain), "first": F.min("place").over(chain)})
    return marked.filter((F.col("n") < least) | (F.col("place") == F.col("first")) | (F.col("place") == F.col("last")) | F.col("is_changed")).select("behavior_id", "symbol_id", "place")


def capped_steps(nodes: DataFrame, changed: DataFrame, most: int = 20) -> DataFrame:
    """Changed steps, and the first ``most`` of the others."""
    marked = nodes.join(changed.select(F.col("id").alias("symbol_id"), F.lit(True).alias("is_changed")), "symbol_id", "left")
    others = F.count(F.when(F.col("is_changed").isNull(), 1)).over(Window.partitionBy("behavior_id").orderBy("place"))
    return marked.withColumn("others", others).filter(F.col("is_changed") | (F.col("others") <= most)).select("behavior_id", "symbol_id", "place")


def selected_endpoints(endpoints: DataFrame, changed_files: DataFrame, most: int = 50) -> DataFrame:
    """All endpoints of changed files, and others by (method, path, id) up to ``most`` in all."""
    touched = endpoints.join(changed_files.select(F.col("id").alias("file_id"), F.lit(1).alias("touch")), "file_id", "left").withColumn("touch", F.coalesce("touch", F.lit(0)))
    best = touched.filter("touch = 0").orderBy("method", "path", "id").limit(most)
    n = touched.agg(F.sum("touch").alias("n"))
    place = F.row_number().over(Window.orderBy("method", "path", "id"))  # at most ``most`` rows
    rest = best.withColumn("place", place).crossJoin(n).filter(F.col("place") <= most - F.coalesce("n", F.lit(0)))
    return touched.filter("touch = 1").select("id", "method", "path", "touch").unionByName(rest.select("id", "method", "path", "touch"))


def shortest_chains(chains: DataFrame) -> DataFrame:
    """The shortest chain of each (method, path): (method, path, behavior_id, n), the smaller id of equals."""
    return chains.groupBy("method", "path").agg(F.min(F.struct("n", "behavior_id")).alias("m")).select("method", "path", "m.behavior_id", "m.n")


def numbered(rows: DataFrame, order: list, column: str = "number") -> DataFrame:
    """The rows with their place in the order, from 1, without a window over all rows.

    Rows are ranked inside range partitions; the partitions' sizes give the offsets.  The order should be total.
    """
    from ..scratch import Tables

    tables = Tables(rows.sparkSession, "numbered")
    dealt = tables.put(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each task
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(before, "_part").withColumn(column, F.col("_before") + own).drop("_part", "_before")


def dense_codes(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(column, code): distinct values numbered from 1 in the order of their first row."""
    first = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*order)).alias("first"))
    return numbered(first, ["first", column], "code").select(column, "code")


def split_path(value: Column) -> tuple[Column, Column]:
    """Directory with its last slash, and file; without a slash the directory is empty."""
    return F.regexp_extract(value, "^(.*/)?([^/]*)$", 1), F.substring_index(value, "/", -1)


def dag_edges(chains: DataFrame) -> DataFrame:
    """Distinct (src, dst) of adjacent steps of chains, equal neighbours dropped; chains: behavior_id, symbol_id, place."""
    order = Window.partitionBy("behavior_id").orderBy("place")
    steps = chains.withColumn("src", F.lag("symbol_id").over(order))
    return steps.filter("src is not null and src <> symbol_id").select("src", F.col("symbol_id").alias("dst")).distinct()


def live_strings(strings: DataFrame, used: DataFrame) -> DataFrame:
    """old_code, new_code of the strings in use, in the old order."""
    live = strings.join(used.select("code").distinct(), "code", "left_semi").select(F.col("code").alias("old_code"))
    return dense_codes(live, "old_code", ["old_code"]).withColumnRenamed("code", "new_code")


def capped_per_group(rows: DataFrame, group: str, order: list[str], most: int = 50) -> DataFrame:
    """The first ``most`` rows of each group; Spark cuts each task's rows before they are dealt out."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
