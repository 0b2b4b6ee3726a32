"""The compact context: tables of integers and one string table, and back.

String 0 is the empty string; others are numbered by their first use in (table, row, column) order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C
from .review import dense_codes, split_path


def used_strings(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """s and the place (t, row, col) of every string; tables: (rows with a column row, text columns)."""
    parts = [df.select(F.lit(t).alias("t"), "row", F.posexplode(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("col", "s")) for t, (df, columns) in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts)


def string_table(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """s, code."""
    return dense_codes(used_strings(tables).filter("s <> ''"), "s", ["t", "row", "col"])


def encoded(rows: DataFrame, columns: list[str], strings: DataFrame) -> DataFrame:
    """The rows with each text column as its code, 0 for empty and null."""
    out = rows
    for c in columns:
        own = strings.select(F.col("s").alias(f"_{c}"), F.col("code").alias(f"_{c}_code"))
        out = out.join(own, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(F.col(f"_{c}_code"), F.lit(0))).drop(f"_{c}", f"_{c}_code")
    return out


def decoded(rows: DataFrame, columns: list[str], strings: DataFrame) -> DataFrame:
    out = rows
    for c in columns:
        own = strings.select(F.col("code").alias(f"_{c}"), F.col("s").alias(f"_{c}_text"))
        out = out.join(own, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(F.col(f"_{c}_text"), F.lit(""))).drop(f"_{c}", f"_{c}_text")
    return out


def file_rows(files: DataFrame) -> DataFrame:
    """row, folder, file, language and change type as codes; files: id, path, language, change_type."""
    folder, file = split_path(F.col("path"))
    return files.select(F.col("id").alias("row"), folder.alias("folder"), file.alias("file"), C.code_of("lang", F.col("language")).alias("lang"), C.code_of("ct", F.col("change_type")).alias("ct"))


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """row, name, file, kind and change type as codes, lines; symbols: id, name, file_id, kind, change, start_line, end_line."""
    return symbols.select(F.col("id").alias("row"), "name", F.col("file_id").alias("file"), C.code_of("kind", F.col("kind")).alias("kind"), C.code_of("ct", F.lower("change")).alias("ct"), "start_line", "end_line")


def endpoint_rows(endpoints: DataFrame) -> DataFrame:
    """row, path, method as a code, symbol; the first of each (method, path)."""
    first = endpoints.groupBy("method", "path").agg(F.min(F.struct("id", "symbol_id")).alias("f"))
    return first.select(F.col("f.id").alias("row"), "path", C.code_of("method", F.col("method")).alias("method"), F.col("f.symbol_id").alias("symbol"))


def as_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """row, json: each row as a positional array."""
    return rows.select("row", F.concat(F.lit("["), F.concat_ws(",", *[F.col(c).cast("string") for c in columns]), F.lit("]")).alias("json"))


def live_codes(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """old_code, new_code of the strings that encoded tables still use, numbered from 1 in the old order."""
    from .review import live_strings

    parts = [df.select(F.explode(F.array(*[F.col(c).cast("long") for c in columns])).alias("code")) for df, columns in tables]
    used = reduce(DataFrame.unionByName, parts).filter("code > 0").distinct()
    return live_strings(used, used)


def remapped(rows: DataFrame, columns: list[str], live: DataFrame) -> DataFrame:
    """Encoded rows with the new codes of their text columns; 0 stays 0."""
    out = rows
    for c in columns:
        own = live.select(F.col("old_code").alias(f"_{c}"), F.col("new_code").alias(f"_{c}_new"))
        out = out.join(own, F.col(c) == F.col(f"_{c}"), "left").withColumn(c, F.coalesce(F.col(f"_{c}_new"), F.lit(0)).cast("long")).drop(f"_{c}", f"_{c}_new")
    return out
