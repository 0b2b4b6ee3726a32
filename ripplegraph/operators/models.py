"""Discoveries over composed models, of one schema: kind, subject, members (sorted, comma-joined), n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(column: str) -> Column:
    """Distinct values of a group, sorted and comma-joined; a group is a behaviour's or a symbol's own rows."""
    return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",")


def _row(kind: str, subject: str, members: Column, n: Column):
    return [F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), members.alias("members"), n.cast("long").alias("n")]


def shared_execution(uses: DataFrame) -> DataFrame:
    """Symbols and the distinct behaviours that use them; uses: symbol_id, behavior_id."""
    grouped = uses.groupBy("symbol_id").agg(joined("behavior_id").alias("m"), F.count_distinct("behavior_id").alias("n"))
    return grouped.filter("n > 1").select(*_row("shared_execution", "symbol_id", F.col("m"), F.col("n")))


def coverage(symbols: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: symbols, untested, covered_percent (rounded down); tests: target_symbol_id."""
    hit = tests.select(F.col("target_symbol_id").alias("id")).distinct().withColumn("hit", F.lit(1))
    out = symbols.select("id").join(hit, "id", "left").agg(F.count("*").alias("symbols"), F.count_if(F.col("hit").isNull()).alias("untested"))
    return out.withColumn("covered_percent", F.when(F.col("symbols") > 0, F.expr("(symbols - untested) * 100 div symbols")).otherwise(0))


def shared_dependency(edges: DataFrame, affected: DataFrame) -> DataFrame:
    """Symbols that several affected symbols call."""
    own = edges.join(affected.select(F.col("id").alias("src")), "src", "left_semi")
    grouped = own.groupBy("dst").agg(joined("src").alias("m"), F.count_distinct("src").alias("n"))
    return grouped.filter("n > 1").select(*_row("shared_dependency", "dst", F.col("m"), F.col("n")))


def event_publication(pubs: DataFrame, affected: DataFrame) -> DataFrame:
    """Events that affected symbols publish, and these symbols."""
    own = pubs.join(affected.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    return own.groupBy("event_id").agg(joined("symbol_id").alias("m"), F.count_distinct("symbol_id").alias("n")).select(*_row("event_publication", "event_id", F.col("m"), F.col("n")))


def state_mutation(db_rels: DataFrame, affected: DataFrame) -> DataFrame:
    """Resources that affected symbols write."""
    own = db_rels.filter("relationship_type = 'write'").join(affected.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    return own.groupBy("resource_id").agg(joined("symbol_id").alias("m"), F.count_distinct("symbol_id").alias("n")).select(*_row("state_mutation", "resource_id", F.col("m"), F.col("n")))


def public_interface_change(endpoints: DataFrame, changed: DataFrame) -> DataFrame:
    """Interfaces of changed symbols, the first of each name by (symbol, id)."""
    own = endpoints.join(changed.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("method", "path").orderBy("symbol_id", "id"))).filter("r = 1")
    return first.select(F.lit("public_interface_change").alias("kind"), F.concat("method", F.lit(" "), "path").alias("subject"), F.col("symbol_id").cast("string").alias("members"), F.lit(1).cast("long").alias("n"))


#: Change kinds by what differs.
CLASSES = ("api", "database", "event", "signature", "visibility", "body", "symbol")


def classified_changes(changes: DataFrame, endpoints: DataFrame, db_rels: DataFrame, pubs: DataFrame) -> DataFrame:
    """id, class: one row for each class that a changed symbol falls in; symbol for those that were added or removed."""
    of = lambda df, name: df.select(F.col("symbol_id").alias("id")).distinct().withColumn(name, F.lit(True))
    own = changes.join(of(endpoints, "api"), "id", "left").join(of(db_rels, "database"), "id", "left").join(of(pubs, "event"), "id", "left")
    both = F.col("change") == "MODIFIED"
    differs = lambda c: both & ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    rules = {"api": F.col("api"), "database": F.col("database"), "event": F.col("event"), "signature": differs("signature"), "visibility": differs("visibility"), "body": differs("start_line") | differs("end_line") | differs("body_hash"), "symbol": ~both}
    return own.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).alias("class"))


def capabilities(languages: DataFrame, table: DataFrame) -> DataFrame:
    """capability, supported: whether any language in use (language) has it; table: language, capability."""
    used = languages.select("language").distinct().withColumn("used", F.lit(True))
    return table.join(used, "language", "left").groupBy("capability").agg(F.coalesce(F.bool_or("used"), F.lit(False)).alias("supported"))


def query_statistics(log: DataFrame) -> DataFrame:
    """query, calls, results, total_ms, max_ms, mean of a log of runs (query, results, ms)."""
    out = log.groupBy("query").agg(F.count("*").alias("calls"), F.sum("results").alias("results"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))
    return out.withColumn("mean_ms", F.expr("total_ms div calls"))


def tokens_by_section(sections: DataFrame, ranks: str | None = None) -> DataFrame:
    """section, tokens of the sections' text (section, text).

    With ``ranks``, the path of a byte-pair vocabulary in tiktoken's format that executors can read, its tokens; else words
    and marks.
    """
    if ranks is None:
        return sections.groupBy("section").agg(F.sum(F.regexp_count("text", F.lit(r"\w+|[^\w\s]"))).alias("tokens"))

    def run(batches):
        import base64

        import pyarrow as pa
        import tiktoken

        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(ranks) as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
        encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encoding.encode_ordinary(t or "")) for t in b.column(1).to_pylist()], pa.int64())], names=["section", "n"])

    rows = sections.select("section", "text").mapInArrow(run, f"section {sections.schema['section'].dataType.simpleString()}, n long")
    return rows.groupBy("section").agg(F.sum("n").alias("tokens"))


def block_depths(lines: DataFrame) -> DataFrame:
    """path, line, depth of braces at the end of each line; lines: path, line, text."""
    opens = F.length(F.regexp_replace("text", "[^{]", "")) - F.length(F.regexp_replace("text", "[^}]", ""))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("path", "line", F.sum(opens).over(order).alias("depth"))


def entry_parts(entries: DataFrame) -> DataFrame:
    """id, kind and the parts of an entry point's route: method and path, field, service and method, schedule or queue.

    entries: id, entry_kind (rest, graphql, rpc, cli, cron, worker), route.
    """
    kind, route = F.col("entry_kind"), F.col("route")
    head, tail = F.substring_index(route, " ", 1), F.when(F.contains(route, F.lit(" ")), F.element_at(F.split(route, " ", 2), 2)).otherwise(F.lit(""))
    first = F.when(kind == "rest", F.when(F.contains(route, F.lit(" ")), head).otherwise("GET")).when(kind == "graphql", F.substring_index(route, ".", 1)).when(kind == "rpc", F.substring_index(route, "/", 1)).otherwise(route)
    second = F.when(kind == "rest", F.when(F.contains(route, F.lit(" ")), tail).otherwise(route)).when(kind == "graphql", F.substring_index(route, ".", -1)).when(kind == "rpc", F.substring_index(route, "/", -1)).otherwise("")
    return entries.select("id", "entry_kind", first.alias("first"), second.alias("second"))


def modified_by_name(base: DataFrame, head: DataFrame) -> DataFrame:
    """Head symbols whose (file_id, name) is new or has other lines."""
    old = base.groupBy("file_id", "name").agg(F.max(F.struct("start_line", "end_line")).alias("o"))
    both = head.join(old, ["file_id", "name"], "left")
    return both.filter("o is null or o.start_line <> start_line or o.end_line <> end_line").select("id", "file_id", "name")


def files_to_index(known: DataFrame, now: DataFrame) -> DataFrame:
    """path, action (add, update, delete, skip) by the hash of the content; both have path and content_sha."""
    both = known.select("path", F.col("content_sha").alias("old")).join(now.select("path", F.col("content_sha").alias("new")), "path", "full_outer")
    action = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("skip")
    return both.select("path", action.alias("action"))


def review_document(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, document: each changed file's review as JSON; files: file_id, path, change_type; symbols: id, file_id, name, change."""
    own = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "change"))).alias("symbols"))
    return files.select("file_id", "path", "change_type").join(own, "file_id").select("path", F.to_json(F.struct("path", "change_type", "symbols")).alias("document"))


def review_markdown(files: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """path, text: a heading for each changed file, and its symbols, ``most`` of them by id and how many more there are."""
    own = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", F.format_string("- %s `%s`", F.lower("change"), "name").alias("line")))).alias("s"))
    lines = F.transform(F.slice("s", 1, most), lambda x: x["line"])
    more = F.when(F.size("s") > most, F.concat(F.lit("\n- and "), (F.size("s") - most).cast("string"), F.lit(" more"))).otherwise("")
    return files.join(own, "file_id").select("path", F.concat(F.lit("### "), "path", F.lit(" ("), "change_type", F.lit(")\n"), F.array_join(lines, "\n"), more).alias("text"))
