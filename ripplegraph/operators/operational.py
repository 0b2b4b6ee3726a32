"""Operational surfaces of a change: dependencies, data, events, APIs, validation, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import names as N
from .graph import bfs, reverse


def fan_in_out(edges: DataFrame, affected: DataFrame) -> DataFrame:
    """id, fan_in, fan_out: distinct neighbours of every affected symbol."""
    inward = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("fan_in"))
    outward = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return affected.select("id").join(inward, "id", "left").join(outward, "id", "left").select("id", zero("fan_in"), zero("fan_out"))


def cross_service_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct edges between symbols (id, service) of different services."""
    own = lambda end, name: symbols.select(F.col("id").alias(end), F.col("service").alias(name))
    joined = edges.join(own("src", "src_service"), "src").join(own("dst", "dst_service"), "dst")
    return joined.filter("src_service <> dst_service").select("src", "dst", "src_service", "dst_service").distinct()


def shared_modules(callers: DataFrame, dependents: DataFrame) -> DataFrame:
    """Paths that hold both callers and dependents."""
    return callers.select("path").intersect(dependents.select("path"))


def dependency_depth(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The level at which the search from the seeds ends."""
    return bfs(edges, seeds, None).agg(F.coalesce(F.max("depth"), F.lit(0)).alias("dependency_depth"))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """What the seeds reach, the seeds left out."""
    return bfs(edges, seeds, None).filter("depth > 0").select("id")


def can_reach(edges: DataFrame, targets: DataFrame, max_depth: int = 50) -> DataFrame:
    """Symbols with a path to a target, targets included."""
    return bfs(reverse(edges), targets, max_depth).select("id")


def data_surface(symbols: DataFrame) -> DataFrame:
    """id and what its name says about data: reads, writes, transactional, cached, data_model."""
    name = F.col("name")
    return symbols.select("id", K.holds(name, K.READ).alias("reads"), K.holds(name, K.WRITE).alias("writes"), K.holds(name, K.TRANSACTION).alias("transactional"), K.holds(name, K.CACHE).alias("cached"), K.is_data_model(name, F.col("kind")).alias("data_model"))


def table_names(symbols: DataFrame) -> DataFrame:
    """id and table of classes and interfaces."""
    return symbols.filter("kind in ('class', 'interface')").select("id", N.table_name(F.col("name")).alias("table_name"))


def storage_references(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", F.explode(K.storage_types(F.col("name"))).alias("storage"))


def events_by_name(symbols: DataFrame) -> DataFrame:
    """id, direction (published, consumed), event: one for each keyword in the name."""
    both = [symbols.select("id", F.lit(d).alias("direction"), F.explode(K.events_in(F.col("name"), w)).alias("event")) for d, w in (("published", K.PUBLISH), ("consumed", K.CONSUME))]
    return both[0].unionByName(both[1])


def event_graph(published: DataFrame, consumed: DataFrame) -> DataFrame:
    """Distinct (producer, event, consumer) of other symbols; both sides are (id, event)."""
    pub = published.select(F.col("id").alias("producer"), "event").distinct()
    sub = consumed.select(F.col("id").alias("consumer"), "event").distinct()
    return pub.join(sub, "event").filter("producer <> consumer").select("producer", "event", "consumer")


def async_chains(graph: DataFrame) -> DataFrame:
    """Each edge, and once more each edge that starts where another ends, for each that ends there (a bag)."""
    ends = graph.groupBy(F.col("consumer").alias("producer")).agg(F.count("*").alias("ends"))
    counted = graph.join(ends, "producer", "left").select("producer", "event", "consumer", _times("ends"))
    return _repeated(counted)


def event_chains(published: DataFrame, consumed: DataFrame, block: int = 128) -> DataFrame:
    """``async_chains`` of the event graph of both sides, (id, event), with no table of its edges.

    How many edges end at a publisher is counted by event beforehand. Publishers and consumers of an event meet in cells of about
    ``block`` by ``block``, so that common events are dealt to many tasks, and what is shuffled is each side once for each block of
    the other.
    """
    spark = published.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pub = published.select(F.col("id").alias("producer"), "event").filter("producer is not null").distinct()
    sub = consumed.select(F.col("id").alias("consumer"), "event").filter("consumer is not null").distinct()
    sizes = pub.groupBy("event").agg(F.count("*").alias("publishers")).join(sub.groupBy("event").agg(F.count("*").alias("consumers")), "event")
    sent, heard = pub.join(sizes, "event"), sub.join(sizes, "event")
    own = pub.select(F.col("producer").alias("consumer"), "event", F.lit(1).alias("own"))  # no edge leads from a symbol to itself
    ends = heard.join(own, ["consumer", "event"], "left").groupBy(F.col("consumer").alias("producer")).agg(F.sum(F.col("publishers") - F.coalesce("own", F.lit(0))).alias("ends"))
    blocks = lambda size: F.expr(f"({size} - 1) div {int(block)} + 1")
    mine = lambda key, size: F.pmod(F.xxhash64(key), blocks(size))
    each = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), blocks(size) - 1))
    rows = sent.join(ends, "producer", "left").select("producer", "event", _times("ends"), mine("producer", "publishers").alias("row"), each("consumers").alias("column"))
    columns = heard.select("consumer", "event", mine("consumer", "consumers").alias("column"), each("publishers").alias("row"))
    cell = ["event", "row", "column"]
    met = rows.repartition(n, *cell).join(columns.repartition(n, *cell), cell).filter("producer <> consumer")
    return _repeated(met.select("producer", "event", "consumer", "times"))


def _times(ends: str) -> Column:
    return (F.coalesce(ends, F.lit(0)) + 1).alias("times")


def _repeated(df: DataFrame, most: int = 4096) -> DataFrame:
    """Each row as often as its column ``times`` says, 1 at least, and that column gone; no array is longer than ``most`` or times / most."""
    counted = df.withColumn("_whole", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {int(most)}"))))
    copies = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.col("times") - F.col("_whole") * most))))
    return copies.drop("times", "_whole", "_copy")


def api_surface(endpoints: DataFrame, edges: DataFrame, affected: DataFrame) -> DataFrame:
    """Distinct method, path and symbol of endpoints whose handlers are affected or reach what is."""
    near = can_reach(edges, affected).select(F.col("id").alias("symbol_id"))
    return endpoints.join(near, "symbol_id", "left_semi").select("method", "path", "symbol_id").distinct()


def explicit_tests(test_rels: DataFrame, affected: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """test_id, category of the tests of affected symbols; the relation's own e2e and integration come first."""
    own = test_rels.join(affected.select(F.col("id").alias("target_symbol_id")), "target_symbol_id", "left_semi")
    first = own.groupBy(F.col("test_symbol_id").alias("id")).agg(F.min("relationship_type").alias("relation"))
    named = first.join(symbols.select("id", "name", "file_id"), "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    guess = F.coalesce(K.test_category(F.col("name"), F.coalesce("path", F.lit(""))), F.lit("unit"))
    return named.select(F.col("id").alias("test_id"), F.when(F.col("relation").isin("e2e", "integration"), F.col("relation")).otherwise(guess).alias("category"))


def classified_tests(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id, category of functions and methods that look like tests."""
    joined = symbols.filter("kind in ('function', 'method')").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return joined.select("id", K.test_category(F.col("name"), F.coalesce("path", F.lit(""))).alias("category")).filter("category is not null")


def metrics(**counts: DataFrame) -> DataFrame:
    """One row of counts: the rows of each table."""
    from functools import reduce

    rows = [df.agg(F.count("*").alias(name)) for name, df in counts.items()]
    return reduce(DataFrame.crossJoin, rows)  # single rows


def named(symbols: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """id and name of the symbols whose name holds one of the words (queues, replays)."""
    return symbols.filter(K.holds(F.col("name"), words)).select("id", "name")


def workers(symbols: DataFrame) -> DataFrame:
    """id of symbols that work in the background, by their name or their decorators (text, if the table has them)."""
    held = K.holds(F.col("name"), K.WORKER)
    if "decorators" in symbols.columns:
        held = held | K.holds(F.coalesce("decorators", F.lit("")), K.WORKER)
    return symbols.filter(held).select("id")


def coverage_references(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id, reference: the name of a symbol that speaks of coverage, else its file's path in lower case if that does."""
    path = F.lower(F.coalesce("path", F.lit("")))
    joined = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    reference = F.when(K.holds(F.col("name"), K.COVERAGE), F.col("name")).when(K.holds(path, K.COVERAGE), path)
    return joined.select("id", reference.alias("reference")).filter("reference is not null")


#: The table that entry points of a kind belong to, and what stands for a missing first part.
API_TABLES = {"rest_endpoint": "rest", "graphql_resolver": "graphql", "rpc_handler": "rpc", "cli_command": "cli", "scheduled_job": "cron", "worker_entry": "workers"}


def api_tables(entries: DataFrame, near: DataFrame) -> DataFrame:
    """table, first, second, handler_id of entry points whose handlers are in ``near`` (id), each once.

    entries: kind, route, handler_id, detail (GraphQL type, schedule or worker name, null if unknown).  first and second are
    method and path, type and field, service and method; a command alone; schedule and job; a worker's name alone.
    """
    kind, route, detail = F.col("kind"), F.col("route"), F.col("detail")
    of = lambda sep: (F.substring_index(route, sep, 1), F.element_at(F.split(route, sep, 2), -1), F.contains(route, F.lit(sep)))
    (method, path, spaced), (service, call, slashed) = of(" "), of("/")
    first = (
        F.when(kind == "rest_endpoint", F.when(spaced, method).otherwise("GET"))
        .when(kind == "graphql_resolver", F.coalesce(detail, F.lit("query")))
        .when(kind == "rpc_handler", F.when(slashed, service).otherwise("default"))
        .when(kind == "scheduled_job", F.coalesce(detail, F.lit("unknown")))
        .when(kind == "worker_entry", F.coalesce(detail, route))
        .otherwise(route)
    )
    second = (
        F.when(kind == "rest_endpoint", F.when(spaced, path).otherwise(route))
        .when(kind == "graphql_resolver", F.substring_index(route, "/", -1))
        .when(kind == "rpc_handler", F.when(slashed, call).otherwise(route))
        .when(kind == "scheduled_job", route)
        .otherwise("")
    )
    table = F.create_map(*[F.lit(x) for pair in API_TABLES.items() for x in pair])
    own = entries.join(near.select(F.col("id").alias("handler_id")), "handler_id", "left_semi")
    rows = own.select(F.element_at(table, kind).alias("table"), first.alias("first"), second.alias("second"), "handler_id")
    return rows.filter("table is not null").distinct()


def composed(**models: DataFrame | None) -> dict[str, DataFrame]:
    """The models of a change by name; repository, change and behavior must be there, others may be None and are left out."""
    if missing := [name for name in ("repository", "change", "behavior") if models.get(name) is None]:
        raise ValueError(f"models are missing: {', '.join(missing)}")
    return {name: model for name, model in models.items() if model is not None}


def discovery_projection(chains: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """unit_id, symbol_id, behavior_id, place, and in which of the further models (tables with a symbol_id) the symbol occurs.

    chains: behavior_id, symbol_id, place, and a column for each model whose symbols are marked already (null: not in it).
    """
    marked = [name for name in sorted(models) if name in chains.columns]
    out = chains.select(F.concat(F.lit("unit://"), "behavior_id", F.lit("#"), "symbol_id").alias("unit_id"), "symbol_id", "behavior_id", "place", *[F.coalesce(name, F.lit(False)).alias(name) for name in marked])
    for name in sorted(set(models) - set(marked)):
        marks = models[name].select("symbol_id").distinct().withColumn(name, F.lit(True))
        out = out.join(marks, "symbol_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select("unit_id", "symbol_id", "behavior_id", "place", *sorted(models))
