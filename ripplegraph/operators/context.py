"""The review context: execution steps by entry point, assembled discoveries, and their pruning.

Steps have the columns entry_id, place, behavior, symbol_id, name, kind, location, depth, changed, shared, service, module.
Entries have entry_id, endpoint, method, path, terminal, max_depth.  All ids are strings here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..functions import keywords as K
from ..scratch import Tables
from .graph import SMALL, Chain, Spread, chains
from .review import NOISE, tier

STEP = ("entry_id", "place", "behavior", "symbol_id", "name", "kind", "location", "depth", "changed", "shared", "service", "module")
ENTRY = ("entry_id", "endpoint", "method", "path", "terminal", "max_depth")

#: What stands for the method of an entry point whose route names none.
KIND_METHODS = {"rest_endpoint": "POST", "graphql_resolver": "POST", "rpc_handler": "RPC", "cli_command": "CLI", "scheduled_job": "SCHEDULE", "worker_entry": "WORKER", "event_consumer": "EVENT"}
#: Limits of references and evidence of a discovery, and of symbols without entry points.
MOST_REFERENCES, MOST_EVIDENCE, MOST_FALLBACK = 10, 8, 5
#: The facts of an assembled discovery.
FACTS = ("execution_reach", "fan_in", "fan_out", "propagation_depth", "boundary_crossings", "external_surface", "data_surface", "event_surface", "validation_coverage", "validation_gaps", "shared_by_count", "cross_service_count", "changed_symbol_count", "changed_file_count")


def entry_method(route: Column, kind: Column) -> Column:
    """The first word of a route of several; else what stands for the kind, or the kind itself."""
    table = F.create_map(*[F.lit(x) for pair in KIND_METHODS.items() for x in pair])
    return F.when(F.contains(route, F.lit(" ")), F.substring_index(route, " ", 1)).otherwise(F.coalesce(F.element_at(table, F.lower(kind)), kind))


def last_name(id_: Column) -> Column:
    """What follows the last :: and the last #."""
    return F.substring_index(F.substring_index(id_, "::", -1), "#", -1)


def behavior_steps(entries: DataFrame, units: DataFrame, symbols: DataFrame, changed: DataFrame, shared: DataFrame, behaviors: DataFrame) -> DataFrame:
    """A step for each unit of each entry point's behaviour.

    entries: entry_id, behavior_id; units: behavior_id, symbol_id, place; symbols: id, name, kind, path, start_line,
    end_line; changed and shared: id; behaviors: behavior_id, kind, name.
    """
    flag = lambda rows, name: rows.select(F.col("id").cast("string").alias("symbol_id"), F.lit(True).alias(name)).distinct()
    own = units.select("behavior_id", F.col("symbol_id").cast("string").alias("symbol_id"), "place")
    known = symbols.select(F.col("id").cast("string").alias("symbol_id"), "name", "kind", F.format_string("%s:%d-%d", "path", "start_line", "end_line").alias("location"))
    rows = entries.select(F.col("entry_id").cast("string").alias("entry_id"), "behavior_id").join(own, "behavior_id").join(known, "symbol_id", "left")
    rows = rows.join(flag(changed, "changed"), "symbol_id", "left").join(flag(shared, "shared"), "symbol_id", "left")
    rows = rows.join(behaviors.select("behavior_id", F.col("kind").alias("service"), F.col("name").alias("module")), "behavior_id", "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "entry_id", "place", F.col("behavior_id").cast("string").alias("behavior"), "symbol_id", F.coalesce("name", "symbol_id").alias("name"), empty(F.col("kind")).alias("kind"), empty(F.col("location")).alias("location"),
        F.col("place").alias("depth"), F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("shared", F.lit(False)).alias("shared"), empty(F.col("service")).alias("service"), empty(F.col("module")).alias("module"),
    )


def symbol_attributes(symbols: DataFrame, marked: DataFrame) -> DataFrame:
    """What steps take from their symbol: id, name, kind, location, changed, shared.

    symbols: id, name, kind, path, start_line, end_line; marked: id, changed, shared.
    """
    known = symbols.select("id", "name", "kind", F.format_string("%s:%d-%d", "path", "start_line", "end_line").alias("location"))
    return known.join(marked, "id", "full")


def steps_of(edges: DataFrame, entries: DataFrame, attributes: DataFrame, least: int | None = None, small: int = SMALL // 2) -> DataFrame:
    """The steps of each entry point's chain, found and filled in one pass; as ``behavior_steps`` gives them.

    entries: id (the behaviour's root), entry_id, service, module; attributes as ``symbol_attributes`` gives them. With ``least``,
    the chains are compressed as by ``compressed_steps``. Tasks hold the attributes of all nodes, so ``small`` is lower here.
    """

    tables, symbol = Tables(edges.sparkSession, "steps"), F.col("id").cast("string")
    empty = lambda name: F.coalesce(name, F.lit("")).alias(name)
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).union(entries.select("id")).filter("id is not null").distinct()
    known = ids.join(attributes, "id", "left").select("id", symbol.alias("symbol_id"), F.coalesce("name", symbol).alias("name"), empty("kind"), empty("location"), flag("changed"), flag("shared"))
    roots = entries.distinct().select("id", "entry_id", symbol.alias("behavior"), empty("service"), empty("module"))
    schema = StructType([StructField(c, {"place": LongType(), "depth": LongType(), "changed": BooleanType(), "shared": BooleanType()}.get(c, StringType())) for c in STEP])

    def visit(found: Iterator[Chain]) -> Iterator[list]:
        for c in found:
            own = dict(zip(("entry_id", "behavior", "service", "module"), c.carried, strict=True))
            n, place = len(c.ids), np.arange(len(c.ids))
            if least is not None and n >= least and not own["service"]:
                stay = c.flag("changed")
                stay[[0, -1]] = True
                place = np.flatnonzero(stay)
            held = {k: pa.repeat(pa.scalar(v, pa.string()), len(place)) for k, v in own.items()} | {"place": place, "depth": place}
            yield [held[k] if k in held else c.column(k, place) for k in STEP]

    def together(found: Iterator[Spread]) -> Iterator[list]:
        for s in (few for s in found for few in s.parts()):
            for nodes, root, _, place in s.by_node():
                rows, owner = pa.array(nodes), pa.array(root)
                held = {k: s.carried.column(k).take(owner) for k in s.carried.column_names} | {"place": place, "depth": place}
                yield [held[k] if k in held else s.part.attribute(k, rows) for k in STEP]

    return chains(edges, roots, visit, schema, tables.put(known, "known"), None, small, together if least is None else None)


def behavior_entries(entries: DataFrame, steps: DataFrame, terminals: DataFrame | None = None) -> DataFrame:
    """An execution for each entry point (entry_id, behavior_id, route, kind); terminals: behavior_id, kind, one is taken.

    Without terminals, which cost a search of their own, there is no column of them.
    """
    depth = steps.groupBy("entry_id").agg(F.max("depth").alias("max_depth"))
    endpoint = F.when(F.length("route") > 0, F.col("route")).otherwise(F.col("kind"))
    own = entries.select(F.col("entry_id").cast("string").alias("entry_id"), "behavior_id", "route", "kind")
    joined, terminal = own.join(depth, "entry_id", "left"), []
    if terminals is not None:
        joined = joined.join(terminals.groupBy("behavior_id").agg(F.max("kind").alias("terminal")), "behavior_id", "left")
        terminal = [F.coalesce("terminal", F.lit("")).alias("terminal")]
    return joined.select("entry_id", endpoint.alias("endpoint"), entry_method(F.col("route"), F.col("kind")).alias("method"), F.col("route").alias("path"), *terminal, F.coalesce("max_depth", F.lit(0)).cast("long").alias("max_depth"))


def surface_context(endpoints: DataFrame, affected: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, steps) of an impact surface: one step for each affected endpoint (id, route, handler_id, kind).

    Where no endpoint is affected, the first five changed symbols among the affected ones, by id as text, stand in.
    """
    text = lambda rows: rows.select(F.col("id").cast("string").alias("id")).distinct()
    route, kind, handler = F.coalesce("route", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce(F.col("handler_id").cast("string"), F.lit(""))
    two = F.contains(route, F.lit(" "))
    path = F.when(two, F.element_at(F.split(route, " ", 2), -1)).otherwise(route)
    own = endpoints.select(F.col("id").cast("string").alias("entry_id"), handler.alias("symbol_id"), kind.alias("kind"), F.when(two, F.substring_index(route, " ", 1)).otherwise(kind).alias("method"), path.alias("path"))
    own = own.join(text(changed).select(F.col("id").alias("symbol_id"), F.lit(True).alias("changed")), "symbol_id", "left")
    own = own.select("entry_id", "symbol_id", "kind", "method", "path", F.coalesce("changed", F.lit(False)).alias("changed"))
    inside = text(affected).join(text(changed), "id").orderBy("id").limit(MOST_FALLBACK)
    none = endpoints.agg(F.count("*").alias("n")).filter("n = 0")
    instead = inside.crossJoin(none).select(F.col("id").alias("entry_id"), F.col("id").alias("symbol_id"), F.lit("function").alias("kind"), F.lit("").alias("method"), last_name(F.col("id")).alias("path"), F.lit(True).alias("changed"))  # five rows by one
    service = F.lit("")
    rows = own.withColumn("service", F.col("kind")).unionByName(instead.withColumn("service", service))
    entries = rows.select("entry_id", F.col("path").alias("endpoint"), "method", "path", F.lit("").alias("terminal"), F.lit(0).cast("long").alias("max_depth"))
    steps = rows.select(
        "entry_id", F.lit(0).cast("long").alias("place"), F.col("symbol_id").alias("behavior"), "symbol_id", last_name(F.col("symbol_id")).alias("name"), "kind", F.lit("").alias("location"),
        F.lit(0).cast("long").alias("depth"), "changed", F.lit(False).alias("shared"), "service", F.lit("").alias("module"),
    )
    return entries, steps


def deepest(entries: DataFrame) -> DataFrame:
    """entry_point, depth: the entry of largest depth above 0, the first by id of equals; no row if there is none."""
    return entries.filter("max_depth > 0").orderBy(F.desc("max_depth"), "entry_id").limit(1).select(F.col("endpoint").alias("entry_point"), F.col("max_depth").alias("depth"))


def pruned_steps(steps: DataFrame) -> DataFrame:
    """Steps that are changed or of no noise category; metadata in the category's path counts as no path."""
    file = F.regexp_replace("location", ":[0-9]+(-[0-9]+)?$", "")
    return steps.filter(F.col("changed") | ~K.symbol_category(F.col("name"), file, F.col("kind")).isin(*NOISE)).select(*STEP)


def compressed_steps(steps: DataFrame, least: int = 4) -> DataFrame:
    """Chains of ``least`` steps or more keep their first, last, changed and boundary steps (those that name a service)."""
    chain = Window.partitionBy("entry_id")
    marked = steps.withColumns({"n": F.count("*").over(chain), "last": F.max("place").over(chain), "first": F.min("place").over(chain)})
    return marked.filter((F.col("n") < least) | (F.col("place") == F.col("first")) | (F.col("place") == F.col("last")) | F.col("changed") | (F.col("service") != "")).select(*STEP)


def change_files(changes: DataFrame, files: DataFrame) -> DataFrame:
    """path, change_type and the changes of each file, sorted by id, as structs; changes: id, change, name, kind, file_id."""
    own = changes.groupBy("file_id").agg(F.count_distinct("change").alias("kinds"), F.lower(F.min("change")).alias("one"), F.array_sort(F.collect_list(F.struct("id", F.lower("change").alias("change"), "name", "kind"))).alias("changes"))
    return own.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", F.when(F.col("kinds") > 1, "mixed").otherwise(F.col("one")).alias("change_type"), "changes")


def evidence_references(evidence: DataFrame) -> DataFrame:
    """discovery_id, place, ref_id, kind, location, reference_count: the references of each discovery that represent it.

    evidence: discovery_id, seq, source_id, source, evidence_ref.  Of equal ids the first counts; the best by tier, then id.
    """
    total = Window.partitionBy("discovery_id")
    rows = evidence.withColumn("reference_count", F.count("*").over(total)).filter(F.length("source_id") > 0)
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("discovery_id", "source_id").orderBy("seq"))).filter("n = 1")
    place = F.row_number().over(total.orderBy(tier(F.lower("source")), "source_id"))
    return first.withColumn("place", place.cast("long")).filter(F.col("place") <= MOST_REFERENCES).select("discovery_id", "place", F.col("source_id").alias("ref_id"), F.col("source").alias("kind"), F.col("evidence_ref").alias("location"), "reference_count")


def pruned_references(references: DataFrame) -> DataFrame:
    """References without compiler metadata, the first eight of each discovery; equal ones share a canonical number.

    references: discovery_id, place, ref_id, kind, location.
    """
    clean = references.filter(~(K.is_compiler_metadata(F.col("ref_id")) | K.is_compiler_metadata(F.col("location")) | K.is_compiler_metadata(F.col("kind"))))
    place = F.row_number().over(Window.partitionBy("discovery_id").orderBy("place"))
    same = F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in ("ref_id", "kind", "location")]))
    return clean.withColumn("place", place.cast("long")).filter(F.col("place") <= MOST_EVIDENCE).select("discovery_id", "place", "ref_id", "kind", "location", same.alias("canonical"))


def assembled_facts(discoveries: DataFrame) -> DataFrame:
    """id, fact, value: the facts of each discovery, those it has no column for as 0, without names that are metadata."""
    known = set(discoveries.columns)
    pairs = F.array(*[F.struct(F.lit(f).alias("fact"), (F.col(f) if f in known else F.lit(0)).cast("long").alias("value")) for f in FACTS])
    return discoveries.select("id", F.inline(pairs)).filter(~K.is_compiler_metadata(F.col("fact")))


def artifacts(entries: DataFrame, steps: DataFrame, references: DataFrame) -> DataFrame:
    """kind, id of everything a context names: symbols, behaviours, endpoints and references."""
    of = lambda rows, kind, column: rows.select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("id"))
    parts = [of(steps, "symbol", "symbol_id"), of(steps, "behavior", "behavior"), of(entries, "endpoint", "endpoint"), of(references, "reference", "ref_id")]
    return reduce(DataFrame.unionByName, parts).filter(F.length("id") > 0).distinct()


def document_rows(**sections: DataFrame) -> DataFrame:
    """section, json: the whole context as rows of JSON objects, one for each row of each section."""
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("json")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, rows)
