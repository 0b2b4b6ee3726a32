"""Discoveries: rows of one schema from several rules, ranked, boosted and compressed.

Every discovery has pass_no and row_no, which give the order of the list, and a support of seven numbers.
Importances are in hundredths as integers until the end, so that no rounding depends on the engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .review import numbered

SUPPORT = ("fan_in", "fan_out", "execution_reach", "propagation_depth", "behaviors", "services", "validation")
COLUMNS = ("pass_no", "row_no", "id", "kind", "statement", "importance", *SUPPORT)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, "s").otherwise(""))


def _rows(df: DataFrame, pass_no: int, row_no: Column, id_: Column, kind: str, statement: Column, importance: Column, **support: Column) -> DataFrame:
    own = [support.get(s, F.lit(0)).cast("long").alias(s) for s in SUPPORT]
    return df.select(F.lit(pass_no).alias("pass_no"), row_no.cast("long").alias("row_no"), id_.alias("id"), F.lit(kind).alias("kind"), statement.alias("statement"), importance.cast("long").alias("importance"), *own)


def top_fans(fans: DataFrame, names: DataFrame, k: int = 3, least: int = 2) -> DataFrame:
    """The k largest fan-ins and fan-outs of at least ``least``; fans: id, fan_in, fan_out; names: id, name."""
    out = []
    for pass_no, (column, label, verb, noun) in enumerate((("fan_in", "fan-in", "is referenced by", "upstream caller"), ("fan_out", "fan-out", "calls", "downstream callee"))):
        # the k largest of all first, by (count, id)
        best = fans.orderBy(F.desc(column), "id").limit(k).filter(F.col(column) >= least).join(names, "id")
        place = F.row_number().over(Window.orderBy(F.desc(column), "id"))  # k rows
        n = F.col(column)
        out.append(_rows(best.withColumn("place", place), 2 + pass_no, F.col("place"), F.concat(F.lit(f"dominant-execution://{label}/"), "id"), column, F.concat("name", F.lit(f" {verb} "), plural(n, noun), F.lit(".")), F.least(30 + 5 * n, F.lit(95)), **{column: n}))
    return out[0].unionByName(out[1])


def _ends(nodes: DataFrame) -> DataFrame:
    """One row for each chain with its length n: what behavior.chain_ends gives, or counted from a row for each step."""
    return nodes if "n" in nodes.columns else nodes.groupBy("behavior_id").agg(F.count("*").alias("n"))


def largest_reach(units: DataFrame) -> DataFrame:
    """The behaviour with most reachable units (behavior_id, or the ends of chains), the smallest id of equals."""
    n = _ends(units).orderBy(F.desc("n"), "behavior_id").limit(1)
    return _rows(n, 4, F.lit(1), F.concat(F.lit("dominant-execution://reach/"), "behavior_id"), "dominant_execution", F.concat(F.lit("behavior "), "behavior_id", F.lit(" reaches "), plural(F.col("n"), "execution unit"), F.lit(".")), F.least(40 + 2 * F.col("n"), F.lit(95)), execution_reach=F.col("n"))


def longest_chain(nodes: DataFrame) -> DataFrame:
    """The behaviour with most units, the smallest id of equals, where any graph is deeper than its root."""
    deepest = nodes.agg(F.max("depth").alias("depth")).filter("depth > 0")
    n = _ends(nodes).select("behavior_id", "n").orderBy(F.desc("n"), "behavior_id").limit(1).crossJoin(deepest)  # single rows
    statement = F.concat(F.lit("The deepest execution path spans "), plural(F.col("n"), "call"), F.lit(" (behavior "), "behavior_id", F.lit(")."))
    return _rows(n, 4, F.lit(2), F.concat(F.lit("dominant-execution://depth/"), "behavior_id"), "execution_depth", statement, F.lit(60), execution_reach=F.col("n"), propagation_depth=F.col("depth"))


def several_routes(entries: DataFrame) -> DataFrame:
    """Behaviours with two routes or more; entries: behavior_id, route. Five routes are named."""
    grouped = entries.groupBy("behavior_id").agg(F.array_sort(F.collect_list("route")).alias("routes"))
    n = F.size("routes")
    more = F.when(n > 5, F.concat(F.lit(" and "), (n - 5).cast("string"), F.lit(" more"))).otherwise("")
    statement = F.concat(F.lit("behavior "), "behavior_id", F.lit(" is reachable from "), plural(n, "endpoint"), F.lit(": "), F.array_join(F.slice("routes", 1, 5), ", "), more, F.lit("."))
    return _rows(grouped.filter(n >= 2), 0, F.col("behavior_id"), F.concat(F.lit("hidden-relationship://reachable/"), "behavior_id"), "hidden_relationship", statement, F.least(50 + 10 * n, F.lit(95)), execution_reach=n)


def indirect_changes(nodes: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Chains of two units or more whose deepest changed unit is not the root.

    nodes: behavior_id, symbol_id, place, with changed (id); or the ends of chains: behavior_id, n, last, deepest.
    """
    if changed is None:
        return _indirect(nodes)
    length = nodes.groupBy("behavior_id").agg(F.count("*").alias("n"), F.max_by("symbol_id", "place").alias("last"))
    deepest = nodes.join(changed.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").groupBy("behavior_id").agg(F.max_by("symbol_id", "place").alias("deepest"))
    return _indirect(length.join(deepest, "behavior_id"))


def _indirect(ends: DataFrame) -> DataFrame:
    rows = ends.filter("n >= 2 and deepest <> behavior_id")
    statement = F.concat(F.lit("symbol "), "deepest", F.lit(" is reached indirectly ("), plural(F.col("n"), "execution unit"), F.lit(" from entry to terminal at "), "last", F.lit(")."))
    return _rows(rows, 1, F.col("behavior_id"), F.concat(F.lit("hidden-relationship://indirect/"), "behavior_id"), "hidden_relationship", statement, F.lit(70), execution_reach=F.col("n"), propagation_depth=F.col("n"))


def shared(executions: DataFrame) -> DataFrame:
    """Symbols used by two behaviours or more; executions: symbol_id, and used_by or its size n."""
    n = F.col("n") if "n" in executions.columns else F.size("used_by")
    statement = F.concat(F.lit("symbol "), "symbol_id", F.lit(" is shared by "), plural(n, "behavior"), F.lit("."))
    return _rows(executions.filter(n >= 2), 7, F.col("symbol_id"), F.concat(F.lit("shared-execution://"), "symbol_id"), "shared_execution", statement, F.least(40 + 10 * n, F.lit(95)), behaviors=n)


def boundaries(counts: DataFrame) -> DataFrame:
    """From one row (changed, apis, cross_service, depth): no public interface, no service crossed, depth inside one."""
    rule = lambda no, when, name, statement, importance: _rows(counts.filter(when), 5, F.lit(no), F.lit(f"boundary-invariant://{name}"), "boundary_invariant", statement, F.lit(importance))
    rules = [
        rule(1, "changed > 0 and apis = 0", "interface", F.concat(plural(F.col("changed"), "changed symbol"), F.lit(" without public interface.")), 85),
        rule(2, "cross_service = 0", "service", F.lit("No service boundary is crossed."), 70),
        rule(3, "depth > 0 and cross_service = 0", "depth", F.concat(F.lit("Propagation stays inside one service at depth "), "depth", F.lit(".")), 60),
    ]
    return reduce(DataFrame.unionByName, rules)


def validation_gaps(chains: DataFrame, fans: DataFrame, tests: DataFrame, k: int = 3, least: int = 3) -> DataFrame:
    """Long chains without e2e tests, large fan-outs without integration tests, no tests at all.

    chains: behavior_id, n; fans: id, fan_out; tests: one row of unit, integration, e2e.
    """
    long_ = chains.filter("n >= 3").crossJoin(tests).filter("e2e = 0")  # tests is one row
    wide = fans.orderBy(F.desc("fan_out"), "id").limit(k).filter(F.col("fan_out") >= least).crossJoin(tests).filter("integration = 0")
    none = tests.filter("unit + integration + e2e = 0")
    return (
        _rows(long_, 6, F.col("behavior_id"), F.concat(F.lit("validation-gap://chain/"), "behavior_id"), "validation_gap", F.concat(F.lit("No end-to-end test covers the "), plural(F.col("n"), "unit"), F.lit(" of behavior "), "behavior_id", F.lit(".")), F.lit(75), execution_reach=F.col("n"))
        .unionByName(_rows(wide, 6, F.col("id") + 1_000_000_000, F.concat(F.lit("validation-gap://fan-out/"), "id"), "validation_gap", F.concat(F.lit("No integration test covers symbol "), "id", F.lit(" with "), plural(F.col("fan_out"), "callee"), F.lit(".")), F.least(40 + 10 * F.col("fan_out"), F.lit(90)), fan_out=F.col("fan_out")))
        .unionByName(_rows(none, 6, F.lit(2_000_000_000), F.lit("validation-gap://none"), "validation_gap", F.lit("No test covers the change."), F.lit(90)))
    )


def own_fan_in(discoveries: DataFrame, fans: DataFrame) -> DataFrame:
    """A fan_in of zero is filled from the symbol that the discovery is about, if it is about one; fans: id, fan_in."""
    symbol = F.regexp_extract("id", "(?:/fan-in/|/fan-out/|^shared-execution://)([0-9]+)$", 1)
    own = fans.select(F.col("id").cast("string").alias("symbol"), F.col("fan_in").alias("own"))
    joined = discoveries.withColumn("symbol", symbol).join(own, "symbol", "left")
    return joined.withColumn("fan_in", F.when(F.col("fan_in") != 0, F.col("fan_in")).otherwise(F.coalesce("own", F.lit(0))).cast("long")).select(*COLUMNS)


def fill_support(discoveries: DataFrame, counts: DataFrame) -> DataFrame:
    """Zeros of the support are filled from the one row of model counts that has columns of those names."""
    own = [c for c in SUPPORT if c in counts.columns]
    joined = discoveries.crossJoin(counts.select(*[F.col(c).alias(f"model_{c}") for c in own]))  # counts is one row
    return joined.withColumns({c: F.when(F.col(c) != 0, F.col(c)).otherwise(F.col(f"model_{c}")) for c in own}).select(*COLUMNS)


def ranked(discoveries: DataFrame) -> DataFrame:
    """Importance by the place in the order of the support, the largest first: 1 - i / (n - 1) in hundredths, half up."""
    order = [F.desc(c) for c in SUPPORT] + [F.col("pass_no"), F.col("row_no"), F.col("id")]
    i, n = F.col("i"), F.col("n")
    # 100 - 100 i / (n - 1), half up: floor((200 (n - 1 - i) + (n - 1)) / (2 (n - 1)))
    value = F.when(n == 1, 100).otherwise(F.expr("(200 * (n - 1 - i) + (n - 1)) div (2 * (n - 1))"))
    places = numbered(discoveries.select(*COLUMNS), order, "i").withColumn("i", F.col("i") - 1)
    places = places.crossJoin(discoveries.agg(F.count("*").alias("n")))  # one row
    return places.withColumn("importance", value.cast("long")).select(*COLUMNS)


def surprises(discoveries: DataFrame, least: int = 5, boost: int = 20) -> DataFrame:
    """Adds ratio_tenths, the largest of the ratios of the support (tenths, half up), and a boost where it is large."""
    tenths = lambda a, b: F.when(F.col(b) == 0, 0).otherwise(F.floor((F.col(a) * 20 + F.col(b)) / (F.col(b) * 2)))
    ratio = F.greatest(tenths("fan_in", "fan_out"), tenths("fan_out", "fan_in"), tenths("execution_reach", "behaviors"), tenths("propagation_depth", "services"), tenths("execution_reach", "validation"))
    out = discoveries.withColumn("ratio_tenths", ratio.cast("long"))
    return out.withColumn("importance", F.when(F.col("ratio_tenths") >= 10 * least, F.least(F.col("importance") + boost, F.lit(100))).otherwise(F.col("importance")))


def compressed(discoveries: DataFrame, least: int = 3) -> DataFrame:
    """Kinds with ``least`` discoveries or more become one: count, mean importance (half up), id of the strongest.

    Others pass; kind, members, importance, lead.
    """
    grouped = discoveries.groupBy("kind").agg(F.count("*").alias("n"), F.sum("importance").alias("s"), F.max_by("id", F.struct("importance", F.col("pass_no") * -1, F.col("row_no") * -1)).alias("lead"))
    many = grouped.filter(F.col("n") >= least).select("kind", F.col("n").alias("members"), F.expr("(2 * s + n) div (2 * n)").alias("importance"), "lead")
    few = discoveries.join(grouped.filter(F.col("n") < least).select("kind"), "kind", "left_semi")
    return many.unionByName(few.select("kind", F.lit(1).cast("long").alias("members"), "importance", F.col("id").alias("lead")))


def histogram(discoveries: DataFrame) -> DataFrame:
    return discoveries.groupBy("kind").agg(F.count("*").alias("n"), F.max("importance").alias("max_importance"))


def behavior_pairs(executions: DataFrame) -> DataFrame:
    """Distinct pairs of behaviours that share a symbol; executions: behavior_id, symbol_id.

    Symbols with the same behaviours give the same pairs, so each set of behaviours is taken apart once.
    """
    sets = executions.groupBy("symbol_id").agg(F.array_sort(F.collect_set("behavior_id")).alias("own")).select("own").distinct()
    left = sets.select("own", F.posexplode("own").alias("at", "left"))
    return left.select("left", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("right")).distinct()


def deep_executions(chains: DataFrame) -> DataFrame:
    """Chains (behavior_id, n) of at least 7/10 of the longest, rounded down, and of one."""
    top = chains.agg(F.max("n").alias("top"))
    return chains.crossJoin(top).filter("n >= greatest(1, top * 7 div 10)").select("behavior_id", "n")


def boundary_transitions(nodes: DataFrame) -> DataFrame:
    """from_service, to_service, transitions along chains; nodes: behavior_id, place, service (null services are skipped)."""
    order = Window.partitionBy("behavior_id").orderBy("place")
    steps = nodes.filter("service is not null").withColumn("before", F.lag("service").over(order)).filter("before <> service")
    return steps.groupBy(F.col("before").alias("from_service"), F.col("service").alias("to_service")).agg(F.count("*").alias("transitions"))


def untested(symbols: DataFrame, test_rels: DataFrame) -> DataFrame:
    return symbols.select("id").join(test_rels.select(F.col("target_symbol_id").alias("id")), "id", "left_anti")
