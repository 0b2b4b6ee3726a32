"""Discoveries, ranking, review and name resolution on literal rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ripplegraph import plans
from ripplegraph.operators import discovery, impact, models, operational, resolve, review


def found(spark, *rows):
    blank = dict.fromkeys(discovery.SUPPORT, 0)
    full = [{"pass_no": 0, "row_no": k, "id": f"d{k}", "kind": "k", "statement": "", "importance": 50} | blank | r for k, r in enumerate(rows)]
    schema = "pass_no int, row_no long, id string, kind string, statement string, importance long, " + ", ".join(f"{s} long" for s in discovery.SUPPORT)
    return spark.createDataFrame([tuple(r[c] for c in discovery.COLUMNS) for r in full], schema)


def test_ranking(spark):
    ranked = {r["id"]: r["importance"] for r in discovery.ranked(found(spark, {"fan_in": 1}, {"fan_in": 9}, {"fan_out": 5}, {})).collect()}
    assert ranked == {"d1": 100, "d0": 67, "d2": 33, "d3": 0}
    assert discovery.ranked(found(spark, {})).first()["importance"] == 100
    assert discovery.ranked(found(spark, {}).limit(0)).count() == 0


def test_surprise_and_compression(spark):
    rows = discovery.surprises(found(spark, {"fan_in": 10, "fan_out": 2}, {"fan_in": 9, "fan_out": 2}, {"kind": "z", "importance": 95, "fan_out": 50, "fan_in": 1}, {"kind": "k", "importance": 51}))
    assert {r["id"]: (r["importance"], r["ratio_tenths"]) for r in rows.collect()} == {"d0": (70, 50), "d1": (50, 45), "d2": (100, 500), "d3": (51, 0)}
    assert sorted(tuple(r) for r in discovery.compressed(rows).collect()) == [("k", 3, 57, "d0"), ("z", 1, 100, "d2")]


def test_behavior_pairs(spark):
    uses = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (1, 8), (2, 8), (4, 9)], "behavior_id long, symbol_id long")
    assert sorted(tuple(r) for r in discovery.behavior_pairs(uses).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_end_to_end_change(spark):
    """checkout calls process_payment, which changed; a test covers it, a route leads to it."""
    symbols = spark.createDataFrame([(1, "checkout", 1, "function"), (2, "process_payment", 2, "function"), (3, "test_process_payment", 3, "function")], "id long, name string, file_id long, kind string")
    files = spark.createDataFrame([(1, "app.py"), (2, "payment.py"), (3, "test_payment.py")], "id long, path string")
    calls = spark.createDataFrame([(1, 2)], "caller_id long, callee_id long")
    endpoints = spark.createDataFrame([(101, 1, "POST", "/checkout")], "id long, symbol_id long, method string, path string")
    tests = spark.createDataFrame([(3, 2, "unit")], "test_symbol_id long, target_symbol_id long, relationship_type string")
    none = spark.createDataFrame([], "symbol_id long, event_id long")
    seeds = spark.createDataFrame([(2,)], "id long")
    surface = impact.impact(calls, endpoints, none, none, seeds)
    assert sorted(r["id"] for r in surface.symbols.collect()) == [1, 2] and surface.endpoints.count() == 1
    edges = calls.selectExpr("caller_id AS src", "callee_id AS dst")
    assert [tuple(r) for r in operational.api_surface(endpoints, edges, seeds).collect()] == [("POST", "/checkout", 1)]
    assert [tuple(r) for r in operational.explicit_tests(tests, surface.symbols, symbols, files).collect()] == [(3, "unit")]
    assert [tuple(r) for r in models.coverage(symbols, tests).collect()] == [(3, 2, 33)]


def test_async_chains_are_a_bag(spark):
    graph = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (9, "a", 2)], "producer long, event string, consumer long")
    assert sorted(tuple(r) for r in operational.async_chains(graph).collect()) == [(1, "a", 2), (2, "b", 3), (2, "b", 3), (2, "b", 3), (9, "a", 2)]


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_chains_of_events_are_those_of_their_graph(spark, block):
    published = [(i, i % 3) for i in range(12)] + [(4, 2), (4, 2), (50, 7), (None, 0), (3, None)]
    consumed = [(i, i % 2) for i in range(3, 15)] + [(4, 2), (4, 7), (60, 8), (None, 1), (3, None), (3, 0), (3, 0)]
    graph = {(p, e, c) for p, e in published for c, f in consumed if e == f and None not in (p, e, c) and p != c}
    expected = Counter(graph) + Counter(b for a in graph for b in graph if a[2] == b[0])
    sides = [spark.createDataFrame(x, "id long, event long") for x in (published, consumed)]
    assert Counter(map(tuple, operational.event_chains(*sides, block=block).collect())) == expected
    assert Counter(map(tuple, operational.async_chains(operational.event_graph(*sides)).collect())) == expected


def test_one_event_is_dealt_to_many_tasks(spark):
    """A thousand publishers and consumers of one event: no task writes most of its chains."""
    sides = [spark.range(1000).selectExpr("id", "'a' AS event") for _ in range(2)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chains = operational.event_chains(*sides)
        plan = chains._jdf.queryExecution().executedPlan().toString()
        ids = chains.filter("producer < 4").groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Cartesian" not in plan and sum(r["count"] for r in ids) == 4 * 999 * 1000
    assert max(r["count"] for r in ids) < 0.75 * 4 * 999 * 1000


def test_copies_beyond_one_array(spark):
    rows = spark.createDataFrame([(1, 1), (2, 4), (3, 5), (4, 8), (5, 21)], "id long, times long")
    assert Counter(r["id"] for r in operational._repeated(rows, most=4).collect()) == {1: 1, 2: 4, 3: 5, 4: 8, 5: 21}


def test_edges_between_events_are_not_shuffled(spark):
    """No exchange of async_chains carries as many rows as the event graph has edges."""
    def exchanged(node):
        own = [node.metrics().apply("shuffleRecordsWritten").value()] if node.nodeName() == "Exchange" else []
        children = node.children()
        return own + [x for k in range(children.size()) for x in exchanged(children.apply(k))]

    sf = "/root/testdata/sf0.01"
    edges = plans.queries()["event_graph"](spark, sf).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chains = plans.queries()["async_chains"](spark, sf)
        assert len(chains.collect()) > 10 * edges
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    carried = exchanged(chains._jdf.queryExecution().executedPlan())
    assert 0 < max(carried) < edges / 2


def test_callee_rules(spark):
    symbols = spark.createDataFrame([(1, "A", 1, None), (2, "run", 1, 1), (3, "B", 2, None), (4, "base", 2, 3), (5, "helper", 1, None), (6, "far", 3, None), (7, "helper", 3, None)], "id long, name string, file_id long, parent_symbol_id long")
    closure = resolve.ancestors(spark.createDataFrame([(1, 3)], "source_id long, target_id long"))
    imported = spark.createDataFrame([(1, "B", 3), (1, "far", 6)], "file_id long, name string, symbol_id long")
    raw = spark.createDataFrame([(1, 1, 1, "self", "run"), (2, 1, 1, "self", "base"), (3, 1, None, "B", "base"), (4, 1, None, None, "helper"), (5, 1, None, None, "far"), (6, 9, None, None, "helper"), (7, 1, None, None, "nothing")], "call_id long, file_id long, class_id long, receiver string, name string")
    rules = {r["call_id"]: (r["callee_id"], r["rule"]) for r in resolve.resolve_callees(raw, symbols, imported, closure).collect()}
    assert rules == {1: (2, 1), 2: (4, 2), 3: (4, 3), 4: (5, 4), 5: (6, 5), 6: (5, 6), 7: (None, None)}


def test_codes_are_dense_and_in_order(spark):
    rows = spark.range(500).select((500 - F.col("id")).alias("k"), F.concat(F.lit("s"), F.col("id") % 100).alias("s"))
    codes = {r["s"]: r["code"] for r in review.dense_codes(rows, "s", ["k"]).collect()}
    first = {}
    for k in range(1, 501):
        first.setdefault(f"s{(500 - k) % 100}", len(first) + 1)
    assert codes == first


def test_references_keep_the_first_of_each_and_the_best_tiers(spark):
    rows = [(1, "symbol", "a", 2), (1, "change", "a", 1), (1, "unit", "c", 3), (1, "other", "d", 4)]
    top = review.top_references(spark.createDataFrame(rows, "group long, kind string, ref_id string, seq long"), 2)
    assert sorted((r["place"], r["kind"], r["ref_id"]) for r in top.collect()) == [(1, "change", "a"), (2, "unit", "c")]
