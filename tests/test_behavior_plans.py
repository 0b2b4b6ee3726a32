"""Execution graphs and enclosing behaviours of the queries, on a chain of more than 15 calls."""

from types import SimpleNamespace

from ripplegraph.operators import discovery
from ripplegraph.plans import behavior as plans


def chain(spark, length):
    """0 calls 1, 1 calls 2, ...; 0 is the entry point, the last but two is changed."""
    return SimpleNamespace(
        spark=spark,
        edges=spark.createDataFrame([(i, i + 1) for i in range(length)], "src long, dst long"),
        entries=spark.createDataFrame([(0,)], "symbol_id long"),
        changed=spark.createDataFrame([(length - 2,)], "id long"),
    )


def test_graphs_are_not_cut_at_15_calls(spark):
    nodes = plans._nodes(chain(spark, 20))
    assert sorted(tuple(r) for r in nodes.collect()) == [(0, i, i, i) for i in range(21)]


def test_enclosing_is_not_cut_at_15_calls(spark):
    assert [tuple(r) for r in plans._enclosing(chain(spark, 20)).collect()] == [(18, 0)]


def test_reachable_units_are_not_cut_at_15_calls(spark):
    f = chain(spark, 20)
    f.changed = spark.createDataFrame([(1,)], "id long")
    from ripplegraph.plans.core import QUERIES

    run = QUERIES["reachable_units"].__closure__[0].cell_contents
    assert sorted(r["symbol_id"] for r in run(f).collect()) == list(range(1, 21))


def test_discovery_inputs_come_from_the_tables(spark):
    f = chain(spark, 4)
    f.test_rels = spark.createDataFrame([(9, 1, "unit"), (9, 2, "e2e"), (8, 2, "e2e"), (8, 3, "integration")], "test_symbol_id long, target_symbol_id long, relationship_type string")
    f.endpoints = f.entries
    f.symbol_services = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(5)], "id long, service string")
    assert plans._tests(f).first().asDict() == {"unit": 1, "integration": 1, "e2e": 2}
    assert plans._counts(f).first().asDict() == {"changed": 1, "apis": 0, "cross_service": 1, "depth": 2}
    nodes = plans._nodes(f)
    assert plans._model_counts(f, nodes).first().asDict() == {"behaviors": 1, "services": 2}
    assert [r["id"] for r in discovery.boundaries(plans._counts(f)).collect()] == ["boundary-invariant://interface"]
    assert discovery.validation_gaps(plans._chains(nodes), spark.createDataFrame([(1, 5)], "id long, fan_out long"), plans._tests(f)).count() == 0
    longest = discovery.longest_chain(nodes).first()
    assert (longest["id"], longest["execution_reach"], longest["propagation_depth"]) == ("dominant-execution://depth/0", 5, 4)


def test_fan_in_is_that_of_the_discovery_s_symbol(spark):
    rows = [("shared-execution://7", 0), ("dominant-execution://fan-out/8", 0), ("dominant-execution://fan-in/7", 5), ("boundary-invariant://depth", 0)]
    values = [(0, k, i, "k", "", 1, n, 0, 0, 0, 0, 0, 0) for k, (i, n) in enumerate(rows)]
    found = spark.createDataFrame(values, ", ".join(f"{c} {'string' if c in ('id', 'kind', 'statement') else 'long'}" for c in discovery.COLUMNS))
    fans = spark.createDataFrame([(7, 4), (8, 2)], "id long, fan_in long")
    assert {r["id"]: r["fan_in"] for r in discovery.own_fan_in(found, fans).collect()} == dict(zip([i for i, _ in rows], [4, 2, 5, 0], strict=True))
