"""Searches on small graphs, against plain Python."""

from collections import deque

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ripplegraph.operators import behavior, graph, impact, operational


def plain_bfs(edges, seeds, max_depth):
    depth, queue = {s: 0 for s in seeds}, deque(seeds)
    while queue:
        x = queue.popleft()
        if max_depth is not None and depth[x] >= max_depth:
            continue
        for a, b in edges:
            if a == x and b not in depth:
                depth[b] = depth[x] + 1
                queue.append(b)
    return depth


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def seeds_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20), st.sampled_from([None, 1, 3]), st.sampled_from([0, 100]))
def test_bfs_against_plain(spark, rows, max_depth, small):
    found = graph.bfs(edges_of(spark, rows), seeds_of(spark, 0, 3), max_depth, small=small)
    assert {r["id"]: r["depth"] for r in found.collect()} == plain_bfs(rows, [0, 3], max_depth)


def test_keyed_searches_are_apart_and_equal_in_both_ways(spark):
    rows = [(i, (i * 7 + 3) % 50) for i in range(50)] + [(i, (i * 11 + 1) % 50) for i in range(0, 50, 3)]
    seeds = spark.createDataFrame([("a", 0), ("b", 5), ("b", 99), ("c", 99)], "k string, id long")
    expected = {(k, i, d) for k, s in (("a", [0]), ("b", [5, 99]), ("c", [99])) for i, d in plain_bfs(rows, s, None).items()}
    for small in (0, 1000):
        found = graph.bfs(edges_of(spark, rows), seeds, None, keys=("k",), small=small)
        assert {(r["k"], r["id"], r["depth"]) for r in found.collect()} == expected
        assert found.count() == len(expected)


def test_text_ids(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    for small in (0, 10):
        assert {r["id"]: r["depth"] for r in graph.bfs(edges, spark.createDataFrame([("a",), ("z",)], "id string"), None, small=small).collect()} == {"a": 0, "b": 1, "c": 2, "z": 0}


def test_the_plan_does_not_grow_with_the_depth(spark):
    size = lambda n: len(graph.bfs(edges_of(spark, [(i, i + 1) for i in range(n)]), seeds_of(spark, 0), None, small=0)._jdf.queryExecution().optimizedPlan().toString())
    assert size(12) <= size(3) + 50


def test_cap_keeps_the_first_by_depth_and_id(spark):
    found = graph.bfs(edges_of(spark, [(0, 5), (0, 4), (0, 3), (3, 9)]), seeds_of(spark, 0), None, cap=3)
    assert sorted(r["id"] for r in found.collect()) == [0, 3, 4]


def test_nulls_and_empty(spark):
    assert graph.bfs(edges_of(spark, [(None, 1), (1, None)]), seeds_of(spark, 1, None), 5).count() == 1
    assert graph.bfs(edges_of(spark, [(1, 2)]), seeds_of(spark).limit(0), 5).count() == 0


def test_duality(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 2)]
    forward = {(a, r["id"]) for a in (1, 2, 3, 4) for r in operational.reachable(edges_of(spark, rows), seeds_of(spark, a)).collect()}
    backward = {(r["id"], b) for b in (1, 2, 3, 4) for r in operational.can_reach(edges_of(spark, rows), seeds_of(spark, b)).collect() if r["id"] != b}
    assert forward == {(a, b) for a, b in backward if a != b}


def test_impact_chain(spark):
    calls = spark.createDataFrame([(1, 2), (2, 3)], "caller_id long, callee_id long")
    endpoints = spark.createDataFrame([(1, "GET", "/a")], "symbol_id long, method string, path string")
    pubs = spark.createDataFrame([(3, 7)], "symbol_id long, event_id long")
    db = spark.createDataFrame([(1, 5)], "symbol_id long, resource_id long")
    s = impact.impact(calls, endpoints, db, pubs, seeds_of(spark, 2))
    assert sorted(r["id"] for r in s.symbols.collect()) == [1, 2, 3]
    assert s.endpoints.count() == 1 and s.event_pubs.count() == 1 and s.db_rels.count() == 0


def test_terminal_points_of_a_cycle_are_the_last(spark):
    nodes = behavior.graph_nodes(edges_of(spark, [(1, 2), (2, 1)]), seeds_of(spark, 1))
    edges = behavior.graph_edges(nodes, edges_of(spark, [(1, 2), (2, 1)]))
    assert [tuple(r) for r in behavior.terminal_points(nodes, edges).collect()] == [(1, 2)]


def test_climb_ends_at_cycles(spark):
    symbols = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2), (4, "x", 5), (5, "y", 4)], "id long, name string, parent_symbol_id long")
    names = {r["id"]: r["names"] for r in graph.climb(symbols).collect()}
    assert names[3] == ["a", "b", "c"] and names[4] == ["y", "x"]
