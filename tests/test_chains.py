"""Chains of many roots: in tasks and by levels, against plain searches; and what their queries write on the way."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ripplegraph import scratch
from ripplegraph.operators import behavior, context, graph
from tests.test_graph import edges_of, plain_bfs, seeds_of

SF = "/root/testdata/sf0.001"
ROWS = [(i, (i * 7 + 3) % 50) for i in range(50)] + [(i, (i * 11 + 1) % 50) for i in range(0, 50, 3)]


def plain_chain(rows, root):
    return sorted(plain_bfs(rows, [root], None).items(), key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("small", [0, 1000])
def test_nodes_carry_what_roots_and_symbols_have(spark, small):
    roots = spark.createDataFrame([(0, "a"), (0, "b"), (9, None), (99, "c")], "id long, entry string")
    attributes = spark.createDataFrame([(i, f"s{i}") for i in range(0, 50, 2)] + [(99, "s99")], "id long, name string")
    found = behavior.graph_nodes(edges_of(spark, ROWS), roots, attributes=attributes, small=small).collect()
    expected = [(r, i, d, p, e, f"s{i}" if i % 2 == 0 or i == 99 else None) for r, e in ((0, "a"), (0, "b"), (9, None), (99, "c")) for p, (i, d) in enumerate(plain_chain(ROWS, r))]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("small", [0, 1000])
def test_folds_of_chains(spark, small):
    edges, roots, changed = edges_of(spark, ROWS), seeds_of(spark, 0, 9, 99), seeds_of(spark, 4, 9, 31)
    chains = {r: plain_chain(ROWS, r) for r in (0, 9, 99)}
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    ends = [(r, len(c), c[-1][1], c[-1][0], next((i for i, _ in reversed(c) if i in (4, 9, 31)), None)) for r, c in chains.items()]
    assert rows(behavior.chain_ends(edges, roots, changed, small)) == sorted(ends, key=str)
    assert rows(behavior.users(edges, roots, small)) == sorted(((i, sum(i in dict(c) for c in chains.values())) for i in {i for c in chains.values() for i, _ in c}), key=str)
    assert rows(behavior.edges_of_graphs(edges, roots, small)) == sorted(((r, a, b) for r, c in chains.items() for a, b in ROWS if a in dict(c)), key=str)
    assert rows(behavior.adjacent_steps(edges, roots, small)) == sorted({(a, b) for c in chains.values() for (a, _), (b, _) in zip(c, c[1:], strict=False)}, key=str)
    kept = [(r, i, p) for r, c in chains.items() for p, (i, _) in enumerate(c) if len(c) < 4 or p in (0, len(c) - 1) or i in (4, 9, 31)]
    assert rows(behavior.compressed_nodes(edges, roots, changed, 4, small)) == sorted(kept, key=str)
    capped = [(r, i, p) for r, c in chains.items() for p, (i, _) in enumerate(c) if i in (4, 9, 31) or sum(x not in (4, 9, 31) for x, _ in c[: p + 1]) <= 3]
    assert rows(behavior.capped_nodes(edges, roots, changed, 3, small)) == sorted(capped, key=str)
    leaves = {(r, i % 3) for r, c in chains.items() for i, _ in c if i not in {a for a, _ in ROWS}}
    assert rows(behavior.leaf_kinds(edges, roots, 3, small)) == sorted(leaves, key=str)


@pytest.mark.parametrize("small", [0, 1000])
def test_transitions_skip_steps_without_a_service(spark, small):
    edges = edges_of(spark, [(1, 2), (2, 3), (3, 4), (4, 5)])
    services = spark.createDataFrame([(1, "x"), (3, "y"), (4, "y"), (5, None)], "id long, service string")
    assert [tuple(r) for r in behavior.transitions(edges, seeds_of(spark, 1, 3), services, small).collect()] == [("x", "y", 1)]


@pytest.mark.parametrize("small", [0, 10])
def test_text_ids_and_no_edges(spark, small):
    edges, roots = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), spark.createDataFrame([("a",), ("z",)], "id string")
    assert sorted(map(tuple, behavior.graph_nodes(edges, roots, small=small).collect())) == [("a", "a", 0, 0), ("a", "b", 1, 1), ("a", "c", 2, 2), ("z", "z", 0, 0)]
    assert sorted(map(tuple, behavior.graph_nodes(edges.limit(0), roots, small=small).collect())) == [("a", "a", 0, 0), ("z", "z", 0, 0)]
    assert np.isin([r["n"] for r in behavior.users(edges, roots, small).collect()], 1).all()


@pytest.mark.parametrize("name", [
    "deep_execution",
    "execution_graph_edges",
    "discovery_significance",
    "context_steps",
    "discovery_summary",
    "discoveries_depth",
    "discoveries_hidden",
    "discoveries_reach",
    "discoveries_validation_gap",
    "discovery_facts",
    "discoveries_shared",
    "discovery_compression",
    "discovery_ranking",
    "discovery_surprise",
    "execution_dag_edges",
    "boundary_transitions",
    "execution_chain_units",
    "capped_steps",
    "compressed_chain",
    "discovery_projection",
    "context_entries",
    "context_deepest",
    "context_compressed",
])
def test_no_table_of_all_steps_on_the_way(spark, name, monkeypatch):
    """Neither written nor dealt out by a window; what is dealt out has been counted, filtered or folded before."""
    written, put = [], scratch.Tables.put
    monkeypatch.setattr(scratch.Tables, "put", lambda self, df, table: written.append(table) or put(self, df, table))
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not {"nodes", "found"} & set(written) or name.startswith("discovery_") and "nodes" not in written
    assert "Window [row_number() windowspecdefinition(behavior_id" not in plan


@pytest.mark.parametrize("held", [1, 100, graph.HELD])
def test_chains_come_from_64_roots_at_once(monkeypatch, held):
    """Each chain is that of a search of its own, and what the roots reach is cut out once for all of them."""
    monkeypatch.setattr(graph, "HELD", held)
    rows, cut, levels = [(i, j) for i, j in ROWS if i < 40], [], graph.Adjacency.levels
    monkeypatch.setattr(graph.Adjacency, "levels", lambda self, *a: cut.append(a) or levels(self, *a))
    own = graph.Adjacency(pd.Series([a for a, _ in rows]), pd.Series([b for _, b in rows]))
    roots = np.array([*range(49, -1, -1), 77, *range(50)])
    codes, names = own.places(roots), own.names.to_numpy()
    found = {int(k): list(zip(names[at].tolist(), depth.tolist(), strict=True)) for k, at, depth in graph._searched(own, codes, None, np.zeros(len(names), bool))}
    assert found == {k: plain_chain(rows, r) for k, r in enumerate(roots.tolist()) if codes[k] >= 0}
    assert len(cut) == 1


def test_tasks_give_each_pair_of_neighbours_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(behavior, "chains", lambda *a: made.append(graph.chains(*a)) or made[-1])
    line = [(i, i + 1) for i in range(300)]
    found = behavior.adjacent_steps(edges_of(spark, line), seeds_of(spark, *range(300)))
    assert sorted(map(tuple, found.collect())) == line
    assert made[0].count() <= len(line) * made[0].rdd.getNumPartitions() < 300 * 301 / 2
    assert made[0].groupBy(F.spark_partition_id(), "src", "dst").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("name", ["context_compressed", "context_steps"])
def test_steps_leave_the_tasks_as_they_are_written(spark, name):
    """One search in the plan, what it takes from symbols written beforehand, and no projection of its rows afterwards."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert plan.startswith("MapInArrow")


@pytest.mark.parametrize("held", [1, 100, graph.HELD])
@pytest.mark.parametrize("batch", [64, graph.BATCH])
def test_whole_chains_come_node_by_node(monkeypatch, held, batch):
    """What repeats for the roots that reach a node stands together, so that files of it are small; a bag of edges stays one."""
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr(graph, "BATCH", batch)
    rows = [(i, j) for i, j in ROWS if i < 40] + [(0, 3), (5, 38)]
    own, roots = graph.Adjacency(pd.Series([a for a, _ in rows]), pd.Series([b for _, b in rows])), np.array([*range(50), 77, 0])
    carried = pa.table({"entry": np.arange(len(roots))})
    part = graph.Part(own, roots, None, pa.table({}), np.zeros(len(own.names), bool))
    parts = list(graph.Spread(part, roots, part.start, carried).parts())
    steps = [(int(s.roots[r]), s.carried.column("entry")[int(r)].as_py(), int(part.ids[n]), int(d), int(p)) for s in parts for one in s.by_node() for n, r, d, p in zip(*one, strict=True)]
    assert sorted(steps) == sorted((r, e, i, d, p) for e, r in enumerate(roots.tolist()) for p, (i, d) in enumerate(plain_chain(rows, r)))
    bag = [(int(s.roots[r]), int(part.ids[a]), int(part.ids[b])) for s in [graph.Spread(part, roots, part.start)] for one in s.edges() for a, b, r in zip(*one, strict=True)]
    assert sorted(bag) == sorted((r, a, b) for r in roots.tolist() for a, b in rows if a in dict(plain_chain(rows, r)))
    runs = lambda found: sum(a != b for a, b in zip(found, found[1:], strict=False)) + 1
    assert runs([x[1:] for x in bag]) <= len(rows)
    assert runs([x[2] for x in steps]) <= len(parts) * len(part.ids)


def test_steps_carry_what_their_entries_have(spark):
    """Two entries of one root, an entry without edges, and null attributes, node by node as root by root."""
    edges = edges_of(spark, [(1, 2), (2, 3), (3, 1), (2, 9)])
    entries = spark.createDataFrame([(1, "e1", "rest", "b1"), (1, "e2", "", "b1"), (3, "e3", None, "b3"), (77, "e4", "", "b77")], "id long, entry_id string, service string, module string")
    attributes = spark.createDataFrame([(1, "one", "method", "f:1-2", True, None), (9, None, None, None, None, True), (77, "lone", None, None, True, False)], "id long, name string, kind string, location string, changed boolean, shared boolean")
    rows = lambda small: sorted(map(tuple, context.steps_of(edges, entries, attributes, small=small).collect()))
    assert rows(1000) == rows(0)
    assert [r for r in rows(1000) if r[0] in ("e2", "e4")] == [
        ("e2", 0, "1", "1", "one", "method", "f:1-2", 0, True, False, "", "b1"), ("e2", 1, "1", "2", "2", "", "", 1, False, False, "", "b1"),
        ("e2", 2, "1", "3", "3", "", "", 2, False, False, "", "b1"), ("e2", 3, "1", "9", "9", "", "", 3, False, True, "", "b1"),
        ("e4", 0, "77", "77", "lone", "", "", 0, True, False, "", "b77"),
    ]


def test_nodes_of_a_task_come_node_by_node(spark):
    """Roots of a task that reach the same symbols have each of them in one run of rows."""
    line = [(i, i + 1) for i in range(600)]
    found = behavior.graph_nodes(edges_of(spark, line), seeds_of(spark, *range(600)))
    rows = found.withColumn("task", F.spark_partition_id()).toPandas()
    assert len(rows) == 600 * 603 // 2 and (rows["place"] == rows["depth"]).all() and (rows["symbol_id"] == rows["behavior_id"] + rows["depth"]).all()
    runs = (rows[["task", "symbol_id"]].diff() != 0).any(axis=1).sum()
    assert runs < len(rows) / 4


def test_steps_of_a_task_come_node_by_node(spark):
    """As nodes do: entries of a task that reach the same symbols have each of them in one run of rows."""
    line, n = [(i, i + 1) for i in range(200)], 200
    entries = spark.range(n).selectExpr("id", "'e' || id AS entry_id", "'' AS service", "'m' AS module")
    attributes = spark.createDataFrame([(5, "five", "method", "f:1-2", True, True)], "id long, name string, kind string, location string, changed boolean, shared boolean")
    rows = context.steps_of(edges_of(spark, line), entries, attributes).select(F.spark_partition_id().alias("task"), F.col("symbol_id").cast("long").alias("symbol")).toPandas()
    assert len(rows) == n * (n + 3) // 2
    assert (rows.diff() != 0).any(axis=1).sum() < len(rows) / 4
