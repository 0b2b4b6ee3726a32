"""Version inheritance, the layered view and the fact store, on literal fixtures."""

import datetime

from ripplegraph.operators import change, versions
from ripplegraph.sources.store import FactStore

FILES = "id long, path string, language string, state string"
SYMBOLS = "id long, name string, file_id long, kind string, language string, start_line int, end_line int, visibility string, parent_symbol_id long"


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def store_with_two_versions(spark, path):
    store = FactStore(spark, f"file://{path}")
    store.write("files", "r", "base", spark.createDataFrame([(1, "a.py", "python", "active"), (2, "b.py", "python", "active")], FILES))
    store.write("symbols", "r", "base", spark.createDataFrame([(10, "funcA", 1, "function", "python", 1, 5, "public", None), (20, "funcB", 2, "function", "python", 1, 5, "public", None)], SYMBOLS))
    store.write("calls", "r", "base", spark.createDataFrame([(2, 20, 10, "direct")], "file_id long, caller_id long, callee_id long, call_type string"))
    store.write("files", "r", "head", spark.createDataFrame([(2, "b.py", "python", "active")], FILES))
    store.write("symbols", "r", "head", spark.createDataFrame([(20, "funcB_modified", 2, "function", "python", 1, 10, "public", None)], SYMBOLS))
    store.write("calls", "r", "head", spark.createDataFrame([], "file_id long, caller_id long, callee_id long, call_type string"))
    return store


def test_inheritance(spark, tmp_path):
    store = store_with_two_versions(spark, tmp_path)
    symbols = {r["id"]: r["name"] for r in store.resolved("symbols", "r", "head", "base").collect()}
    assert symbols == {10: "funcA", 20: "funcB_modified"}
    assert store.resolved("calls", "r", "base", None).count() == 1


def test_rewritten_file_loses_its_calls(spark, tmp_path):
    store = store_with_two_versions(spark, tmp_path)
    store.write("calls", "r", "head", spark.createDataFrame([(2, 20, 99, "direct")], "file_id long, caller_id long, callee_id long, call_type string"))
    assert [(r["caller_id"], r["callee_id"]) for r in store.resolved("calls", "r", "head", "base").collect()] == [(20, 99)]


def test_tombstone(spark, tmp_path):
    store = store_with_two_versions(spark, tmp_path)
    store.write("files", "r", "head", spark.createDataFrame([(1, "a.py", "python", "deleted")], FILES))
    store.write("symbols", "r", "head", spark.createDataFrame([], SYMBOLS))
    assert ids(store.resolved("files", "r", "head", "base")) == [2]
    assert ids(store.resolved("symbols", "r", "head", "base")) == [20]


def test_delete_file_and_status(spark, tmp_path):
    store = store_with_two_versions(spark, tmp_path)
    store.delete_file("r", "base", 2)
    assert ids(store.read("symbols", "r", "base")) == [10]
    assert store.read("calls", "r", "base").count() == 0
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = "path string, blob_sha string, indexed_status string, indexed_at timestamp"
    store.upsert_status("r", "base", spark.createDataFrame([("a", "s", "pending", day(1)), ("b", "s", "failed", day(1))], rows))
    store.upsert_status("r", "base", spark.createDataFrame([("a", "s", "indexed", day(2))], rows))
    assert {r["path"]: r["indexed_status"] for r in store.read("materialization", "r", "base").collect()} == {"a": "indexed", "b": "failed"}


def test_overlay_drops_edges_of_touched_files_and_lost_targets(spark):
    symbols = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, file_id long")
    touched = spark.createDataFrame([(2,)], "id long")
    overlay = versions.Overlay(touched, spark.createDataFrame([(21, 2)], "id long, file_id long"))
    view = versions.symbols_view(symbols, overlay)
    assert ids(view) == [10, 21, 30]
    edge = "src long, dst long, file_id long"
    base = spark.createDataFrame([(20, 10, 2), (30, 10, 3), (30, 20, 3)], edge)
    merged = versions.edges_view(base, spark.createDataFrame([(21, 30, 2)], edge), overlay, view)
    assert sorted(tuple(r) for r in merged.collect()) == [(21, 30, 2), (30, 10, 3)]


def test_empty_overlay_is_the_base(spark):
    symbols = spark.createDataFrame([(10, 1), (20, 2)], "id long, file_id long")
    overlay = versions.Overlay(spark.createDataFrame([], "id long"), symbols.limit(0))
    assert ids(versions.symbols_view(symbols, overlay)) == [10, 20]


def test_change_kinds(spark):
    row = "id long, start_line int, end_line int, visibility string, body_hash long, kind string, file_id long"
    base = spark.createDataFrame([(1, 1, 5, "public", 1, "function", 1), (2, 1, 5, "public", 1, "function", 1), (3, 1, 5, "public", 1, "function", 2), (4, 1, 5, "public", 1, "class", 9)], row)
    head = spark.createDataFrame([(1, 1, 6, "private", 1, "function", 1), (2, 1, 5, "public", 2, "function", 1), (3, 1, 5, "public", 1, "function", 2), (5, 1, 5, "public", 1, "class", 9)], row)
    found = change.changed_symbols(base, head)
    assert {r["id"]: r["change"] for r in found.collect()} == {1: "MODIFIED", 2: "MODIFIED", 4: "REMOVED", 5: "ADDED"}
    assert {r["id"] for r in change.changed_symbols(base, head, strict=True).collect()} == {1, 4, 5}
    assert sorted((r["id"], r["contract"]) for r in change.contract_changes(found).collect()) == [(1, "body"), (1, "visibility")]
    assert [tuple(r) for r in change.renames(found).collect()] == [(4, 5)]


def test_repoint_unresolved(spark):
    edges = spark.createDataFrame([(1, None, "f"), (1, 7, "f"), (2, None, "nobody")], "src long, dst long, callee_name string")
    symbols = spark.createDataFrame([(7, "f"), (9, "f")], "id long, name string")
    assert [tuple(r) for r in versions.repoint_unresolved(edges, symbols).collect()] == [(1, 7)]


def test_versions_are_registered_once(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}")
    assert store.register("r", "a") == store.register("r", "a") == "r@a"
    store.register("r", "b", "a")
    assert sorted((r["id"], r["parent_version_id"]) for r in store.versions().collect()) == [("r@a", None), ("r@b", "r@a")]


def broken(spark, schema):
    """Rows whose job fails."""
    from pyspark.sql import functions as F

    return spark.createDataFrame([(1, "a.py", "python", "active")], FILES).withColumn("id", F.raise_error(F.lit("broken")).cast("long"))


def test_a_failed_write_leaves_the_version_as_it_was(spark, tmp_path):
    store = store_with_two_versions(spark, tmp_path)
    try:
        store.write("files", "r", "base", broken(spark, FILES))
    except Exception as e:
        assert "broken" in str(e)
    else:
        raise AssertionError
    assert ids(store.read("files", "r", "base")) == [1, 2]


def test_a_transaction_counts_as_a_whole(spark, tmp_path):
    store = store_with_two_versions(spark, tmp_path)
    rows = spark.createDataFrame([(7, "z.py", "python", "active")], FILES)
    try:
        with store.transaction("r", "base") as t:
            t.write("files", rows)
            t.delete_file(2)
            assert ids(t.read("files")) == [7]
            raise KeyError("stop")
    except KeyError:
        pass
    assert ids(store.read("files", "r", "base")) == [1, 2] and store.read("calls", "r", "base").count() == 1
    with store.transaction("r", "base") as t:
        t.replace_file(2, {"symbols": spark.createDataFrame([(21, "new", 2)], "id long, name string, file_id long"), "calls": spark.createDataFrame([], "file_id long, caller_id long, callee_id long, call_type string")})
        t.record_tree(spark.createDataFrame([("a.py", "blob", "s", 3)], "path string, type string, blob_sha string, size long"), complete=False)
        t.set_flag("indexed_complete")
    assert ids(store.read("symbols", "r", "base")) == [10, 21] and store.read("calls", "r", "base").count() == 0
    assert store.flag("indexed_complete", "r", "base") and not store.flag("tree_complete", "r", "base") and store.next_id("symbols", "r", "base") == 22


def test_of_two_writers_from_one_state_the_second_fails(spark, tmp_path):
    import pytest

    from ripplegraph.sources.commits import Conflict

    store = store_with_two_versions(spark, tmp_path)
    row = lambda i: spark.createDataFrame([(i, "x.py", "python", "active")], FILES)
    first, second = store.transaction("r", "base"), store.transaction("r", "base")
    a, b = first.__enter__(), second.__enter__()
    a.write("files", row(1))
    b.write("files", row(2))
    first.__exit__(None, None, None)
    with pytest.raises(Conflict):
        second.__exit__(None, None, None)
    assert ids(store.read("files", "r", "base")) == [1]


def test_a_version_must_be_there(spark, tmp_path):
    import pytest

    store = store_with_two_versions(spark, tmp_path)
    with pytest.raises(LookupError):
        store.read("files", "r", "other")
    assert store.read("refs", "r", "base").count() == 0


def test_inconsistent_facts_abort(spark):
    import pytest

    calls, symbols = spark.createDataFrame([(1, 2)], "caller_id long, callee_id long"), spark.createDataFrame([(1,)], "id long")
    with pytest.raises(change.Inconsistent, match="unknown symbol 2"):
        change.require_consistent(change.referential_errors(calls, "callee_id", symbols, "unknown symbol %d"))
    change.require_consistent(change.referential_errors(calls, "caller_id", symbols, "unknown symbol %d"))


def test_scope_and_classification(spark):
    files = lambda n: spark.createDataFrame([(k, "added", 1) for k in range(n)], "file_id long, change_type string, symbols long")
    kinds = lambda *c: spark.createDataFrame([(x,) for x in c], "change string")
    of = lambda n, *c: change.change_summary(files(n), files(0), kinds(*c)).select("scope", "classification").first()
    assert [tuple(of(n, "ADDED")) for n in (0, 1, 2, 5, 6)] == [("local", "addition"), ("local", "addition"), ("multi_file", "addition"), ("multi_file", "addition"), ("wide", "addition")]
    assert [of(1, *c)[1] for c in (("ADDED", "REMOVED"), ("ADDED", "MODIFIED"), ("REMOVED", "MODIFIED"), ("MODIFIED",))] == ["mixed", "modification", "removal", "modification"]
