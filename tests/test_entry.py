"""The entry point: the flagship query, and that it stands without the optional subpackage."""

import importlib
import sys

import pytest

import __spark_entry__ as entry_point

SAMPLE = ("callers", "resolved_symbols", "fan_in_out", "string_table", "content_scan", "symbol_category", "diff_lines", "changed_symbols")


def test_flagship(spark):
    assert entry_point.entry(spark).columns == ["id", "method", "path", "symbol_id"]


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "part supplier lineitem events documents labels pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = entry_point.queries()[name](spark, "/root/testdata/sf0.001")
    con.execute(entry_point.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [d[0] for d in con.description]
    expected = [tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in con.fetchall()]
    assert sorted(map(str, expected)) == sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))


def test_stands_without_the_optional_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("ripplegraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        alone = importlib.reload(entry_point)
        assert not any(n.startswith("op") and n[2].isdigit() for n in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry_point)
