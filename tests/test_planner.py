"""Candidate files for every kind of requirement."""

import pytest

from ripplegraph.operators import planner


def found(spark, *requirements):
    texts = {"a.py": "import util", "b.py": "@app.get('/')", "c.py": "bus.subscribe(f)", "d.py": "emit(42)", "e.py": "pass", "util.py": "x = 1", "i.py": "import util @app. 42"}
    tree = spark.createDataFrame([(p, "blob", 1, t) for p, t in texts.items()], "path string, type string, size long, text string")
    status = spark.createDataFrame([("i.py", "indexed")], "path string, indexed_status string")
    return sorted(tuple(r) for r in planner.candidates(list(requirements), tree, status).collect())


def test_importers_events_and_entry_points(spark):
    assert found(spark, ("importers", "lib/util.py")) == [("importers", "lib/util.py", "a.py")]
    assert found(spark, ("event", "42")) == [("event", "42", "c.py"), ("event", "42", "d.py")]
    assert found(spark, ("entry_points", ""), ("file", "e.py")) == [("entry_points", "", "b.py"), ("file", "e.py", "e.py")]


def test_unknown_kinds_are_refused(spark):
    with pytest.raises(ValueError, match="nonsense"):
        found(spark, ("nonsense", "x"))
