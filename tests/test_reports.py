import zipfile

from ripplegraph.operators import planner, resolver
from ripplegraph.sources import reports, snapshot


def test_comments(spark, tmp_path):
    table = reports.Comments(spark, f"file://{tmp_path}/comments")
    rows = lambda *r: spark.createDataFrame(list(r), "repository string, number long, marker string, body string")
    table.publish(rows(("r", 1, "m", "a"), ("r", 2, "m", "b")))
    table.publish(rows(("r", 1, "m", "c")))
    assert sorted((r["number"], r["body"], r["revision"]) for r in table.rows().collect()) == [(1, "c", 2), (2, "b", 1)]
    table.delete(rows(("r", 2, "m", "")))
    assert [r["number"] for r in table.rows().collect()] == [1]


def test_registry():
    r = reports.Registry()
    r.register("reader", "zip", 1)
    assert r.get("reader", "zip") == 1 and r.names("reader") == ["zip"]
    try:
        r.register("reader", "zip", 2)
    except ValueError:
        return
    raise AssertionError


def test_snapshots(spark, tmp_path):
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "src/a/x.py").write_text("hello\n")
    (tmp_path / "src/bad.bin").write_bytes(b"\xff\xfe")
    files = snapshot.read_folder(spark, f"file://{tmp_path}/src")
    assert [(r["path"], r["content"]) for r in files.collect()] == [("a/x.py", "hello\n")]
    assert snapshot.tree_of(files).first()["blob_sha"] == "ce013625030ba8dba906f756967f9e9ca394464a"
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("root-abc/a.py", "x = 1")
        z.writestr("root-abc/b.bin", b"\xff\xfe")
    assert [(r["path"], r["content"]) for r in snapshot.read_zips(spark, f"file://{tmp_path}/r.zip").collect()] == [("a.py", "x = 1")]


def tree(spark):
    return spark.createDataFrame([(f"f{k}.py", "blob", 10, f"calls g{k + 1}") for k in range(6)], "path string, type string, size long, text string")


def run(spark, budget, **options):
    status = spark.createDataFrame([("f0.py", "indexed")], "path string, indexed_status string")
    log = []

    def index(paths):
        got = sorted(r["path"] for r in paths.collect())
        log.append(got)
        return [("symbol", f"g{int(p[1]) + 2}") for p in got]

    done, out = resolver.resolve(tree(spark), status, [("symbol", "g2")], index, budget, **options)
    return sorted(r["path"] for r in done.collect()), out, log


def test_frontier_follows_what_it_finds(spark):
    done, out, log = run(spark, planner.Budget())
    assert log == [["f1.py"], ["f2.py"], ["f3.py"], ["f4.py"], ["f5.py"]] and out.complete and out.rounds == 6 and len(done) == 6


def test_budgets(spark):
    done, out, _ = run(spark, planner.Budget(files=2), fall_back=False)
    assert out.exceeded == "files" and out.files == 2 and not out.complete and len(done) == 3
    done, out, _ = run(spark, planner.Budget(depth=1), fall_back=False)
    assert out.exceeded == "depth" and len(done) == 2
    done, out, _ = run(spark, planner.Budget(bytes=15))
    assert out.exceeded == "bytes" and out.fallback and out.complete and len(done) == 6
