"""Extraction, diffs and incremental indexing."""

from ripplegraph.sources import diff
from ripplegraph.sources.extract import extract
from ripplegraph.streaming import indexing

PYTHON = '''
import os
from lib.models import Base as B

class Order(Base):
    __tablename__ = "orders"
    total = 1

    @router.post("/orders")
    def create(self, x):
        helper(x)
        bus.publish("order_created")
        return os.getenv("KEY")

def test_create(client):
    assert client
'''
JAVA = '''
import java.util.List;
@Entity
public class Shop extends Base implements Runnable, Closeable {
  // void ignored() {}
  @GetMapping("/shop") public String show(int a) throws Exception {
    String s = "}";
    repo.find(a);
    events.publish("shown");
    return s;
  }
  @Test void checks() { assertTrue(true); }
}
'''
TYPESCRIPT = '''
import { A, B as C } from './x';
interface Shape extends Base { area(): number }
export class Box extends Thing implements Shape {
  area(): number { return compute(this.w); }
}
const double = (n: number) => { return times(n); };
app.get('/boxes', listBoxes);
enum Color { Red }
'''


def facts(spark, path, content):
    rows = extract(spark.createDataFrame([(path, content)], "path string, content string")).collect()
    return {(r["fact"], r["owner"], r["name"], r["detail"]) for r in rows}


def test_python(spark):
    found = facts(spark, "a.py", PYTHON)
    assert {("symbol", None, "Order", "class"), ("symbol", "Order", "create", "method"), ("symbol", None, "test_create", "function")} <= found
    assert {("call", "Order.create", "helper", None), ("endpoint", "Order.create", "/orders", "POST"), ("event", "Order.create", "order_created", "publish")} <= found
    assert {("config", "Order.create", "KEY", "environment"), ("model", None, "Order", "total"), ("test", None, "test_create", "1"), ("type", None, "Order", "inherits")} <= found
    assert facts(spark, "b.py", "def broken(") == set() and facts(spark, "c.txt", "x") == set() and facts(spark, "d.py", None) == set()


def test_java(spark):
    found = facts(spark, "A.java", JAVA)
    assert {("symbol", None, "Shop", "class"), ("symbol", "Shop", "show", "method"), ("endpoint", "Shop.show", "/shop", "GET"), ("call", "Shop.show", "find", None)} <= found
    assert {("type", None, "Shop", "extends"), ("type", None, "Shop", "implements"), ("event", "Shop.show", "shown", "publish"), ("test", "Shop", "checks", "1")} <= found
    assert not any(n == "ignored" for _, _, n, _ in found)


def test_typescript(spark):
    found = facts(spark, "a.ts", TYPESCRIPT)
    assert {("symbol", None, "Box", "class"), ("symbol", "Box", "area", "method"), ("symbol", None, "double", "function"), ("symbol", None, "Shape", "interface"), ("symbol", None, "Color", "enum")} <= found
    assert {("call", "Box.area", "compute", None), ("call", "double", "times", None), ("endpoint", "listBoxes", "/boxes", "GET"), ("import", None, "B", "from")} <= found


def test_diff_lines(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n@@ -9 +9,2 @@\n+e\n+f"
    lines = diff.diff_lines(spark.createDataFrame([(1, text)], "diff_id long, diff string"))
    assert sorted((r["sign"], r["line"], r["text"]) for r in lines.collect()) == [("+", 2, "c"), ("+", 9, "e"), ("+", 10, "f"), ("-", 2, "b")]
    row = diff.diff_files(lines).first()
    assert (row["file"], row["added_lines"], row["removed_lines"]) == ("x.py", [2, 9, 10], [2])


def test_batches_equal_whole_and_contents_are_read_once(spark, tmp_path):
    files = [("a.py", "def f():\n    g()\n"), ("b.py", "def g():\n    pass\n"), ("c.py", "class K:\n    pass\n")]
    schema = "path string, content string"
    cache, out = f"file://{tmp_path}/cache", f"file://{tmp_path}/facts"
    for number, batch in enumerate((files[:1], files[:2], files)):
        indexing.index_batch(spark.createDataFrame(batch, schema), cache, out, number)
        indexing.index_batch(spark.createDataFrame(batch, schema), cache, out, number)  # a batch that runs again
    rows = lambda df: sorted((r["path"], r["fact"], r["name"]) for r in df.collect())
    assert rows(spark.read.parquet(out)) == rows(extract(spark.createDataFrame(files, schema)))
