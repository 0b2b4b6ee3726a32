import hashlib
import hmac
import zlib

from pyspark.sql import functions as F

from ripplegraph.functions import keywords as K
from ripplegraph.functions import names as N
from ripplegraph.streaming.webhooks import hmac_sha256


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_names(spark):
    fqn = N.symbol_fqn(F.col("l"), F.col("p"), F.col("n"), F.col("k"), F.col("o"))
    row = {"l": "python", "p": "svc/a.py", "n": "f", "k": "method", "o": "C"}
    assert one(spark, fqn, **row) == "python://svc/a.py#C.f"
    assert one(spark, fqn, **(row | {"o": ""})) == "python://svc/a.py::f"
    for function, expected in ((N.name_of, "f"), (N.parent_of, "C"), (N.file_of, "svc/a.py"), (N.service_of, "svc")):
        assert one(spark, function(F.col("x")), x="python://svc/a.py#C.f") == expected
    assert one(spark, N.display_name(F.col("x")), x="java://a#B::save_x2y") == "Save X2Y"
    assert one(spark, N.table_name(F.col("x")), x="OrderItem") == "order_items"
    assert one(spark, N.module_of(F.col("x")), x="a/b.test.py") == "a.b.test"
    assert one(spark, N.adler32(F.col("x")), x="GET /é:f") == zlib.adler32("GET /é:f".encode())
    assert [one(spark, c, x="a.py:3-9") for c in N.location(F.col("x"))] == ["a.py", 3, 9]
    assert one(spark, N.route_method(F.col("x")), x="FETCH /a") == "ANY" and one(spark, N.route_method(F.col("x")), x="/a") == "GET"


def test_keywords(spark):
    assert one(spark, K.events_in(F.col("x"), K.PUBLISH), x="publish_order_emit") == ["order_emit", "publish_order_emit"]
    assert one(spark, K.test_category(F.col("n"), F.col("p")), n="run", p="tests/bench_a.py") == "benchmark"
    assert one(spark, K.test_category(F.col("n"), F.col("p")), n="run", p="src/a.py") is None
    for name, path, kind, expected in (("x", "Dockerfile", "class", "Build"), ("Order", "src/a.py", "class", "Domain Model"), ("json.loads", "src/a.py", "function", "Standard Library"), ("pay", "src/a.py", "function", "Business Logic")):
        assert one(spark, K.symbol_category(F.col("n"), F.col("p"), F.col("k")), n=name, p=path, k=kind) == expected


def test_hmac(spark):
    for key in ("k", "long" * 40):
        assert one(spark, hmac_sha256(key, F.col("x")), x="body") == hmac.new(key.encode(), b"body", hashlib.sha256).hexdigest()
