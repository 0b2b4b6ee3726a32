import numpy as np
from pyspark.sql import functions as F

from ripplegraph.llm import quality

from .conftest import prose


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus():
    return [(i, prose(i, 40) if i % 3 else "BUY!! $$$ NOW!! " * (5 + i % 7)) for i in range(300)]


def test_held_out_accuracy_and_filter(make, spark):
    docs, own = make(corpus()), labels(spark, [(i, int(i % 3 > 0), 0) for i in range(300)])
    model = quality.train(docs, own, lambda d: ~quality.held_out(d))
    scored = quality.score(docs, model).withColumn("h", quality.held_out(F.col("doc_id"))).toPandas()
    held = scored[scored["h"]]
    assert len(held) > 50 and ((held["score"] >= 0.5) == (held["doc_id"] % 3 > 0)).mean() > 0.95
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == (scored["score"] >= 0.5).sum()


def test_odd_rows(make, spark, odd_rows):
    docs = make(odd_rows)
    for own in ([], [(5, 1, 0), (4, None, 0), (None, 0, 0)], [(5, 1, 0), (5, 0, 0), (4, 1, 1), (2, 0, 0), (3, 1, 0)]):
        scores = quality.score(docs, quality.train(docs, labels(spark, own), lambda d: F.lit(True))).toPandas()["score"]
        assert len(scores) == len(odd_rows) and scores.between(0, 1).all()
    assert quality.score(docs.limit(0), quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).count() == 0


def test_trees_traverse_as_they_were_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y)
    slow = []
    for row in x[:50]:
        m = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            m += leaf[k - len(f)]
        slow.append(m)
    assert np.allclose(model.margin(x[:50]), slow) and ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_splits_against_brute_force():
    """One tree of two levels: each split has the largest gain of all features and thresholds, each leaf its Newton step."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 9, size=(200, 4)).astype(float)
    y = ((x[:, 2] > 4) & (x[:, 0] > 2) | (rng.random(200) < 0.1)).astype(float)
    model = quality.fit(x, y, trees=1, depth=2, rate=1.0)
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    g, h = w * (0.5 - y), w * 0.25

    def gain(rows, j, t):
        left, right = rows & (x[:, j] <= t), rows & (x[:, j] > t)
        if h[left].sum() < 1 or h[right].sum() < 1:
            return -1.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(right) - part(rows)

    node = np.zeros(200, int)
    for k in range(3):
        rows = node == k
        best = max(gain(rows, j, t + 0.5) for j in range(4) for t in range(8))
        if best <= 0:  # no split is worth it: all go left
            assert model.threshold[0, k] == np.inf
        else:
            assert abs(gain(rows, model.feature[0, k], model.threshold[0, k]) - best) < 1e-9
        node[rows] = 2 * k + 1 + (x[rows, model.feature[0, k]] > model.threshold[0, k])
    for leaf in range(4):
        rows = node == leaf + 3
        assert abs(model.leaf[0, leaf] + g[rows].sum() / (h[rows].sum() + 1)) < 1e-9


def test_edges_of_many_values_are_even():
    values = np.random.default_rng(1).normal(size=10_000)
    edges = quality._edges(values, 64)
    assert len(edges) <= 63 and (np.diff(edges) > 0).all()
    assert np.histogram(values, np.r_[-np.inf, edges, np.inf])[0].max() < 2 * 10_000 / 64


def test_statistics_of_a_known_text():
    own = dict(zip(quality.FEATURES, quality.statistics("Ab ab 12!\nab #\n"), strict=True))
    want = {"log_chars": np.log1p(15), "log_words": np.log1p(5), "bytes_per_word": 10 / 5, "upper": 1 / 15, "digit": 2 / 15, "ascii_punct": 1 / 15, "symbol": 1 / 15, "non_ascii": 0, "space": 5 / 15, "bang": 1 / 15, "bar": 0, "line_bytes": np.log1p(15 / 2), "distinct_words": 4 / 5, "top_word": 2 / 5, "distinct_lines": 1, "distinct_pairs": 1, "word_end_punct": 1 / 4, "longest_word": np.log1p(3), "short_words": 1, "caps_words": 0, "symbol_words": 1 / 4}
    assert all(abs(own[k] - v) < 1e-12 for k, v in want.items())


def test_ids_that_repeat_count_once(make, spark):
    rows = corpus() + [(0, prose(9000 + k, 30)) for k in range(500)]
    own = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(300)])
    a, b = (quality.train(make(r), own, lambda d: F.lit(True), max_rows=300) for r in (rows, rows[::-1]))
    assert len(a.feature) and (a.threshold == b.threshold).all() and (a.leaf == b.leaf).all()
