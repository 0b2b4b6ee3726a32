import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplegraph.llm import decontaminate as D
from ripplegraph.llm.common import WordHashes

from .conftest import prose


def plain_tiles(text, item, least):
    """Greedy tiling, straight from its definition."""
    used_t, used_i, tiles = set(), set(), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in used_t and j + n not in used_i:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return tiles
        n, i, j = best
        tiles.append((i, j, n))
        used_t.update(range(i, i + n))
        used_i.update(range(j, j + n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(1, 3))
def test_tiles_against_plain(text, item, least):
    t, i = np.array(text, np.uint64), np.array(item, np.uint64)
    tiles = D.tile(t, i, least)
    for a, b, n in tiles:
        assert n >= least and (t[a : a + n] == i[b : b + n]).all()
    assert len({x for a, _, n in tiles for x in range(a, a + n)}) == len({x for _, b, n in tiles for x in range(b, b + n)}) == sum(n for _, _, n in tiles)
    assert not D._matches(t, i, ~np.isin(np.arange(len(t)), [x for a, _, n in tiles for x in range(a, a + n)]), ~np.isin(np.arange(len(i)), [x for _, b, n in tiles for x in range(b, b + n)]), least)
    # of equal matches the first by place in the item, then in the text, counts on either side
    assert tiles == plain_tiles(text, item, least)


def test_rolling_hashes_are_those_of_the_windows():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for n in (1, 5, 299, 300, 301):
        want = [sum(int(w) * D._BASE**k for k, w in enumerate(words[i : i + n])) % 2**64 for i in range(max(0, len(words) - n + 1))]
        assert D.rolling(words, n).tolist() == want


def test_matches_are_whole_against_plain_tiling(make, spark):
    """Every reported pair with its tiles and coverage, over documents with shuffled, doubled and cut items."""
    import random

    r = random.Random(5)
    bench_rows = [(k, prose(300 + k, n)) for k, n in enumerate((3, 5, 12, 25, 40))]
    rows = []
    for d in range(40):
        words = prose(500 + d, 30).split()
        for _ in range(r.randrange(3)):
            own = r.choice(bench_rows)[1].split()
            cut = r.randrange(len(own))
            words[10:10] = r.choice([own, own[cut:] + own[:cut], own[cut:], own + own, own[:cut] + ["new"] + own[cut:]])
        rows.append((d, " ".join(words)))
    want = set()
    for d, t in rows:
        for k, item in bench_rows:
            a, b = t.lower().split(), item.lower().split()
            tiles = plain_tiles(a, b, min(5, len(b)))
            if (covered := sum(n for *_, n in tiles)) >= 0.75 * len(b):
                want.add((d, k, covered, len(b)))
    for block_words in (2_000_000, 20):
        got = D.matches(make(rows), items(spark, bench_rows), block_words=block_words).collect()
        assert {(x["doc_id"], x["item_id"], x["covered"], x["item_words"]) for x in got} == want and len(got) == len(want)
    assert len(want) > 15


def test_a_very_long_item_needs_memory_in_proportion(make, spark):
    import tracemalloc

    words = np.random.default_rng(4).integers(0, 2**63, 60_000).astype(np.uint64)
    tracemalloc.start()
    assert D.tile(words, words, 5) == [(0, 0, 60_000)]
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def items(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "item_id long, text string, doc_id string, tiles int")


def found(docs, bench, **options):
    return sorted((r["doc_id"], r["item_id"]) for r in D.matches(docs, bench, **options).collect())


def test_leaks(make, spark):
    item = prose(1, 40).split()
    half = prose(2, 40).split()
    rows = [
        (1, prose(10, 50) + " " + " ".join(item) + " " + prose(11, 50)), (2, " ".join(item).upper().replace(" ", ", ")), (3, " ".join(item[20:] + prose(12, 5).split() + item[:20])),
        (4, " ".join(item[:20])), (5, prose(13, 200)), (6, " ".join(item[:31])), (7, " ".join(w for k, w in enumerate(half) if k % 4)), (8, " ".join(item[:12] * 3)),
    ]
    bench = items(spark, [(100, " ".join(item)), (101, " ".join(half)), (102, "two words"), (103, None), (104, "!!!")])
    assert found(make(rows), bench) == [(1, 100), (2, 100), (3, 100), (6, 100)]
    assert found(make(rows), bench, block_words=20) == [(1, 100), (2, 100), (3, 100), (6, 100)]
    kept = D.drop_contaminated(make(rows), bench)
    assert kept.columns == make(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 7, 8]


def test_odd_rows(make, spark, odd_rows):
    bench = items(spark, [(1, prose(2, 80)), (None, prose(3, 80)), (2, "only words here")])
    assert sorted(map(str, ((r["doc_id"], r["item_id"]) for r in D.matches(make(odd_rows), bench).collect()))) == sorted(map(str, [(5, 1), (6, 1), (5, None), (None, 2)]))
    assert sorted(str(r["doc_id"]) for r in D.drop_contaminated(make(odd_rows), bench).collect()) == sorted(map(str, [None, 1, 2, 3, 4, 4, 7, 8]))
    assert found(make(odd_rows).limit(0), bench) == [] and found(make(odd_rows), bench.limit(0)) == []


def test_short_items_match_whole():
    hashes = WordHashes()
    index = D.Index([(1, "b c")], 5, hashes)
    assert [s.tolist() for _, _, s in index.hits(hashes.array(D.tokens("a b c d b c")))] == [[1, 4]]
