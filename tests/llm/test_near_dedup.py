import random

from ripplegraph.llm import near_dedup
from ripplegraph.llm.common import WordHashes

from .conftest import prose


def brute(rows):
    """component of each row by (id, text); links between all pairs."""
    hashes = WordHashes()
    sets = [set(near_dedup.shingle_set(t, hashes).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(None if d is None else ids[find(i)])) for i, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_dedup.near_duplicates(df).collect())


def family(seed, n, copies, rate):
    r, base = random.Random(seed), prose(seed, n).split()
    return [" ".join(w if r.random() > rate * (k % 5) / 4 else f"z{r.randrange(10**6)}" for w in base) for k in range(copies)]


def test_families_against_all_pairs(make):
    texts = [prose(s, 60) for s in range(40)]
    for s in range(6):
        texts += family(100 + s, 120, 20, 0.06)
    passage = prose(7, 60)
    texts += [prose(900 + s, 30) + " " + passage for s in range(30)]
    random.Random(3).shuffle(texts)
    rows = list(enumerate(texts, 10))
    assert found(make(rows)) == brute(rows)


def test_chain_reaches_the_smallest(make):
    words = prose(5, 400).split()
    rows = [(90 - k, " ".join(words[12 * k : 12 * k + 120])) for k in range(12)]
    assert found(make(rows)) == brute(rows)


def test_odd_rows(make, odd_rows):
    rows = odd_rows + [(30, "one two"), (31, "ONE  two\n"), (32, "one two three")]
    assert found(make(rows)) == brute(rows)
    kept = near_dedup.keep_first(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, t in rows if d not in (31,) and not (d == 6))
    assert found(make(rows).limit(0)) == [] and near_dedup.keep_first(make(rows).limit(0)).count() == 0


def test_regions_of_many_blocks(make, monkeypatch):
    """One crowd of variants of a text, whose regions are dealt to many pairs of small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 250)
    monkeypatch.setattr(near_dedup, "BEST", 1)
    base, rows = prose(77, 60).split(), []
    for d in range(70):
        r, words = random.Random(d), list(base)
        for k in range(r.randrange(9)):
            words[r.randrange(60)] = f"x{d}y{k}"
        rows.append((d, " ".join(words)))
    assert found(make(rows)) == brute(rows)
