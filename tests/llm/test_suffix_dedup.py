import random

import numpy as np

from ripplegraph.llm import suffix_dedup as S
from ripplegraph.llm.common import WordHashes, words_of

from .conftest import prose


def brute(rows, n=50):
    seen = {}
    for k, (_, t) in enumerate(rows):
        w = words_of(t)
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(tuple(w))
    copies = {}
    for _, t in rows:
        copies[tuple(words_of(t))] = copies.get(tuple(words_of(t)), 0) + 1
    out = []
    for d, t in rows:
        w = words_of(t)
        cov = np.zeros(len(w) + 1, bool)
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i : i + n])]) > 1 or copies[tuple(w)] > 1:
                cov[i : i + n] = True
        edge = np.flatnonzero(np.diff(np.r_[False, cov, False].astype(int)))
        out += [(str(d), int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return sorted(out)


def found(df, **options):
    return sorted((str(r["doc_id"]), r["start"], r["stop"]) for r in S.repeated_spans(df, **options).collect())


def test_minimisers_are_the_least_of_each_window():
    hashes = WordHashes()
    for seed in range(30):
        words = hashes.array([f"w{random.Random(seed * 100 + k).randrange(6)}".encode() for k in range(50 + 7 * seed)])
        at, _ = S.minimisers(words, 50)
        own, width = S.windows(words, S.K), 50 - S.K + 1
        want = sorted({i + int(own[i : i + width].argmin()) for i in range(len(own) - width + 1)})
        assert at.tolist() == want


def test_passages(make):
    p = [prose(700 + k, n) for k, n in enumerate((50, 49, 51, 120, 60))]
    rows = [(d, prose(d, 70)) for d in range(20)]
    for d in range(20, 70):
        r = random.Random(d)
        rows.append((d, " ".join(x for k in range(3) for x in (prose(1000 + 10 * d + k, r.randrange(0, 60)), r.choice(p)))))
    rows += [(70, p[3].upper()), (71, " ".join(p[3].split()[10:100])), (72, p[0]), (73, prose(900, 80)), (74, prose(900, 80))]
    assert found(make(rows)) == found(make(rows), most=3) == brute(rows)


def test_copies_parted_by_one_sided_matches(make):
    """What precedes and what follows a suffix come from different neighbours; only others hold both."""
    r = random.Random(1)
    left, right = prose(800, 60).split(), prose(801, 60).split()
    rows = []
    for d in range(60):
        a, b = r.randrange(0, 60), r.randrange(0, 60)
        rows.append((d, prose(2000 + d, 20) + " " + " ".join(left[60 - a :] + right[:b]) + " " + prose(3000 + d, 20)))
    assert found(make(rows)) == found(make(rows), most=1) == brute(rows)


def test_common_prefixes_count_whole_words():
    texts = sorted(S._joined(w.split()) for w in (b"a b c", b"a b cd", b"a b", b"a bc", b"", b"b", b"b \x05 c"))
    words = [t.split(b" ")[:-1] for t in texts]
    want = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(words, words[1:])]
    assert S.common_prefixes(np.zeros(len(texts)), texts).tolist() == [-1, *want]
    many = [S._joined([b"x", b"%05d" % k, b"y"]) for k in range(3000)]
    assert S.common_prefixes(np.arange(3000) // 2, many).tolist() == [1 if k % 2 else -1 for k in range(3000)]


def test_odd_words(make):
    """Words that are long, hold zero bytes or look like a digest, in copies and near copies."""
    words = prose(55, 80).split()
    words[10], words[20], words[30] = "l" * 5000, "\x00z", "\x01" + "a" * 32
    other = [*words]
    other[10] = "l" * 4999 + "m"
    rows = [(1, "x " + " ".join(words)), (2, "y " + " ".join(words)), (3, "z " + " ".join(other)), (4, " ".join(w if w != "\x00z" else "z" for w in words))]
    assert found(make(rows)) == found(make(rows), most=1) == brute(rows)


def test_odd_rows(make, odd_rows):
    assert found(make(odd_rows)) == brute(odd_rows)
    assert found(make(odd_rows).limit(0)) == []
