from ripplegraph.llm import license_scan as L

from .conftest import prose


def found(df, **options):
    return sorted(((r["doc_id"], r["license"], r["n_found"], r["n_template"]) for r in L.scan(df, **options).collect()), key=str)


def plain(rows, least=0.75):
    import re

    words = lambda t: re.findall("[a-z0-9]+", t.translate(str.maketrans(L.UPPER, L.LOWER)))
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    out = []
    for d, t in rows:
        for name, body in L.TEMPLATES.items():
            own, n = shingles(body), len(shingles(body) & shingles(t or ""))
            if n >= least * len(own):
                out.append((d, name, n, len(own)))
    return sorted(out, key=str)


def test_matches(make):
    mit = L.TEMPLATES["MIT"].split()
    rows = [(1, prose(1, 300) + " " + " ".join(mit) + " end"), (2, " ".join(w for k, w in enumerate(mit) if k % 40)), (3, " ".join(mit[: len(mit) // 2])), (4, "x RELEASED under\nthe MIT-license y"), (5, "all software under license"), (6, L.TEMPLATES["BSD-2-Clause"] + " " + L.TEMPLATES["ISC"])]
    assert found(make(rows)) == plain(rows) and {d for d, *_ in plain(rows)} == {1, 2, 4, 6}


def test_odd_rows(make, odd_rows):
    rows = [(9, None), (None, None), (None, "Released under the MIT License."), (10, "license"), (11, "Released under the MIT License."), (11, "Released under the MIT License.")]
    assert found(make(odd_rows + rows)) == plain(odd_rows + rows)
    assert found(make(rows).limit(0)) == []


def test_damaged_copies_at_every_place(make):
    """Each template behind prose of some length, with words changed as long as three quarters of its shingles stay."""
    import random

    rows = []
    for k, (name, body) in enumerate(sorted(L.TEMPLATES.items())):
        r, words = random.Random(k), body.split()
        for j in range(3):
            own = list(words)
            for _ in range(len(words) // 25):
                own[r.randrange(len(own))] = "changed"
            rows.append((100 * k + j, prose(k, r.randrange(60)) + " " + " ".join(own) + " " + prose(k + 1, 30)))
    long = " ".join(prose(k, 4000) + " " + body for k, body in enumerate(L.TEMPLATES.values()))
    rows.append((9999, long))
    want = plain(rows)
    assert found(make(rows)) == want and len({name for _, name, *_ in want}) == len(L.TEMPLATES) == sum(d == 9999 for d, *_ in want)


def test_lower_thresholds_lose_nothing(make):
    templates = {"x": "one two three four five six seven eight nine ten software license terms apply here"}
    rows = [(1, "one two three four five six seven eight nine ten"), (2, "one two three four five six")]
    assert L.unanchored(templates, 0.75) == [] and L.unanchored(templates, 0.4) == ["x"]
    assert [r[0] for r in found(make(rows), templates=templates, least=0.4)] == [1]


def test_anchors():
    assert L.unanchored(L.TEMPLATES) == [] and L.unanchored({"x": "one two three four five six"}) == ["x"]
