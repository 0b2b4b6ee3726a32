import numpy as np
import pytest

from ripplegraph.llm import packing

P = pytest.importorskip("public_tokenizers")
TOKENIZERS = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_cut_points():
    assert packing.cut_points(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.cut_points(1, 2048) == [1] and packing.cut_points(2048, 2048) == [2048]
    assert all(sum(packing.cut_points(n, 64)) == n for n in range(1, 500))


def test_pieces_give_back_every_document(make, odd_rows):
    t = TOKENIZERS.Tokenizer.from_file(PATH)
    strange = [(20, "İSTANBUL, ǀǀ ƻ don't ÉCOLE!! x<|endoftext|>y　z\x1cA é. STRASSE ΣΑΣ."), (21, "DON'T 's 've!! 12,345 $$$")]
    rows = odd_rows + strange
    pieces = packing.pack(make(rows), PATH).toPandas()
    assert pieces["sequence_id"].is_unique and (pieces["offset"] == 0).all() and (pieces["length"] == 2 ** pieces["bucket"]).all()
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows)
    got, own = [], []
    for p in pieces.sort_values("sequence_id").itertuples():
        assert len(own) == p.start
        own += np.frombuffer(p.ids, "<u4").tolist()
        if len(own) == p.doc_tokens:
            got.append(own)
            own = []
    assert sorted(got) == want


def test_empty(make):
    assert packing.pack(make([(1, "a")]).limit(0), PATH).count() == 0


def test_every_letter_before_punctuation(make):
    """A cached chunk of letters and punctuation has the ids of the whole text, for each letter that chunks are cut at."""
    t = TOKENIZERS.Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = [f"Bah{c}, {c}. x{c.upper()}y{c}! {c}{c}; {c}-{c} a{c}' z" for c in letters]
    cache = packing.PieceCache.of_file(PATH)
    for text in texts:
        own = b"".join(map(cache.__getitem__, text.split(" ")))
        assert np.frombuffer(own, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert not packing.PieceCache._PARTS.fullmatch("İ,")
