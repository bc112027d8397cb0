"""Words, hashes and shingles against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from hearthline.llm.words import ALNUM, FOLDED, PLAIN, TO_ALNUM, Hasher, Words, chunks, shingles

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n\x00\x1f|9-日", max_size=30)), max_size=8)


def plain(text, table):
    raw = (text or "").encode().replace(b"\x00", b"\x0e")  # bytes.split() takes neither
    if table is ALNUM:
        return (text or "").encode().translate(TO_ALNUM).split()
    return (raw.lower() if table is FOLDED else raw).split()


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_words_are_those_of_plain_python(texts):
    for table in (PLAIN, FOLDED, ALNUM):
        seen = {}
        for row, off, data in chunks(pa.array(texts, pa.string()), 16):
            w = Words(off, data, table)
            h = Hasher()(w)
            for r in range(len(off) - 1):
                want = plain(texts[row + r], table)
                assert w.counts()[r] == len(want)
                for word, value in zip(want, h[w.first[r]:w.first[r + 1]].tolist()):
                    assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)


def test_shingles_stay_in_their_row():
    column = pa.array(["a b c", "", "d", None, "a b c d"])
    (_, off, data), = chunks(column)
    w = Words(off, data, PLAIN)
    g, ok = shingles(Hasher()(w), w.first, 3)
    assert ok.tolist() == [True, False, False, False, True, True]
    assert g[0] == g[4] != g[5]


def test_chunks_cover_all_rows():
    texts = ["x" * 100, None, "y", "z" * 50]
    for most in (1, 60, 10_000):
        got = [(row + r, bytes(data[off[r]:off[r + 1]])) for row, off, data in chunks(pa.array(texts), most) for r in range(len(off) - 1)]
        assert got == [(i, (t or "").encode()) for i, t in enumerate(texts)]


def test_hash_spreads():
    words = [f"w{i}" for i in range(20_000)] + ["ab", "ba", "aab", "aba"]
    (_, off, data), = chunks(pa.array([" ".join(words)]))
    h = Hasher()(Words(off, data, PLAIN))
    assert len(np.unique(h)) == len(words) and len(np.unique(h & np.uint64(0xFFFF))) > 15_000
