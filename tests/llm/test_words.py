import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import _words as w

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("aAbé ẞ\t\n\x0b\x0c\r\x1c .😀"), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    got = w.Words(pa.array(texts, pa.string()))
    want = [WORD.findall(t or "") for t in texts]
    assert got.counts().tolist() == [len(x) for x in want]
    found = [got.data[a:b].decode() for a, b in zip(got.begin, got.end, strict=True)]
    assert found == [x for t in want for x in t]
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    by = {}
    for x, h in zip(found, got.hash.tolist(), strict=True):
        assert by.setdefault(low(x), h) == h
    assert len(set(by.values())) == len(by)


def test_hashes_do_not_depend_on_place():
    one = w.Words(pa.array(["x" * 3_000_000 + " tail word"])).hash
    two = w.Words(pa.array(["tail word"])).hash
    assert one[1:].tolist() == two.tolist()


def test_shingles():
    sets = w.shingles(w.Words(pa.array(["a b c d e f", "a b c d e f a b c d e", "a b", None, "B A", ""])))
    assert [len(s) for s in sets] == [2, 6, 1, 0, 1, 0]
    assert set(sets[0]) < set(sets[1]) and sets[2][0] != sets[4][0]


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, ""] * 5})
    parts = list(w.pieces(batch, limit=30))
    assert sum(p.num_rows for p in parts) == 20 and len(parts) > 3
    assert list(w.pieces(batch.slice(0, 0))) == []


def test_groups():
    assert w.groups(np.array([1, 1, 2]), np.array([5, 6, 6])) == [(0, 1), (1, 2), (2, 3)]
    assert w.groups(np.array([])) == []
