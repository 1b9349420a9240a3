import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm.text_arrays import PLAIN, pieces, ranges, text_buffer, windows, words
from tests.llm.helpers import lowered, plain_words

TEXT = st.lists(st.one_of(st.none(), st.text("ab AÉé\n\t.\x1f 😀", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_pattern(texts):
    found = words(*text_buffer(pa.array(texts, pa.string())), PLAIN, lower=True)
    for i, text in enumerate(texts):
        a, b = found.first[i], found.first[i + 1]
        own = [w.decode() for w in found.text(a, b).split(b" ") if w]
        assert own == plain_words(lowered(text)) and b - a == len(own)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_equal_words_and_only_they_share_a_hash(texts):
    found = words(*text_buffer(pa.array(texts, pa.string())), PLAIN, lower=False)
    seen = {}
    for i, h in enumerate(found.hashes().tolist()):
        assert seen.setdefault(found.text(i, i + 1), h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_slices_and_trailing_zero_bytes():
    column = pa.array(["skip", "a" * (3 << 20) + " b", "a\x00", "a", None]).slice(1)
    found = words(*text_buffer(column), PLAIN, lower=False)
    assert np.diff(found.first).tolist() == [2, 1, 1, 0]
    assert len(set(found.hashes().tolist())) == 4


def test_windows_ranges_and_pieces():
    values = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    found = windows(values, 3)
    assert len(found) == 4 and found[0] == found[3] and len(set(found.tolist())) == 3
    assert len(windows(values, 7)) == 0
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    batch = pa.record_batch({"text": ["aaaa", None, "b" * 100, "c", "dd"]})
    assert [p.column("text").to_pylist() for p in pieces(batch, 5)] == [["aaaa", None], ["b" * 100], ["c", "dd"]]
