"""Byte-level primitives against code-point rules, on generated texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import textkit as K
from tests.llm import brute

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.characters(codec="utf-8"), max_size=40), st.text(alphabet="aB \n\t\x0b\x1c\x85é世0_-", max_size=60)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words(texts):
    array = pa.array(texts, pa.string())
    data, starts, ends = K.joined(array, b"\n")
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [x or "" for x in texts]
    for is_word, pattern, lower in ((K.NOT_SPACE, brute.WORD, False), (K.LOWER_ALNUM, brute.ITEM_WORD, True)):
        body = K.LOWER[data] if lower else data
        w0, w1 = K.word_spans(body, is_word)
        got = [body[a:b].tobytes().decode() for a, b in zip(w0, w1)]
        want = [w for x in texts for w in pattern.findall((x or "").translate(brute.LOWER) if lower else x or "")]
        assert got == want
        hashes = K.span_hashes(body, w0, w1)
        assert len(set(hashes.tolist())) == len(set(want)) and all((hashes[i] == hashes[j]) == (want[i] == want[j]) for i in range(len(want)) for j in range(i))


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 50))
def test_slices_cover_all_rows(texts, limit):
    found = list(K.slices(pa.array(texts, pa.string()), limit))
    assert [k for a, b in found for k in range(a, b)] == list(range(len(texts)))


def test_sums():
    assert K.sums_between(np.array([1, 2, 3]), np.array([0, 1, 1, 3]), np.array([1, 1, 3, 3])).tolist() == [1, 0, 5, 0]
    assert K.sums_between(np.array([True, True, False, True]), np.array([0, 3]), np.array([2, 4])).tolist() == [2, 1]
    assert K.sums_between(np.zeros(0), np.array([0]), np.array([0])).tolist() == [0]


def test_hashes_in_groups(monkeypatch):
    """A span's hash does not depend on where it stands or in which group it falls."""
    words = [b"alpha", b"be", b"x" * 300, b"alpha", b"\xc3\xa9", b"be"] * 50
    data = np.frombuffer(b" ".join(words), np.uint8)
    w0, w1 = K.word_spans(data, K.NOT_SPACE)
    whole = K.span_hashes(data, w0, w1)
    monkeypatch.setattr(K, "SLICE_BYTES", 64)
    assert (K.span_hashes(data, w0, w1) == whole).all()
    by_word = {}
    for w, h in zip(words, whole.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
