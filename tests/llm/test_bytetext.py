import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bytetext, fragment_bpe
from marginalia.llm.bytetext import buffers, range_hashes, row_words, same_ranges
from marginalia.llm.fragment_bpe import FragmentBPE

from tests.llm.alike import mirrored

BPE = public_tokenizers.path("byte_bpe_50k.json")


def hashes(texts):
    raw, at = buffers(pa.array(texts))
    return range_hashes(raw, at[:-1], at[1:])


def test_equal_texts_have_equal_hashes_wherever_they_stand():
    r = random.Random(1)
    texts = ["".join(r.choice("ab \né") for _ in range(r.choice([0, 1, 7, 8, 9, 63, 64, 65, 200]))) for _ in range(400)]
    found = hashes([*texts, *reversed(texts)])
    assert (found[: len(texts)] == found[len(texts) :][::-1]).all()
    assert len(set(found.tolist())) == len(set(texts))


@pytest.mark.parametrize("doublings", [3, 9, 10, 11, 16])
def test_mirrored_texts_have_different_hashes(doublings):
    a, b = hashes(mirrored(doublings))
    assert a != b


def test_ranges_are_compared_by_their_bytes():
    texts = ["abc", "abd", "abc", "", "x" * 100, "x" * 99 + "y", "x" * 100, "abcdefgh", "abcdefgi", "abcdefgh"]
    raw, at = buffers(pa.array(texts))
    other = np.array([0, 0, 0, 3, 4, 4, 4, 7, 7, 7])
    assert same_ranges(raw, at[:-1], at[1:], other).tolist() == [t == texts[i] for t, i in zip(texts, other, strict=True)]


@pytest.mark.parametrize("collide", [False, True])
def test_fragments_of_one_hash_are_told_apart(monkeypatch, collide):
    if collide:
        monkeypatch.setattr(fragment_bpe, "range_hashes", lambda raw, start, stop: (stop - start).astype(np.uint64) // np.uint64(5))
    texts = [*mirrored(), "the river and the stone", "a'll b's 12 é", "", "the stone"]
    bpe, model = FragmentBPE(BPE), Tokenizer.from_file(BPE)
    raw, at = buffers(pa.array(texts))
    got = [ids[a:b].tolist() for _, ids, bounds in bpe.encode_batch(raw, at) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_of_fragments_is_bounded(monkeypatch):
    monkeypatch.setattr(fragment_bpe, "REMEMBERED_BYTES", 100)
    bpe, model = FragmentBPE(BPE), Tokenizer.from_file(BPE)
    for k in range(5):
        text = " ".join(f"word{k}x{i}" for i in range(100))
        raw, at = buffers(pa.array([text]))
        [(_, ids, _)] = bpe.encode_batch(raw, at)
        assert ids.tolist() == model.encode(text, add_special_tokens=False).ids and bpe._known_bytes < 3000


def test_words_of_a_long_row_are_joined(monkeypatch):
    text = "One two  three\tfour " * 40
    raw, at = buffers(pa.array(["a", text, "", "b c"]))
    whole = [(first, bounds.tolist(), h.tolist()) for first, bounds, h in row_words(raw, at)]
    parts = {first + i: h[a:b].tolist() for first, bounds, h in row_words(raw, at, 50) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))}
    [(_, bounds, h)] = whole
    assert parts == {i: h[a:b] for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))}
    assert bytetext.SHORT >= 8
