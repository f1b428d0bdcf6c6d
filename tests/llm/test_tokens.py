import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marginalia.llm.fragment_bpe import encode_decode, encoder
from marginalia.llm.token_counts import count_texts, token_counts

from tests.llm.alike import mirrored

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*" \n\t\r'strmvledabcXY019.,!?-é日🙂́Ⅷ½\x85 <|>▁", "  ", "'s", "'ll", " '", "<|endoftext|>", "<s>", "the ", "Ünder ", "12 "]


def texts(n, longest=60, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t) for i, t in enumerate(texts(400))]
    rows += [(500, None), (501, ""), (None, "a b"), (1, rows[1][1]), (502, "word " * 400_000), (503, "x" * 200_000), (504, "a'll b's " * 150_000)]
    rows += [(510 + i, t) for i, t in enumerate(mirrored())]
    return spark.createDataFrame([(*x, "clash", 7) for x in rows], "doc_id long, text string, ids string, n_tokens int"), rows


def test_bpe_equals_the_library(frame):
    df, rows = frame
    model = Tokenizer.from_file(BPE)
    want = sorted((str(i), model.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    got = encode_decode(df, BPE)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got.collect()) == want


def test_bpe_decodes_what_is_not_utf8():
    import numpy as np

    model, bpe = Tokenizer.from_file(BPE), encoder(BPE)
    r = random.Random(1)
    for _ in range(200):
        ids = [r.randrange(bpe.size) for _ in range(r.randint(0, 8))]
        assert bpe.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [model.decode(ids, skip_special_tokens=False)]


def test_bpe_of_an_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_equal_the_library(frame):
    df, rows = frame
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts(df, PIECES)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got.collect()) == want


def test_splitting_changes_no_count():
    some = texts(300, 200, seed=9) + ["a b" * 50, " a b ", "a  b", "▁a b", "a ▁b"]
    assert count_texts(some, PIECES, long_bytes=3, batch_bytes=50) == count_texts(some, PIECES, long_bytes=1 << 30)


def test_counts_with_the_other_library():
    model = Tokenizer.from_file(BPE)
    some = texts(50)
    assert count_texts(some, BPE) == [len(model.encode(t, add_special_tokens=False).ids) for t in some]


def test_counts_of_an_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PIECES).collect() == []


def test_digests_of_the_query(spark, tmp_path):
    from marginalia.llm.registry import op10_bpe_roundtrip

    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_bpe_roundtrip(spark, str(tmp_path)).collect()}
    ids = Tokenizer.from_file(BPE).encode("a b").ids
    assert got[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got[2].ids_sha256 == got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
