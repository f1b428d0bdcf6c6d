import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm.packing import pack, plan_packing

from tests.llm.alike import mirrored

BPE = public_tokenizers.path("byte_bpe_50k.json")


def laid_out(histogram, capacity):
    plan = plan_packing(histogram, capacity)
    lengths = np.repeat(list(histogram), list(histogram.values())).astype(np.int64)
    ranks = np.concatenate([np.arange(n) for n in histogram.values()]).astype(np.int64)
    return plan, lengths, *plan.place(lengths, ranks)


def gapless(lengths, bins, offsets, capacity):
    held = defaultdict(list)
    for x, b, o in zip(lengths, bins, offsets, strict=True):
        held[b].append((o, x))
    for places in held.values():
        at = 0
        for o, x in sorted(places):
            assert o == at
            at += x
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("seed", range(40))
def test_plans_are_gapless_and_near_the_bound(seed):
    r = np.random.default_rng(seed)
    lengths, counts = np.unique(r.integers(1, 101, r.integers(1, 400)), return_counts=True)
    plan, lengths, bins, offsets = laid_out(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 100)
    assert gapless(lengths, bins, offsets, 100) == plan.bins
    exact = max(-(-int(lengths.sum()) // 100), int((lengths > 50).sum()))
    assert plan.bins <= exact * 1.12 + 1


@pytest.mark.parametrize("seed", range(12))
def test_configurations_are_optimised(seed):
    from marginalia.llm.packing import _configurations, _optimised

    r = np.random.default_rng(seed)
    sizes = sorted(r.choice(np.arange(26, 100), 6, replace=False).tolist(), reverse=True)
    counts = r.integers(1, 400, 6).tolist()
    for find in (_configurations, lambda *a: _optimised(*a, 3)):
        left = list(counts)
        for chosen, times in find(sizes, counts, 100):
            assert times > 0 and sum(sizes[k] for k in chosen) <= 100
            for k in chosen:
                left[k] -= times
        assert left == [0] * 6
    fewest = sum(times for _, times in _optimised(sizes, counts, 100, 3))
    assert fewest <= sum(times for _, times in _configurations(sizes, counts, 100)) + 6
    assert fewest >= max(sum(c for x, c in zip(sizes, counts, strict=True) if x > 50), sum(x * c for x, c in zip(sizes, counts, strict=True)) / 100)


def test_optimised_configurations_beat_the_fullest():
    from marginalia.llm.packing import _configurations, _optimised

    sizes, counts = [44, 24, 22], [100, 100, 300]  # taking 44 + 24 + 24 first leaves 22s for themselves
    best = sum(t for _, t in _optimised(sizes, counts, 100, 4))
    assert best <= sum(t for _, t in _configurations(sizes, counts, 100))


def test_best_possible_plans():
    for histogram, best in (({1: 5}, 1), ({100: 3}, 3), ({51: 10, 49: 10}, 10), ({60: 4, 40: 4}, 4), ({34: 4, 33: 8}, 4)):
        assert plan_packing(histogram, 100).bins == best
    assert plan_packing({}, 100).bins == 0
    with pytest.raises(ValueError):
        plan_packing({101: 1}, 100)


def test_documents_are_cut_and_placed(spark):
    texts = ["a b c", None, "", "word " * 30, "x y " * 200, "word " * 30] + [f"some text {i} " * (i % 9) for i in range(120)] + [*mirrored()]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "null key", 1), (3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    model = Tokenizer.from_file(BPE)
    got = pack(df, BPE, capacity=32).collect()
    want = []
    for i, t, _ in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) - 32 * (-(-len(ids) // 32) - 1)
        cuts = [0, *range(first, len(ids) + 1, 32)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = gapless([r.length for r in got], [r.sequence_id for r in got], [r.offset for r in got], 32)
    assert used <= sum(r.length for r in got) / 32 * 1.1 + 1


def test_ids_of_the_pieces(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "")], "doc_id long, text string")
    got = sorted(pack(df, BPE, capacity=4, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece))
    whole = Tokenizer.from_file(BPE).encode("one two three four five six", add_special_tokens=False).ids + [0]
    assert [i for r in got if r.doc_id == 1 for i in r.ids] == whole
    assert got[-1].ids == [0]


def test_an_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []
