import random

import numpy as np
import pytest

from marginalia.llm import parity_join
from marginalia.llm.components import connected_components, forest
from marginalia.llm.parity_join import jaccard_groups, similar, sketch
from marginalia.llm.shared import Scratch

from tests.llm.alike import mirrored

def brute(rows):
    """(key, n, component) by comparing all pairs; rows: (key, text)."""

    def of(text):
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets = [(k, of(t)) for k, t in rows]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (k, a) in enumerate(sets):
        for m, b in sets[:i]:
            if k is not None and m is not None and ((a and b and 100 * len(a & b) >= 75 * len(a | b)) or k == m):
                x, y = find(k), find(m)
                parent[max(x, y)] = min(x, y)
    return sorted((str(k), len(s), find(k) if k is not None else None) for k, s in sets)


def corpus(seed, n=260):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.45:  # a copy with changes, more or less
            own = r.choice(texts[-40:])[:]
            for _ in range(int(len(own) * r.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08]))):
                own[r.randrange(len(own))] = r.choice(words)
            own = own[: len(own) - r.choice([0, 0, 1, 5])] or own
        else:
            own = [r.choice(words) for _ in range(r.choice([1, 2, 4, 5, 6, 7, 9, 12, 20, 40, 90, 200]))]
            if kind > 0.85:
                own += passage
        texts.append(own)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_groups_equal_those_of_all_pairs(spark, seed):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, component_id string").repartition(3)
    got = jaccard_groups(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((str(a), b, c) for a, b, c in got.collect()) == brute(rows)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"t{r.randrange(3000)}" for _ in range(150)]
    rows = []
    for i in range(700):
        own = base[:]
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            own[r.randrange(len(own))] = f"u{r.randrange(1 << 30)}"
        rows.append((i, " ".join(own)))
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(a), b, c) for a, b, c in got) == brute(rows)


def test_small_chunks_and_blocks_change_nothing(spark, monkeypatch):
    """Sets of one cell in many chunks, copies of a text in several, and a last turn whose cells are met in blocks."""
    monkeypatch.setattr(parity_join, "HELD_CELLS", 300)
    monkeypatch.setattr(parity_join, "MEET", 3)
    monkeypatch.setattr(parity_join, "FILTER_BITS", 64)  # full, so that it tells nothing
    r = random.Random(9)
    base = [f"t{r.randrange(500)}" for _ in range(60)]
    texts = corpus(7, 120) + [" ".join(base + [f"end{i} x{i}"]) for i in range(40)] + [" ".join(base)] * 5
    for _ in range(60):  # overlapping thirds, so that a common cell has sets of several groups
        own = [f"p{r.randrange(6)}w{j}" for _ in range(2) for j in range(12)]
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(a), b, c) for a, b, c in got) == brute(rows)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")] == []


def test_sketches_bound_the_difference():
    r = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 62, int(r.integers(1, 400))).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 62, int(r.integers(0, 60))).astype(np.uint64)]))
        apart = sum((x ^ y).bit_count() for x, y in zip(*(np.array(parity_join.parity_bits(s)).view(np.uint64).tolist() for s in (a, b)), strict=True))
        assert apart <= len(np.setxor1d(a, b))


def test_nulls_empty_texts_repeated_rows_and_spellings(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one\ttwo"), (6, "two one"), (None, "one two"), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (8, "x y z"), (9, "É b c d e"), (10, "é b c d e"), (8, "p q r"), (11, "P Q R")]
    rows += [(12, "long word " * 80_000), (13, "LONG word " * 80_001), (14, "z" * 300_000)]
    rows += [(20 + i, t) for i, t in enumerate(mirrored())] + [(22 + i, f"a b c d e {t} f g") for i, t in enumerate(mirrored(12))]
    got = jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(a), b, c) for a, b, c in got) == brute(rows)
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_similar_sets_always_meet():
    r = np.random.default_rng(0)
    for _ in range(3000):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop, add = r.integers(0, n // 4 + 1), r.integers(0, n // 3 + 1)
        b = np.unique(np.concatenate([r.permutation(a)[: max(1, n - drop)], r.integers(0, 1 << 63, add).astype(np.uint64)]))
        if similar(a, b):
            met = [(len(np.intersect1d(x, y)), s, t) for x, s in sketch(a) for y, t in sketch(b)]
            assert any(m >= max(s, t) for m, s, t in met)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 300)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {x: y for x, y in connected_components(df, Scratch(spark, "t"), "c").collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    nodes, roots = forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {x: find(x) for e in edges for x in e if find(x) != x}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").collect() == []
