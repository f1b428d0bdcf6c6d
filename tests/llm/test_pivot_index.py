import itertools
import math

import numpy as np
import pytest

from marginalia.llm import pivot_index
from marginalia.llm.pivot_index import candidates, choose_pivots, near_vectors, unit

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = [(i, np.array(v, np.float64), l) for i, v, l in rows if i is not None and v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, *_ in rows if i is not None}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, v, l) in enumerate(good):
        for j, w, m in good[:k]:
            if l == m and len(v) == len(w) and i != j and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), i == find(i)) for i in parent}


def clusters(seed, n, size=16):
    r = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = r.normal(size=size)
        for _ in range(int(r.choice([1, 1, 1, 2, 5, 60]))):
            v = (centre + r.normal(size=size) * 0.1).astype(np.float32)
            for _ in range(int(r.choice([1, 1, 1, 3]))):
                rows.append((len(rows), v.tolist(), int(r.integers(3)) if len(rows) % 50 else None))
    return rows


@pytest.mark.parametrize("block", [16, 1024])
def test_recall_and_exactness(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rows = clusters(block, 1500)
    want = brute(rows)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(w[0] for w in want.values())
    assert np.mean([(r.n_links, r.component_id, r.kept) == want[r.vec_id] for r in got]) > 0.97


def test_odd_vectors(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 0), (2, e, 0), (3, [2.0, 4.0, 6.0], 0), (4, e, 1), (5, e, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 3.0], 0), (9, [1.0, float("nan"), 3.0], 0), (10, [1.0, float("inf"), 3.0], 0), (11, [], 0), (12, [1.0, 2.0], 0), (None, e, 0), (2, e, 0), (13, [3e38, 3e38, 3e38], 5), (14, [1e-38, 1e-38, 1e-38], 5)]
    got = near_vectors(spark.createDataFrame([(*r, True) for r in rows], SCHEMA + ", kept boolean")).collect()
    want = brute([r for i, r in enumerate(rows) if i != 13])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == want
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, False)]
    assert len(got) == 15
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def near(rows, want, got, recall=0.9):
    assert len(got) == len(rows) and all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= recall * sum(w[0] for w in want.values())


@pytest.mark.parametrize("block", [64, 1024])
def test_vectors_that_point_the_same_way(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    r = np.random.default_rng(5)
    base = r.normal(size=(1500, 64)) + 2  # a mean cosine of about 0.8
    copies = base[r.integers(0, 1500, 500)] * (1 + r.normal(size=(500, 64)) * 0.05)
    vectors = np.vstack([base, copies]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    assert len(choose_pivots(vectors.astype(np.float64), 64)) == 64
    near(rows, brute(rows), near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


@pytest.mark.parametrize("block", [64, 1024])
def test_one_dense_cluster(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    r = np.random.default_rng(6)
    cluster = r.normal(size=32) + r.normal(size=(500, 32)) * 0.08
    vectors = np.vstack([cluster, r.normal(size=(700, 32))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    near(rows, brute(rows), near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def test_pivots_keep_apart():
    r = np.random.default_rng(0)
    cluster = r.normal(size=8) + r.normal(size=(500, 8)) * 0.01
    pivots = choose_pivots(np.vstack([cluster, r.normal(size=(200, 8))]), 64)
    assert np.triu(pivots @ pivots.T, 1).max() < math.cos(2 * math.acos(0.98))
    assert np.allclose(np.linalg.norm(unit(np.array([[3e300, 1e300], [1e-300, 0]])), axis=1), 1)


def test_a_pair_is_a_candidate_in_one_list():
    r = np.random.default_rng(1)
    for _ in range(200):
        p, q = (np.sort(r.permutation(12)[:8])[None].astype(np.int32) for _ in range(2))
        both = np.intersect1d(p, q)
        for depth in (1, 2, 3, 4):
            keys = [list(map(int, k)) for k in itertools.combinations(both, depth)]
            assert sum(candidates(p, q, k, 4)[0, 0] for k in keys) == (len(both) >= 4)
