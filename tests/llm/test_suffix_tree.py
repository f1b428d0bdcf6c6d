import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import suffix_tree
from marginalia.llm.suffix_tree import Block, climb, grow, grow_sorted, score_contexts, shrink, shrink_sorted

from tests.llm.alike import mirrored


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def brute(rows, longest=3):
    """(key, held out, tokens, known ones, training tokens, base score, score) by the definition of the tree, on plain dictionaries."""
    follows = defaultdict(Counter)  # of each context of words, the empty one included
    for i, t in rows:
        if not held_out(i):
            s = words(t)
            for k, w in enumerate(s):
                for size in range(min(k, longest) + 1):
                    follows[tuple(s[k - size : k])][w] += 1
    unigrams = follows[()]
    total = sum(unigrams.values())
    kept = {}

    def chance(context, w):
        if not context:
            return (unigrams[w] + 0.1) / (total + 0.1 * (len(unigrams) + 1))
        if not retained(context):
            return chance(context[1:], w)
        n = sum(follows[context].values())
        a = 4 * n**0.7
        return (follows[context][w] + a * chance(context[1:], w)) / (n + a)

    def retained(context):
        if context not in kept:
            n = sum(follows[context].values()) if context in follows else 0
            kept[context] = False
            if n > 1:
                a, gain = 4 * (n - 1) ** 0.7, 0.0
                for w, c in follows[context].items():
                    parent = chance(context[1:], w)
                    gain += c * math.log((c - 1 + a * parent) / ((n - 1 + a) * parent))
                kept[context] = gain > 3.0
        return kept[context]

    out = []
    for i, t in rows:
        s = words(t)
        base = sum(math.log10(chance((), w)) for w in s)
        score = sum(math.log10(chance(tuple(s[max(0, k - longest) : k]), w)) for k, w in enumerate(s))
        states = sum(any(retained(tuple(s[k - size : k])) for size in range(1, min(k, longest) + 1)) for k in range(len(s)))
        out.append((str(i), held_out(i), len(s), sum(w in unigrams for w in s), total, round(base, 5), round(score, 5), states))
    return sorted(out)


def rounded(got):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5), r.n_states) for r in got)


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and r.random() < 0.4:
            own = r.choice(out)[1].split()
            for _ in range(len(own) // 20):
                own[r.randrange(len(own))] = r.choice(vocabulary)
        else:
            own = [vocabulary[min(int(r.expovariate(0.02)), 299)].upper() for _ in range(r.randint(0, 80))]
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("size,longest", [(1 << 19, 3), (500, 3), (40, 2), (40, 4)])
def test_scores_equal_those_by_definition(spark, monkeypatch, size, longest):
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", size)  # longer rows have several blocks
    rows = corpus(longest, 300) + [(1000, None), (1001, ""), (1002, " \n"), (None, "w1 w2"), (3, "W1 w2 É"), (1003, "w1 w2 w3 " * 60), (1003, "w1 w2 w3 " * 60)]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id long, text string, score string, block string").repartition(3)
    got = score_contexts(df, longest=longest)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_states"]
    got = got.collect()
    assert rounded(got) == brute(rows, longest)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert any(r.n_states for r in held)


def test_long_texts_mirrored_words_and_empty_tables(spark):
    like = mirrored()
    rows = [(1, "a b " * 400_000), (2, "x" * 3_000_000), (10, "a b"), (11, like[0]), (12, f"{like[0]} a")]
    held = next(i for i in range(100, 200) if held_out(i))
    rows.append((held, like[1]))
    got = {r.doc_id: r for r in score_contexts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {1: 800_001, 2: 2, 10: 3, 11: 2, 12: 3, held: 2}
    assert got[held].n_known == 1 and got[held].train_tokens == sum(len(words(t)) for i, t in rows if not held_out(i))
    assert score_contexts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_suffix_of_a_context_can_be_a_state(spark):
    # "never of the" isn't in any training text, so that only its suffix "of the" can tell what follows
    r = random.Random(3)
    rows = [(i, " ".join(f"{r.choice('abcdefghij')}{r.randrange(40)} of the river and the stone" for _ in range(6))) for i in range(300)]
    held = [i for i in range(1000, 1100) if held_out(i)][0]
    rows.append((held, "never of the river"))
    got = rounded(score_contexts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    row = next(x for x in got if x[0] == str(held))
    assert row[7] == 3


def test_what_was_counted_grows_with_the_input(spark):
    # each of many words is followed by others, twice: no table of fixed size holds these
    firsts, nexts = [f"a{i}" for i in range(150)], [f"b{i}" for i in range(150)]
    rows = [(i * 2 + k, " ".join(f"{a} {b} z{i}x{j}y{k}" for j, b in enumerate(nexts))) for i, a in enumerate(firsts) for k in range(2)]
    assert rounded(score_contexts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()) == brute(rows)


def test_only_repeated_runs_keep_a_context():
    hashes = np.array([3, 4, 9] * 6 + [5, 6, 9, 5, 7, 9], np.uint64)
    block = Block.of(hashes, 0, np.full(8, 3), np.ones(8))
    known = {}
    for _ in range(3):
        for level, what, keys, own in climb(block, known, 30.0, 1)[0]:
            known[level, what] = own if what == "count" else (own > 3.0 * suffix_tree.STEPS).astype(np.int64)
    _, count, root, chance, length = climb(block, known, 30.0, 1)
    assert count.tolist() == [6, 6, 8] * 6 + [2, 1, 8, 2, 1, 8]
    assert length.tolist() == [0, 1, 1] * 6 + [0, 0, 0] * 2 and (chance >= root).all()


def test_numbers_are_packed():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (grow_sorted(shrink_sorted(keys), len(keys)) == keys).all()
    values = r.integers(-(1 << 62), 1 << 62, 50)
    assert (grow(shrink(values), 50) == values).all() and len(grow(shrink(values[:0]), 0)) == 0
    assert pa.types.is_binary(suffix_tree._arrow(suffix_tree._ASKED).field("keys").type)
