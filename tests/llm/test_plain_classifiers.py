"""The two classifiers against plain versions, written from their definitions on Python's own types."""

import math
import random
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from marginalia.llm import quality, toxicity
from marginalia.llm.bytetext import mix
from marginalia.llm.quality import BYTE_CLASSES, STATISTICS, classify_quality, keep_good, text_statistics
from marginalia.llm.toxicity import DISGUISES, EXCEPTIONS, KNOWN, classify_toxicity, keep_clean

from tests.llm.test_classifiers import insult, junk, labelled


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


# ---- toxicity --------------------------------------------------------------------------------------------------


def plain_fold(text):
    """Character by character; only what the texts of these tests have."""
    out = []
    looks = {c: a for a, others in DISGUISES.items() for c in others if c not in "|+$×°¢€§¡¿"}
    for k, c in enumerate(text):
        if c == "$" and 0 < k < len(text) - 1 and text[k - 1].isalpha() and text[k + 1].isalpha():
            c = "s"
        kind = unicodedata.category(c)
        if kind in ("Mn", "Me", "Cf"):
            continue
        base = unicodedata.normalize("NFKD", c)[0].lower() if kind[0] in "LN" else " "
        low = looks.get(c, looks.get(base, base))
        low = {"l": "i"}.get(low, low)
        out.append(low if low.isalpha() else " ")
    return " " + "".join(out) + " "


def plain_patterns(folded):
    return {p for w in folded.split() if 3 <= len(w) <= 40 for p in [f" {w} ", *[f" {w[:k]}" for k in range(4, min(len(w), 12) + 1)]]}


def plain_family(folded):
    words = folded.split() or [""]
    pairs = {zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)} or {zlib.crc32(words[0].encode())}
    return min(int(mix(np.array([p], np.uint64))[0]) for p in pairs) >> 1


def plain_entries(toxic, clean):
    """entry -> log odds; toxic, clean: folded texts, one of each family."""
    least = max(3, 0.004 * len(toxic))
    t, c = Counter(p for x in toxic for p in plain_patterns(x)), Counter(p for x in clean for p in plain_patterns(x))
    odds = lambda p: (t[p] + 0.5) / (len(toxic) + 1) / ((c[p] + 0.5) / (len(clean) + 1))
    good = {p for p in t if t[p] >= least and odds(p) >= 20}
    chosen = {}
    for p in sorted(good, key=lambda p: (len(p.rstrip()), p)):
        stem = p.rstrip()
        if any(stem[:k] in chosen for k in range(5, len(stem) + 1)):
            continue
        while longer := [q for q in good if q[:-1] == p and t[q] >= 0.98 * t[p]]:
            p = min(longer)
        chosen.setdefault(p, math.log(odds(p)))
    return chosen


def plain_hits(folded, weights, exceptions):
    """(start, length, entry, weight), by looking for each entry in turn."""
    found = {}
    for entry, weight in weights.items():
        forms = [(entry, len(entry))] + ([(" " + " ".join(entry.strip()) + " ", 2 * len(entry.strip()))] if len(entry.strip()) >= 4 else [])
        for form, length in forms:
            at = folded.find(form)
            while at >= 0:
                start = at + len(form) - length
                if start not in found or found[start][3] < weight:
                    found[start] = (start, start + length, entry, weight)
                at = folded.find(form, at + 1)
    spared = [(at, at + len(x) - 1) for x in exceptions for at in range(len(folded)) if folded.startswith(x, at)]
    return [h for h in found.values() if not any(a <= h[0] and h[1] - 1 <= b for a, b in spared)]


def plain_toxicity(rows, labels):
    folded = {k: plain_fold(t or "") for k, (_, t) in enumerate(rows)}
    truth = dict(labels)
    learn = [(truth[i], folded[k]) for k, (i, _) in enumerate(rows) if i in truth and not held_out(i)]
    apart = {}
    for y, x in learn:
        apart.setdefault((y, plain_family(x)), []).append(x)
    apart = {k: min(v, key=lambda s: s.encode()) for k, v in apart.items()}
    weights = plain_entries([x for (y, _), x in apart.items() if y == 1], [x for (y, _), x in apart.items() if y == 0])
    for word in map(plain_fold, KNOWN):
        if word not in weights and not {word[:k] for k in range(5, len(word))} & set(weights):
            weights[word] = 3.0
    exceptions = [plain_fold(x) for x in EXCEPTIONS]

    def measure(x):
        hits = plain_hits(x, weights, exceptions)
        total = sum(h[3] for h in hits)
        return (math.log1p(total), math.log1p(100 * total / (x.count(" ") + 20)), math.log1p(len({h[2] for h in hits}))) if hits else (0.0, 0.0, 0.0)

    x = np.array([[*(round(v, 2) for v in measure(t)), 1.0] for _, t in learn])
    y = np.array([a for a, _ in learn], float)
    prior = np.array([2.0, 1.0, 0.5, -4.0])
    w = prior.copy()
    for _ in range(400):  # Newton's method on the penalised likelihood, in short steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x + np.eye(4)
        w = w - 0.5 * np.linalg.solve(hessian, x.T @ (p - y) + (w - prior))
    score = lambda t: 1 / (1 + math.exp(-min(max(float(np.dot(w[:3], measure(t)) + w[3]), -30), 30)))
    return {k: score(folded[k]) for k in folded}, weights


def test_toxicity_equals_a_plain_version(spark):
    rows, labels = labelled(random.Random(12), 500, insult, "toxic")
    rows = [(i, t) for i, t, _ in rows]
    rows += [(2000 + k, t) for k, t in enumerate([None, "", "you iDi0t!", "a tra$h can, idiot proof", "z.o.r.g.l.i.n.g the", "Z O R G L I N G", "ｖｅｑｕｍｏ", "stüpid stone", "moron " * 3, "of the river"])] + [rows[3], (None, "idiot")]
    want, weights = plain_toxicity(rows, labels)
    got = classify_toxicity(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert any(w.startswith(" zorg") for w in weights) and len(got) == len(rows)
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in got) == sorted((str(i), round(want[k], 4)) for k, (i, _) in enumerate(rows))


# ---- quality ---------------------------------------------------------------------------------------------------


def plain_statistics(text):
    data = (text or "").encode()
    classes = [set(c.encode()) for c in BYTE_CLASSES]
    counts = [sum(b in c for b in data) for c in classes]
    counts.append(len(data) - sum(counts))
    words = [w for w in data.translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))).replace(b"\x0b", b" ").split() if w]
    lines = data.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    total, spread = max(len(data), 1), max(len(words), 1)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    top = max(Counter(words).values(), default=0)
    rest = [
        math.log1p(total), math.log1p(len(words)), math.log1p(total / spread), len(set(words)) / spread**0.9, top / spread, same / spread,
        pairs / spread, len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)), math.log1p(len(words) / (counts[5] + 1)),
    ]
    return np.float32([math.sqrt(c / total) for c in counts] + rest)


def spark_hash(values):
    """The hash of an array of floats as Spark has it."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<f", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_quality(rows, labels, folds=4, size=256):
    stats = {k: plain_statistics(t) for k, (_, t) in enumerate(rows)}
    truth = dict(labels)
    learn = [(truth[i], stats[k].astype(float), spark_hash(stats[k]) % folds) for k, (i, _) in enumerate(rows) if i in truth and not held_out(i)]
    x, y, fold = np.array([a[1] for a in learn]), np.array([a[0] for a in learn], float), np.array([a[2] for a in learn])
    mean, scale = x.mean(0), np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 1e-6))
    r = np.random.default_rng(7)
    projection, phase = r.normal(size=(len(STATISTICS), size)) / 6.0, r.uniform(0, 2 * np.pi, size)

    def features(v):
        z = np.clip((v - mean) / scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ projection + phase) * math.sqrt(2 / size)])

    def solve(z, t):
        return np.linalg.solve(z.T @ z + 0.1 * np.eye(size + 1), z.T @ t)

    z = features(x)
    whole = solve(z, y)
    bins: dict[int, list[float]] = {}
    for k in range(folds):
        w = solve(z[fold != k], y[fold != k])
        for raw, t in zip(z[fold == k] @ w, y[fold == k], strict=True):
            b = bins.setdefault(int(min(max(math.floor((raw + 0.5) / 2 * 512), 0), 511)), [0, 0])
            b[0] += t
            b[1] += 1
    # the isotonic fit: the largest mean of any block that ends here over the smallest that begins here
    places = sorted(bins)
    p, n = [bins[b][0] for b in places], [bins[b][1] for b in places]
    share = lambda i, j: sum(p[i : j + 1]) / sum(n[i : j + 1])
    fit = [max(min(share(i, j) for j in range(k, len(places))) for i in range(k + 1)) for k in range(len(places))]
    knots, heights = [], []
    for level in sorted(set(fit)):
        own = [k for k in range(len(places)) if fit[k] == level]
        knots.append(sum(((places[k] + 0.5) / 512 * 2 - 0.5) * n[k] for k in own) / sum(n[k] for k in own))
        heights.append(level)
    scores = np.interp(features(np.array([stats[k].astype(float) for k in stats])) @ whole, knots, heights)
    return dict(zip(stats, scores, strict=True))


def test_statistics_equal_plain_counts():
    import pyarrow as pa

    from marginalia.llm.bytetext import buffers

    texts = ["", "The the\nthe", "a" * 10, "x\n\nx\n", "Ünder é |||| 12, ok! a.b.c\tq", "one two one two one two\n" * 5, "\n", " ", "a  b\r\nc"]
    got = text_statistics(*buffers(pa.array(texts)))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-6)


def test_quality_equals_a_plain_version(spark):
    rows, labels = labelled(random.Random(11), 400, junk)
    rows = [(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (None, "river stone"), (2002, "line\nline\nother. Line"), rows[5][:2], (2003, "word " * 300_000)]
    want = plain_quality(rows, labels)
    got = classify_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in got) == sorted((str(i), round(float(want[k]), 3)) for k, (i, _) in enumerate(rows))


# ---- filters ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("keep,classify,name,spoil", [(keep_good, classify_quality, "quality", junk), (keep_clean, classify_toxicity, "toxic", insult)])
def test_filters_keep_whole_rows(spark, keep, classify, name, spoil):
    rows, labels = labelled(random.Random(13), 300, spoil, name)
    rows = [(i, t, 7, "flag") for i, t, _ in rows] + [(900, None, None, None), (901, "", 1, ""), (None, "river stone", 2, "x"), rows[2][:2] + (7, "flag")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string").repartition(3)
    table = spark.createDataFrame(labels, f"doc_id long, {name} int")
    good = Counter(str(r.doc_id) for r in classify(docs, table).collect() if r.predicted == (name == "quality"))
    kept = keep(docs, table)
    assert kept.columns == docs.columns and Counter(str(r.doc_id) for r in kept.collect()) == good and 0 < sum(good.values()) < len(rows)
    assert {tuple(r) for r in kept.collect()} <= set(rows)
    numbers = spark.createDataFrame([(1, 12), (2, None)], "doc_id long, text int")
    assert keep(numbers, table.where("doc_id < 0")).count() in (0, 2)
    assert keep(docs.where("doc_id = -1"), table).collect() == []
    assert quality.LIMIT and toxicity.LIMIT
