import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import quality, toxicity
from marginalia.llm.bytetext import buffers
from marginalia.llm.quality import STATISTICS, classify_quality, pool_adjacent, text_statistics
from marginalia.llm.toxicity import Matcher, choose_entries, classify_toxicity, fold

WORDS = ["the", "of", "river", "stone", "market", "paper", "winter", "garden", "number", "letter", "window", "summer"]


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def labelled(r, n, spoil, key="quality"):
    rows, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        text = prose(r, r.randint(5, 120))
        rows.append((i, spoil(r, text) if bad else text, 1.5))
        labels.append((i, int(not bad) if key == "quality" else int(bad)))
    return rows, labels


def junk(r, text):
    kind = r.randrange(3)
    return text.upper().replace(" ", "!! ") if kind == 0 else " ".join(w for w in text.split()[:4] for _ in range(20)) if kind == 1 else text.replace(" ", " | ")


ODD = [(2900, None, 0.0), (2901, "", 0.0), (None, "river stone", 0.0), (2902, "x" * 3_000_000, 0.0), (2903, "word " * 500_000, 0.0), (5, "the of", 0.0), (5, "the of", 0.0)]


def test_quality_is_learned(spark):
    rows, labels = labelled(random.Random(1), 1200, junk)
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string, score double").repartition(3)
    truth = dict(labels)
    table = spark.createDataFrame([*labels, (5, None), (None, 1), labels[0]], "doc_id long, quality int")
    got = classify_quality(docs, table).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    again = {(str(r.doc_id), r.score) for r in classify_quality(docs.repartition(5), table).collect()}
    assert max(abs(dict(again)[str(r.doc_id)] - r.score) for r in got if r.doc_id != 5) < 1e-6


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1), (3, 1), (4, 1)]])
def test_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(i, "a b") for i in range(4)], "doc_id long, text string")
    for run, name in ((classify_quality, "quality"), (classify_toxicity, "toxic")):
        got = run(docs, spark.createDataFrame(labels, f"doc_id long, {name} int")).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert classify_quality(empty, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
    assert classify_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_statistics_are_counted():
    raw, at = buffers(pa.array(["", "The the\nthe", None, "a" * 10]))
    x = dict(zip(STATISTICS, text_statistics(raw, at).T, strict=True))
    assert np.isfinite(text_statistics(raw, at)).all()
    assert x["words like the one before"].tolist() == pytest.approx([0, 2 / 3, 0, 0])
    assert x["share of upper"][1] == pytest.approx((1 / 11) ** 0.5) and x["share of lower"][3] == 1
    assert x["share of the commonest word"].tolist() == pytest.approx([0, 1, 0, 1])


def test_statistics_do_not_depend_on_the_batch(monkeypatch):
    r = random.Random(3)
    texts = [prose(r, r.randint(0, 300)) for _ in range(30)]
    whole = text_statistics(*buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(text_statistics(*buffers(pa.array([t]))), whole[i])


@pytest.mark.parametrize("tail", ["", "the end", "\n"])
def test_lines_of_long_texts_are_counted_over_all_parts(tail):
    r = random.Random(4)
    wide = "wide line " * 150_000 + "\n"  # longer than a part
    some = [prose(r, 20) + "\n" for _ in range(3000)]
    texts = ["short\ntext\nshort\n", "".join(some * 10) + tail, wide * 2 + "a\n" + wide + "wide line\n" + tail, "same line here\n" * 200_000 + tail, "x y"]
    x = dict(zip(STATISTICS, text_statistics(*buffers(pa.array(texts))).T, strict=True))
    lines = [t.removesuffix("\n").split("\n") for t in texts]
    ends = [[a + "\n" for a in own[:-1]] + [own[-1] + "\n" * t.endswith("\n")] for own, t in zip(lines, texts, strict=True)]
    assert x["distinct lines"].tolist() == pytest.approx([len(set(own)) / len(own) for own in ends])
    assert x["words to a line"].tolist() == pytest.approx([np.log1p(len(t.split()) / len(own)) for own, t in zip(ends, texts, strict=True)])


def test_isotonic_fit():
    x, y = pool_adjacent(np.arange(5.0), np.array([1, 0, 2, 1, 4.0]), np.array([2, 2, 4, 2, 4.0]))
    assert np.allclose(y, [0.25, 0.5, 1.0]) and np.allclose(x, [0.5, (2 * 4 + 3 * 2) / 6, 4])
    assert quality.BINS > 1


def insult(r, text):
    words = text.split()
    for _ in range(r.randint(1, 3)):
        words.insert(r.randrange(len(words) + 1), r.choice(["zorgling", "blertish", "vequmo", "vequta", "vequry"]))
    return " ".join(words)


def test_toxicity_is_learned(spark):
    rows, labels = labelled(random.Random(2), 1200, insult, "toxic")
    docs = spark.createDataFrame(rows + ODD + [(2910, "the Z0RGL1NG of", 0.0), (2911, "river v3qu-something vequnew", 0.0), (2912, "you іdіot", 0.0)], "doc_id long, text string, score double")
    truth = dict(labels)
    got = classify_toxicity(docs.repartition(3), spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in got}
    assert by[2910].predicted == by[2911].predicted == by[2912].predicted == 1
    assert by[2900].score == by[2901].score < 0.5 and all(0 <= r.score <= 1 for r in got)


def test_folding():
    assert fold(["Stüp1d!", "ＳＣＵＭ", "mоrоn", "id​iot", "l0ser", "a\nb", ""]) == [" stupid  ", " scum ", " moron ", " idiot ", " ioser ", " a b ", "  "]


def test_hits_and_exceptions():
    exceptions = fold(["trash can"])
    m = Matcher({" trash ": 2.0, " vequ": 1.0}, exceptions)
    find = lambda t: [h[2] for h in m.hits(fold([t])[0])]
    assert find("trash") == [" trash "] and find("Trash, trash") == [" trash "] * 2
    assert find("the trash can is") == [] and find("trashy") == [] and find("trash can of trash") == [" trash "]
    assert find("vequry") == [" vequ"] and find("avequ") == [] and find("t.r.a.s.h") == [" trash "]
    assert Matcher({}).hits(" a ") == []


def test_entries_are_the_longest_stems_that_keep_their_support():
    counts = {" vequ": (50, 0), " vequm": (20, 0), " vequt": (28, 0), " zorg": (40, 0), " zorgl": (40, 0), " zorgl ": (39, 1), " river ": (90, 800), " rare ": (1, 0)}
    assert set(choose_entries(counts, 100, 1000)) == {" vequ", " zorgl"}
    assert toxicity.ODDS > 1
