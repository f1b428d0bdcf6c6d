"""Toxicity (operator 1): a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes disguises: case, accents, full-width and look-alike letters of other scripts, digits and signs that
stand for letters, invisible characters. All else that isn't a letter becomes a space, so that a word's start
is a space in every pattern. A lexicon entry is a whole word or the stem that a word begins with; it is also
matched letter by letter with spaces between. Hits inside an exception phrase don't count.

Weights are log odds of an entry among labelled texts. Copies of a text aren't independent evidence: of
texts with the same smallest hash of a word pair, as near copies mostly are, one counts. What
the hits weigh, as such and by length, becomes a probability by logistic regression.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.bytetext import buffers, mix
from marginalia.llm.labelled import remainder, training_labels
from marginalia.llm.shared import Scratch, files, trim

#: Words known without any label, and phrases in which an entry means no harm.
KNOWN = ("idiot", "idiots", "moron", "morons", "scum", "scumbag", "stupid", "pathetic", "loser", "losers", "worthless", "disgusting", "imbecile", "dumbass", "retard", "asshole", "bastard", "bitch", "whore", "slut", "fuck", "fucking", "shit", "cunt", "faggot", "nigger")
KNOWN_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "idiot proof", "class clown", "rodeo clown", "sore loser rule")
#: Characters that stand for a letter; l and i look alike, so both are i.
DISGUISES = {"o": "0оοσ°", "i": "1lі|ι¡ӏ", "e": "3еєε€", "a": "4@аαá", "s": "5$ѕ§", "t": "7тτ+", "b": "8вβ", "g": "9ɡ", "c": "сϲ¢", "p": "рρ", "x": "хχ×", "y": "уγ", "k": "кκ", "m": "м", "h": "нһ", "n": "ηո", "u": "υսµ", "v": "ν", "d": "ԁ", "j": "ј", "w": "ѡ", "z": "ᴢ"}
#: Signs that are far more often themselves than letters.
_PLAIN_SIGNS = "|+$×°¢€§¡¿"
STEM, LONGEST = 4, 12
#: Texts to a file of those learned from.
TEXTS = 2048
#: Labelled texts of either class to learn from, at most.
LIMIT = 20_000
#: Share of toxic families that an entry must occur in, how many at least, and the odds it must have. The share bounds how many
#: patterns are looked for among the other texts: 1 / SUPPORT times as many as a toxic text has on average.
SUPPORT, LEAST_SUPPORT, ODDS = 0.004, 3, 20.0


@cache
def _fold_table() -> np.ndarray:
    """The folded code point of each code point: a small letter, a space, or 0 for nothing."""
    table = np.full(0x110000, ord(" "), np.uint32)
    table[0x20000:] = np.arange(0x20000, 0x110000)  # ideographs and what may follow
    for point in range(0x20000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        kind = unicodedata.category(char)
        if kind in ("Mn", "Me", "Cf"):
            table[point] = 0
        elif kind[0] == "L" or 0xFF00 < point < 0xFF5F or point in range(0x2460, 0x2500) or kind[0] == "N":
            plain = unicodedata.normalize("NFKD", char)[0].lower()[:1]
            if plain.isalpha():
                table[point] = ord(plain)
            elif plain.isdigit():
                table[point] = ord(plain)
    for letter, others in DISGUISES.items():
        for char in others:
            if char in _PLAIN_SIGNS:
                continue
            table[table == ord(char)] = ord(letter)
            table[ord(char)] = ord(letter)
    for digit in "26":
        table[table == ord(digit)] = ord(" ")
    return table


def fold(texts: list[str]) -> list[str]:
    """Folded texts, each between two spaces; within a word $ is an s, and runs of spaces are left."""
    joined = "\n".join(t.replace("\n", " ") for t in texts)
    if "$" in joined:
        joined = _dollars(joined)
    table = _fold_table()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 10
    out = table[points]
    out[ends] = 10
    return [f" {x} " for x in out[out != 0].astype("<u4").tobytes().decode("utf-32-le").split("\n")]


def folded_parts(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(first row, folded texts) of some rows at once, about ``size`` bytes; nulls are empty."""
    _, at = buffers(column)
    row, n = 0, len(column)
    while row < n:
        last = min(max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1), n)
        yield row, fold([t or "" for t in column.slice(row, last - row).to_pylist()])
        row = last


def _dollars(text: str) -> str:
    return re.sub(r"(?<=[^\W\d_])\$(?=[^\W\d_])", "s", text)


class Matcher:
    """Finds the entries of a lexicon in folded text."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        self.machine = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self._add(entry, ("hit", entry, weight, len(entry)))
            letters = entry.strip()
            if len(letters) >= STEM:
                self._add(" " + " ".join(letters) + " ", ("hit", entry, weight, 2 * len(letters)))
        for phrase in exceptions:
            self._add(phrase, ("not", phrase, 0.0, len(phrase)))
        self.empty = not len(self.machine)
        if not self.empty:
            self.machine.make_automaton()

    def _add(self, pattern: str, value: tuple) -> None:
        if pattern not in self.machine or value[0] == "hit":
            self.machine.add_word(pattern, value)

    def hits(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, end, entry, weight) of each hit outside of exceptions; at one start only the weightiest counts."""
        if self.empty:
            return []
        best: dict[int, tuple[int, int, str, float]] = {}
        spared = []
        for end, (kind, entry, weight, length) in self.machine.iter(folded):
            start = end + 1 - length
            if kind == "not":
                spared.append((start, end))
            elif start not in best or best[start][3] < weight:
                best[start] = (start, end, entry, weight)
        if spared:
            return [h for h in best.values() if not any(a <= h[0] and h[1] - 1 <= b for a, b in spared)]
        return list(best.values())


def patterns(folded: str) -> set[str]:
    """What a text could contribute to a lexicon: its words, " word ", and their stems, " stem"."""
    found = set()
    for word in set(folded.split()):
        if 3 <= len(word) <= 40:
            found.add(f" {word} ")
            found.update(f" {word[:k]}" for k in range(STEM, min(len(word), LONGEST) + 1))
    return found


def family(folded: str) -> int:
    """The same for most near copies: the smallest hash of a text's pairs of adjoining words."""
    words = folded.split() or [""]
    pairs = {zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:], strict=False)} or {zlib.crc32(words[0].encode())}
    return int(mix(np.fromiter(pairs, np.uint64, len(pairs))).min() >> np.uint64(1))


@dataclass
class Model:
    """Weights by entry, exception phrases, and the coefficients of the logistic regression."""

    weights: dict[str, float]
    exceptions: list[str]
    coefficients: np.ndarray


def measures(hits: list[tuple[int, int, str, float]], folded: str) -> tuple[float, float, float]:
    """What goes into the regression: total weight, weight by length, distinct entries; 0 without hits."""
    if not hits:
        return 0.0, 0.0, 0.0
    total = sum(h[3] for h in hits)
    words = folded.count(" ") + 20
    return float(np.log1p(total)), float(np.log1p(100 * total / words)), float(np.log1p(len({h[2] for h in hits})))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant last; a slight pull to the prior that hits speak for toxicity."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([2.0, 1.0, 0.5, -4.0])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(4), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose_entries(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of entries; ``counts``: families (toxic, clean) that have a pattern, of so many in all.

    Of a stem and what it goes on to, the longest that loses next to no support is taken.
    """
    least = max(LEAST_SUPPORT, SUPPORT * toxic)

    def odds(t: int, c: int) -> float:
        return (t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1))

    good = {p: (t, c) for p, (t, c) in counts.items() if t >= least and odds(t, c) >= ODDS}
    chosen: dict[str, float] = {}
    onward = defaultdict(list)
    for q in good:
        onward[q[:-1]].append(q)
    for p in sorted(good, key=lambda p: (len(p.rstrip()), p)):
        stem = p.rstrip()
        if any(stem[:k] in chosen for k in range(STEM + 1, len(stem) + 1)):
            continue
        while True:  # go on as long as one continuation has nearly all of the support
            longer = [q for q in onward[p] if good[q][0] >= 0.98 * good[p][0]]
            if not longer:
                break
            p = min(longer)
        if p not in chosen:
            chosen[p] = float(np.log(odds(*good[p])))
    return dict(sorted(chosen.items()))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, part in folded_parts(batch.column(1)):
            columns = [batch.column(0).slice(row, len(part)), pa.array([family(t) for t in part], pa.int64()), pa.array(part, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "family", "folded"])
    trim()


def _count_patterns(texts: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """``pattern, n``: in how many texts each pattern occurs; only those of ``among``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["pattern", "n"])

        for batch in batches:
            for folded in batch.column(0):
                own = patterns(folded.as_py())
                counts.update(own if among is None else own & among)
                if len(counts) > 500_000:
                    yield rows()
                    counts.clear()
        yield rows()
        counts.clear()
        trim()

    return texts.select("folded").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, folds: int, limit: int, known: Iterable[str] = KNOWN, exceptions: Iterable[str] = EXCEPTIONS) -> Model:
    """A model of at most ``limit`` labelled texts of either class; the known words alone where there are none."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    sample = scratch.save(training_labels(labels, label, key=key, folds=folds, limit=limit), "sample")
    texts = docs.where(F.col(key).isNotNull()).join(F.broadcast(sample), key).select("label", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))  # 2 * limit keys at most
    rows = min(sample.count(), 2 * limit)
    texts = texts.repartition(max(files(rows, TEXTS), min(rows, spark.sparkContext.defaultParallelism)))
    texts = scratch.save(texts.mapInArrow(_folded, "label int, family long, folded string"), "texts")
    # one text of each family of copies
    apart = scratch.save(texts.groupBy("label", "family").agg(F.min("folded").alias("folded")), "families", rows, TEXTS)
    sizes = {r["label"]: r["n"] for r in apart.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    weights: dict[str, float] = {}
    if toxic and clean:
        least = max(LEAST_SUPPORT, SUPPORT * toxic)
        common = _count_patterns(apart.where("label = 1"), None).where(F.col("n") >= least)
        found = {r["pattern"]: r["n"] for r in common.collect()}  # bounded by limit and SUPPORT
        among = {r["pattern"]: r["n"] for r in _count_patterns(apart.where("label = 0"), frozenset(found)).collect()}  # no more
        weights = choose_entries({p: (n, among.get(p, 0)) for p, n in found.items()}, toxic, clean)
    for word in fold(list(known)):
        stems = {word[:k] for k in range(STEM + 1, len(word))}
        if word not in weights and not stems & set(weights):
            weights[word] = KNOWN_WEIGHT
    spared = [x for x in fold(list(exceptions))]
    model = Model(weights, spared, np.array([2.0, 1.0, 0.5, -4.0]))
    matcher = Matcher(weights, spared)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Counter()
            for y, folded in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = folded.as_py()
                rows[y, *(round(v, 2) for v in measures(matcher.hits(t), t))] += 1
            columns = list(zip(*[(*k, n) for k, n in rows.items()], strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["label", "x", "y", "z", "n"])

    rows = texts.select("label", "folded").mapInArrow(measure, "label int, x double, y double, z double, n long").collect()  # 2 * limit rows at most
    if len({r["label"] for r in rows}) == 2:
        x = np.repeat(np.array([[r["x"], r["y"], r["z"]] for r in rows]), [r["n"] for r in rows], 0)
        model.coefficients = logistic(x, np.repeat(np.array([r["label"] for r in rows], float), [r["n"] for r in rows]))
    return model


def score_parts(column: pa.Array, model: Model, matcher: Matcher) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(first row, (probability, number of hits) of each text) of some rows at once."""
    for row, part in folded_parts(column):
        out = []
        for folded in part:
            hits = matcher.hits(folded)
            z = float(np.dot(model.coefficients[:3], measures(hits, folded)) + model.coefficients[3])
            out.append((1 / (1 + float(np.exp(-min(max(z, -30), 30)))), len(hits)))
        yield row, out


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, threshold: float = 0.5, limit: int = LIMIT) -> DataFrame:
    """``key, held_out boolean, score double, predicted int, n_hits int`` of each row.

    Learns from ``labels`` (key, label 0 or 1) whose key's crc32 modulo ``folds`` isn't 0, from at most ``limit`` rows of
    either class; the text is the only input of a score. ``score`` is the probability of label 1, for any text; a
    null text counts as empty. Null keys and repeated rows are scored like others; other columns are left out, so
    clashing names do no harm. Without labels the known words alone count. One narrow pass over all whole texts.
    """
    model = learn(docs, labels, key=key, text=text, label=label, folds=folds, limit=limit)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.weights, model.exceptions)
        for batch in batches:
            for row, found in score_parts(batch.column(1), model, matcher):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())], schema.names)
        trim()

    out = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)
    return out.select(key, (remainder(key, folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_hits")


def keep_clean(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, threshold: float = 0.5, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score (see ``classify_toxicity``) is below ``threshold``.

    A null text counts as empty; null keys and repeated rows are judged like others; any columns may stand beside, and a text column
    of another type is read as text. An empty table gives none. Only texts go to Python, and only a flag comes back.
    """
    model = learn(docs, labels, key=key, text=text, label=label, folds=folds, limit=limit)
    matchers: list[Matcher] = []

    @F.arrow_udf(T.BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        if not matchers:
            matchers.append(Matcher(model.weights, model.exceptions))
        flags = pa.array([f[0] < threshold for _, found in score_parts(texts, model, matchers[0]) for f in found], pa.bool_())
        trim()
        return flags

    return docs.where(clean(F.col(text).cast("string")))
