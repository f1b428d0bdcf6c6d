"""Quality classifier (operator 9): random Fourier features, ridge normal equations, isotonic calibration.

Each text becomes a few statistics of its bytes, words and lines. Cosines of random projections approximate
a Gaussian kernel over them. Every task sums the normal equations of its labelled rows, the sums are added,
and the driver solves one small system. Scores of folds that a model hasn't seen are made monotone by pooling
adjacent violators over a bounded histogram, which turns a score into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.bytetext import PIECE, buffers, pieces, range_hashes, row_words
from marginalia.llm.labelled import remainder, training_labels
from marginalia.llm.shared import Scratch, trim

#: Classes of bytes whose shares are statistics.
BYTE_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",", "!?", "|", "#$%&*+=~^", "<>{}[]()\\/@_", "'\"-:;")
STATISTICS = (
    *(f"share of {x}" for x in ("lower", "upper", "digits", "blanks", "line ends", "stops", "commas", "marks", "bars", "symbols", "brackets", "quotes", "other bytes")),
    "log bytes", "log words", "bytes to a word", "distinct words", "share of the commonest word", "words like the one before",
    "distinct word pairs", "distinct lines", "words to a line", "words to a stop",
)
#: Random features, their width in standard deviations, the ridge, and folds for calibration.
FEATURES, WIDTH, RIDGE, FOLDS = 256, 6.0, 0.1, 4
#: Labelled rows of either class that are learned from at most, rows to a task, and bins of scores.
LIMIT, TASK_ROWS, BINS = 50_000, 20_000, 512

_CLASS = np.full(256, len(BYTE_CLASSES), np.int64)
for _i, _chars in enumerate(BYTE_CLASSES):
    _CLASS[list(_chars.encode())] = _i
_KINDS = len(BYTE_CLASSES) + 1


def _run_lengths(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(sorted_values)))


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often the commonest occurs; 40 bits tell values apart."""
    packed = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    start, length = _run_lengths(packed)
    owner = (packed[start] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, length)
    return np.bincount(owner, minlength=n), top


def _long_lines(row: np.ndarray) -> tuple[int, int]:
    """Lines of one long text, and how many distinct ones by 40 bits of their hashes; some lines at once."""
    ends = np.flatnonzero(row == 10) + 1
    start = np.append(0, ends)
    start = start[start < len(row)]
    stop = np.append(start[1:], len(row))
    found, i = np.zeros(0, np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + PIECE, "right")))
        a, b = start[i], stop[j - 1]
        found = np.union1d(found, range_hashes(row[a:b], start[i:j] - a, stop[i:j] - a) >> np.uint64(24))
        i = j
    return len(start), len(found)


def text_statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; finite for any text, the empty one included."""
    n = len(at) - 1
    counts = np.zeros((n, _KINDS), np.int64)
    lines, kinds = np.ones(n, np.int64), np.ones(n, np.int64)
    for i in np.flatnonzero(np.diff(at) > PIECE).tolist():
        lines[i], kinds[i] = _long_lines(raw[at[i] : at[i + 1]])
    for part, where, first in pieces(raw, at):
        size = np.diff(where)
        rows = np.repeat(np.arange(len(size)), size)
        counts[first : first + len(size)] += np.bincount(rows * _KINDS + _CLASS[part], minlength=len(size) * _KINDS).reshape(-1, _KINDS)
        if at[first + 1] - at[first] > PIECE:  # a part of a long text
            continue
        head = np.zeros(len(part) + 1, bool)
        head[where[:-1]] = True
        head[1:] |= part == 10
        start = np.flatnonzero(head[: len(part)])
        owner = np.searchsorted(where, start, "right") - 1
        found, _ = _distinct(owner, range_hashes(part, start, np.append(start[1:], len(part))), len(size))
        some = size > 0
        lines[first : first + len(size)][some] = np.bincount(owner, minlength=len(size))[some]
        kinds[first : first + len(size)][some] = found[some]
    words, distinct, top, same, pairs = (np.zeros(n) for _ in range(5))
    for first, bounds, hashes in row_words(raw, at):
        k = len(bounds) - 1
        size = np.diff(bounds)
        rows = np.repeat(np.arange(k), size)
        words[first : first + k] = size
        distinct[first : first + k], top[first : first + k] = _distinct(rows, hashes, k)
        if len(hashes) > 1:
            own = rows[1:] == rows[:-1]
            same[first : first + k] = np.bincount(rows[1:][own & (hashes[1:] == hashes[:-1])], minlength=k)
            both = hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1]
            pairs[first : first + k] = _distinct(rows[1:][own], (both * np.uint64(0xD6E8FEB86659FD93))[own], k)[0]
    total = np.maximum(counts.sum(1), 1)
    spread = np.maximum(words, 1)
    out = np.empty((n, len(STATISTICS)))
    out[:, :_KINDS] = np.sqrt(counts / total[:, None])
    out[:, _KINDS:] = np.stack(
        [
            np.log1p(total), np.log1p(words), np.log1p(total / spread), distinct / spread**0.9, top / spread, same / spread,
            pairs / spread, kinds / lines, np.log1p(words / lines), np.log1p(words / (counts[:, 5] + 1)),
        ],
        1,
    )
    return out


def in_parts(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, statistics) of some texts at once, whatever the batch."""
    row, n = 0, len(at) - 1
    while row < n:
        last = min(max(row + 1, int(np.searchsorted(at, at[row] + 2 * PIECE, "right")) - 1), n)
        yield row, text_statistics(raw[at[row] : at[last]], at[row : last + 1] - at[row])
        row = last


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Model:
    """Everything a score needs; of bounded size."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / self.projection.shape[1])
        return np.hstack([np.ones((len(z), 1)), waves])

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.features(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        return np.interp(self.raw(statistics), self.knots, self.values)


def pool_adjacent(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit of shares over bins: block centres and their shares, which never fall."""
    blocks: list[list[float]] = []  # weighted x, positives, rows
    for a, p, n in zip(x.tolist(), positive.tolist(), total.tolist(), strict=True):
        blocks.append([a * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _sum_equations(rows: DataFrame, model: Model) -> list[np.ndarray]:
    """The normal equations of each fold: features x features, and features x label in the last column."""
    size = model.projection.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size, size + 1))
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            y, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                sums[k] += own.T @ np.hstack([own, y[fold == k][:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FOLDS), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], ["fold", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table([table.column("fold")[:1], pa.array([total.tobytes()], pa.binary())], names=["fold", "sums"])

    found = rows.select("statistics", "label", "fold").mapInArrow(run, "fold int, sums binary").groupBy("fold").applyInArrow(add, "fold int, sums binary").collect()
    out = [np.zeros((size, size + 1)) for _ in range(FOLDS)]
    for r in found:  # one row per fold
        out[r["fold"]] = np.frombuffer(bytes(r["sums"]), np.float64).reshape(size, size + 1)
    return out


def _solve(equations: np.ndarray) -> np.ndarray:
    square = equations[:, :-1] + RIDGE * np.eye(len(equations))
    return np.linalg.solve(square, equations[:, -1])


def fit(rows: DataFrame, *, seed: int = 7) -> Model | None:
    """A model of ``statistics, label, fold`` rows; None unless both labels occur."""
    k = len(STATISTICS)
    sums = [F.sum(F.col("statistics")[i].cast("double")) for i in range(k)] + [F.sum(F.pow(F.col("statistics")[i].cast("double"), 2)) for i in range(k)]
    first = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *sums).first()
    n, ones = first[0], first[1] or 0
    if not 0 < ones < n:
        return None
    mean = np.array(first[2 : 2 + k]) / n
    scale = np.sqrt(np.maximum(np.array(first[2 + k :]) / n - mean**2, 1e-6))
    random = np.random.default_rng(seed)
    model = Model(mean, scale, random.normal(size=(k, FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    equations = _sum_equations(rows, model)
    whole = sum(equations)
    model.weights = _solve(whole)
    unseen = [_solve(whole - e) for e in equations]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = model.features(_matrix(batch.column(0))), batch.column(2).to_numpy()
            raw = np.einsum("ij,ij->i", z, np.array(unseen)[fold])
            bins = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "label"])

    table = rows.select("statistics", "label", "fold").mapInArrow(run, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n"))
    found = np.array(sorted(tuple(r) for r in table.collect()), np.float64)  # at most BINS rows
    centre = (found[:, 0] + 0.5) / BINS * 2 - 0.5
    model.knots, model.values = pool_adjacent(centre, found[:, 1], found[:, 2])
    return model


def learn(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, folds: int, limit: int) -> Model:
    """A model of at most ``limit`` labelled texts of either class.

    Without texts of both classes, every score is the share of ones, or 0.5.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    known = scratch.save(training_labels(labels, label, key=key, folds=folds, limit=limit), "labels")
    schema = "label int, statistics array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in in_parts(*buffers(batch.column(1))):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(STATISTICS), pa.int32()), pa.array(found.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), lists], ["label", "statistics"])
        trim()

    texts = docs.where(F.col(key).isNotNull()).join(F.broadcast(known), key)  # 2 * limit keys at most
    rows = texts.select("label", F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    rows = scratch.save(rows.withColumn("fold", F.pmod(F.xxhash64("statistics"), F.lit(FOLDS)).cast("int")), "rows")
    rows = rows.coalesce(max(1, -(-rows.count() // TASK_ROWS)))
    share = rows.agg(F.avg("label")).first()[0]
    return fit(rows) or constant(0.5 if share is None else float(share))


def constant(score: float) -> Model:
    k = len(STATISTICS)
    return Model(np.zeros(k), np.ones(k), np.zeros((k, 1)), np.zeros(1), np.zeros(2), np.zeros(1), np.array([score]))


def score_column(column: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1 of each text of a column."""
    parts = [model.score(x.astype(np.float32).astype(np.float64)) for _, x in in_parts(*buffers(column))]
    return np.concatenate(parts) if parts else np.zeros(0)


def classify_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = 0.3, limit: int = LIMIT) -> DataFrame:
    """``key, held_out boolean, score double, predicted int`` of each row.

    Learns from ``labels`` (key, label 0 or 1) whose key's crc32 modulo ``folds`` isn't 0, from at most ``limit`` rows of
    either class. Inputs are the statistics of the text alone. ``score`` is the probability of label 1, for any
    text; a null text counts as empty. Without rows of both labels every score is the share of ones, or 0.5.
    Null keys and repeated rows are scored like others; other columns are left out, so clashing names do no harm.
    One narrow pass over all whole texts, and one over the labelled ones; texts aren't shuffled.
    """
    model = learn(docs, labels, key=key, text=text, label=label, folds=folds, limit=limit)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_column(batch.column(1), model))], schema.names)
        trim()

    out = docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return out.select(key, (remainder(key, folds) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, threshold: float = 0.3, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score (see ``classify_quality``) is ``threshold`` or more.

    A null text counts as empty; null keys and repeated rows are judged like others; any columns may stand beside, and a text column
    of another type is read as text. An empty table gives none. Only texts go to Python, and only a flag comes back.
    """
    model = learn(docs, labels, key=key, text=text, label=label, folds=folds, limit=limit)

    @F.arrow_udf(T.BooleanType())
    def good(texts: pa.Array) -> pa.Array:
        flags = pa.array(score_column(texts, model) >= threshold)
        trim()
        return flags

    return docs.where(good(F.col(text).cast("string")))
