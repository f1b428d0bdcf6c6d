"""Best-fit packing (operator 5) by linear grouping.

Only the histogram of piece lengths, at most ``capacity`` numbers, goes to the driver. There, large lengths
are split into groups of equal cardinality and rounded up to their group's largest; configurations of these
few sizes are optimised, by a linear programme with generated columns where they are few; the actual lengths, which are no larger, take their slots; small lengths are then
best-fitted into what is left. The outcome is a bounded list of runs, which the executors look up by
a piece's rank among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.bytetext import buffers
from marginalia.llm.fragment_bpe import encoder
from marginalia.llm.shared import Scratch, trim

#: Numbers of groups of equal cardinality, and shares of the capacity above which a length is large, to try; the plan
#: with the fewest sequences is taken.
GROUPS, SHARES = (4, 8, 16, 32, 64, 128), (2, 3, 4)
#: Up to so many sizes configurations are optimised together; among more the fullest are taken one by one.
FEW = 16


@dataclass
class Plan:
    """Runs of equal lengths in consecutive sequences, by length and rank.

    Run i holds ``per_bin[i]`` pieces of ``length[i]`` in each of consecutive sequences from ``first_bin[i]``
    on, the first of them at ``offset[i]``; ``first_rank[i]`` is the rank of its first piece.
    """

    length: np.ndarray
    first_rank: np.ndarray
    first_bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        i = np.searchsorted((self.length << 40) + self.first_rank, (length << 40) + rank, "right") - 1
        within = rank - self.first_rank[i]
        return self.first_bin[i] + within // self.per_bin[i], self.offset[i] + within % self.per_bin[i] * length


class _Planner:
    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.ranks: dict[int, int] = {}
        self.room: dict[int, list[tuple[int, int]]] = {}  # by what is left: (first bin, bins)
        self.rooms: list[int] = []

    def put(self, length: int, first: int, bins: int, per_bin: int, offset: int) -> None:
        rank = self.ranks.get(length, 0)
        self.runs.append((length, rank, first, per_bin, offset))
        self.ranks[length] = rank + bins * per_bin

    def leave(self, left: int, first: int, bins: int) -> None:
        if left and bins:
            if left not in self.room:
                self.room[left] = []
                insort(self.rooms, left)
            self.room[left].append((first, bins))

    def fit(self, length: int, count: int) -> None:
        """Best fit of ``count`` pieces: always where the least is left that holds one."""
        while count:
            i = bisect_left(self.rooms, length)
            if i < len(self.rooms):
                left = self.rooms[i]
                first, bins = self.room[left].pop()
                if not self.room[left]:
                    del self.room[left], self.rooms[i]
            else:
                left, first = self.capacity, self.bins
                bins = -(-count // (self.capacity // length))
                self.bins += bins
            per_bin = left // length
            offset = self.capacity - left
            full = min(bins, count // per_bin)
            if full:
                self.put(length, first, full, per_bin, offset)
                self.leave(left - per_bin * length, first, full)
                count -= full * per_bin
            if full < bins:
                if count and count < per_bin:
                    self.put(length, first + full, 1, count, offset)
                    self.leave(left - count * length, first + full, 1)
                    full, count = full + 1, 0
                self.leave(left, first + full, bins - full)


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """(indices of sizes, how often), until all are used up; sizes descend.

    Each is the fullest one that holds the largest size left, found by a reachability table over sums.
    """
    counts = list(counts)
    for i, size in enumerate(sizes):
        while counts[i]:
            best: dict[int, tuple[int, ...]] = {size: (i,)}
            for j in range(i, len(sizes)):
                for total, chosen in sorted(best.items()):
                    taken = chosen.count(j)
                    total, chosen = total + sizes[j], (*chosen, j)
                    while total <= capacity and taken < counts[j]:
                        if total not in best:
                            best[total] = chosen
                        total, chosen, taken = total + sizes[j], (*chosen, j), taken + 1
            chosen = best[max(best)]
            times = min(counts[k] // chosen.count(k) for k in set(chosen))
            for k in chosen:
                counts[k] -= times
            yield list(chosen), times


def _optimised(sizes: list[int], counts: list[int], capacity: int, most: int) -> Iterator[tuple[list[int], int]]:
    """As ``_configurations``, but chosen together: the fewest sequences if a configuration may be used in part, by generated columns.

    The simplex method starts from sequences of one size each. Prices of the sizes say which configuration of up to ``most`` pieces would
    help most; it enters until none does. Whole numbers of the configurations are taken, and what is left goes to the fullest ones.
    """
    g = len(sizes)
    basis = np.zeros((g, g))
    np.fill_diagonal(basis, [min(most, capacity // x) for x in sizes])
    wanted = np.array(counts, float)
    for _ in range(20 * g):
        inverse = np.linalg.inv(basis)
        used, price = inverse @ wanted, inverse.T @ np.ones(g)
        column = _best_column(sizes, price, capacity, most)
        if price @ column <= 1 + 1e-9:
            break
        change = inverse @ column
        can = change > 1e-12
        leaves = int(np.argmin(np.where(can, used / np.where(can, change, 1), np.inf)))
        basis[:, leaves] = column
    left = list(counts)
    for column, times in zip(basis.T.astype(int).tolist(), np.floor(np.linalg.solve(basis, wanted) + 1e-9).astype(int).tolist(), strict=True):
        times = min([times, *(left[k] // n for k, n in enumerate(column) if n)])
        if times > 0:
            left = [a - times * n for a, n in zip(left, column, strict=True)]
            yield [k for k, n in enumerate(column) for _ in range(n)], times
    yield from _configurations(sizes, left, capacity)


def _best_column(sizes: list[int], price: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """The configuration of at most ``most`` pieces with the highest price, as a number of each size; by one more piece at a time."""
    room = np.arange(capacity + 1)
    best, taken = np.zeros(capacity + 1), []
    for _ in range(most):
        more = np.stack([np.where(room >= x, p + best[np.maximum(room - x, 0)], -np.inf) for x, p in zip(sizes, price, strict=True)])
        which = more.argmax(0)
        better = more[which, room] > best + 1e-12
        taken.append(np.where(better, which, -1))
        best = np.where(better, more[which, room], best)
    column, at = np.zeros(len(sizes)), capacity
    for layer in reversed(taken):
        if layer[at] >= 0:
            column[layer[at]] += 1
            at -= sizes[layer[at]]
    return column


def plan_packing(histogram: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS, shares: tuple[int, ...] = SHARES) -> Plan:
    """Where pieces go, by length and rank, in as few sequences as found; lengths are 1..capacity."""
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    return min((_grouped_plan(histogram, capacity, g, s) for s in shares for g in groups), key=lambda plan: plan.bins)


def _grouped_plan(histogram: dict[int, int], capacity: int, groups: int, share_of: int) -> Plan:
    planner = _Planner(capacity)
    if whole := histogram.get(capacity, 0):
        planner.put(capacity, 0, whole, 1, 0)
        planner.bins = whole
    large = [(x, n) for x, n in sorted(histogram.items(), reverse=True) if capacity // share_of < x < capacity and n]
    total = sum(n for _, n in large)
    share = max(1, -(-total // groups))
    members: list[list[list[int]]] = []  # by group: [length, count], lengths descend
    room = 0
    for x, n in large:
        while n:
            if not room:
                members.append([])
                room = share
            taken = min(n, room)
            members[-1].append([x, taken])
            n, room = n - taken, room - taken
    sizes = [m[0][0] for m in members]
    numbers = [sum(n for _, n in m) for m in members]
    chosen_ones = _optimised(sizes, numbers, capacity, share_of) if sizes and groups <= FEW else _configurations(sizes, numbers, capacity)
    for chosen, times in chosen_ones:
        while times:  # substitute actual lengths, as long as none of the slots changes its length
            tops = [members[k][0] for k in chosen]
            n = min([times, *(members[k][0][1] // chosen.count(k) for k in chosen)])
            if n:
                lengths = [t[0] for t in tops]
                for k in chosen:
                    members[k][0][1] -= n
            else:  # a group's length runs out within one sequence
                n, lengths = 1, []
                for k in chosen:
                    members[k] = [m for m in members[k] if m[1]]
                    lengths.append(members[k][0][0])
                    members[k][0][1] -= 1
            for k in set(chosen):
                members[k] = [m for m in members[k] if m[1]]
            offset = 0
            for x in lengths:
                planner.put(x, planner.bins, n, 1, offset)
                offset += x
            planner.leave(capacity - offset, planner.bins, n)
            planner.bins += n
            times -= n
    for x, n in sorted(histogram.items(), reverse=True):
        if x <= capacity // share_of and n:
            planner.fit(x, n)
    runs = np.array(sorted(planner.runs), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(c) for c in runs.T), planner.bins)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, *, end_id: int, key: str, text: str, with_ids: bool) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for row, ids, bounds in bpe.encode_batch(raw, at):
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                total = np.diff(bounds)
                n = -(-total // capacity)
                rows = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                first = (total - (n - 1) * capacity)[rows]
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                begin = bounds[:-1][rows] + start
                view = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(view[a:b]) for a, b in zip((begin * 4).tolist(), ((begin + length) * 4).tolist(), strict=True)]
                out = [batch.column(0).slice(row, len(n)).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds_of(begin, length), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])
        trim()

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, T.StructType(fields))


def bounds_of(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Offsets of adjoining ranges."""
    return np.append(begin, begin[-1] + length[-1]) if len(begin) else np.zeros(1, np.int64)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document is its token ids and ``end_id``; only one longer than ``capacity`` is cut, its first piece
    may be shorter. Returns per piece ``key, piece, start, length, ids_crc32, sequence_id, offset`` and, if
    asked for, ``ids``. A null text counts as empty: one piece of one id. Null keys and repeated rows are packed
    like others; other columns are left out, so clashing names do no harm. An empty table gives none.

    The pieces are written once to the shared folder; to the driver go at most ``capacity`` counts. Ranks among
    equal lengths come from salted counts, so that a length that many documents share is no hot key.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = cut_pieces(docs, tokenizer, capacity, end_id=end_id, key=key, text=text, with_ids=with_ids)
    pieces = scratch.save(pieces.withColumn("spread", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    ranked = _ranked(pieces, counts)
    fields = [f for f in pieces.schema.fields if f.name not in ("ids", "spread")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    fields += [f for f in pieces.schema.fields if f.name == "ids"]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            bins, offset = plan.place(columns["length"].to_numpy(), columns["rank"].to_numpy())
            columns |= {"sequence_id": pa.array(bins, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema.names)

    return ranked.mapInArrow(run, schema)


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank``: from 0, among the pieces of the same length, in the order of ``spread``, a number of the written row."""
    spark = pieces.sparkSession
    share = max(200, sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = spark.createDataFrame([(x, -(-n // share)) for x, n in counts.items()], "length long, salts int")  # as many rows as lengths, at most
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("spread"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("spread"))
    return salted.withColumn("local", local).join(offsets, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("local") - 1).drop("base", "local", "salt")
