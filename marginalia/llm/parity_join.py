"""N-gram Jaccard join (operator 4) by parity sketches.

A set of word shingles is hashed into the cells of a sketch; a cell holds the parity, bit by bit, of
its shingles' 64-bit hashes (their XOR). One shingle changes one cell, so the number of cells in which two sketches
differ is a lower bound of the sets' symmetric difference. A Jaccard similarity of 0.75 or more bounds that
difference by a seventh of the two sizes, so that by the pigeonhole principle similar sets of a size band agree in
at least so many cells, of which at least ``t`` aren't empty:

    t = cells - bound of the difference - empty cells

Sketches are joined on (band, cell, content). Only sets that share at least t cells with others go on; sets for
which t isn't positive are joined with each other on a plain prefix of shingles, too. Nothing is lost, and what
many texts share (a passage, a footer) brings nobody further unless it makes up much of a text.

The few sets that go on are joined again at the finest resolution, a cell for each shingle. Cells are ordered from the
rarest on; sets of sizes n and m that are similar share 3/7 (n + m) cells, so that one of them is among the first of
either, and what stands before it bounds what they can share. Each pair meets in the smaller set's class of sizes.

Candidates are verified exactly, by the intersection of the sets. Within a cell's sets only what could still
change the components is compared: first each with the cell's most central set, then, between different
components, all whose sketches of SKETCH bits, again by parity, don't differ in more bits than similar sets can.

No cell is hot: a task sends a cell that several of its sets have only once, and counts it for these sets by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.bytetext import buffers, mix, pack_sorted, row_words, unpack_sorted
from marginalia.llm.components import connected_components
from marginalia.llm.shared import Scratch, files, trim

#: Words to a shingle. Similarity is at least LEAST / 100.
WORDS, LEAST = 5, 75
#: Bytes of text to a bucket of sketch cells, and cells that a task holds before it hands them on.
BUCKET_BYTES, HELD_CELLS = 8 << 20, 1 << 19
#: Ratio of the sizes of adjoining classes.
CLASS = 1.08
#: Members of a group that are verified together, and sets of a cell that are compared with each other in one task; more are split.
GROUP, MEET = 256, 1024
#: Pairs and texts to a file; bits of a set's sketch.
PAIRS, TEXTS, SKETCH = 4096, 4096, 256
#: Bits of the filter that finds the texts to verify; its table has at most FILTER_BITS / 64 rows.
FILTER_BITS = 1 << 25

_PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its shingles); a shorter text is one shingle as a whole, one without words has none."""
    for first, bounds, words in row_words(raw, at):
        n = len(words) - WORDS + 1
        runs = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for k in range(WORDS):
                runs += words[k : k + n] * _PLACES[k]
            runs = mix(runs)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b - a >= WORDS:
                yield first + i, np.unique(runs[a : b - WORDS + 1])
            elif b > a:
                short = (words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield first + i, mix(mix(np.array([short], np.uint64)))
            else:
                yield first + i, words[:0]


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit identity of a set of shingles, as a signed number."""
    parts = np.array([hashes.sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), len(hashes)], np.uint64)
    return int(mix(mix(mix(parts[:1]) + parts[1:2]) + parts[2:]).view(np.int64)[0])


def sketch(hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(keys of the cells, t) for each band that the set takes part in.

    A set of 2**b to 2**(b + 1) - 1 shingles is at home in band b, whose sketches have 2**b cells; it also takes
    part in the band below if a similar set may be there. Similar sets meet in the smaller one's band.
    """
    n = len(hashes)
    if not n:
        return []
    home = n.bit_length() - 1
    least = -(-LEAST * n // 100)
    out = []
    for band in (home, home - 1):
        if band < home and least >= 1 << home:
            break
        other = min(100 * n // LEAST, 2 ** (home + 2)) if band == home else (1 << home) - 1
        bound = (n + other) * (100 - LEAST) // (100 + LEAST)
        cells = 1 << band
        cell = (hashes >> np.uint64(64 - band)) if band else np.zeros(n, np.uint64)
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))  # hashes are sorted, so cells are
        content = np.bitwise_xor.reduceat(hashes, start)
        keys = mix(content ^ mix(cell[start] + np.uint64(band << 40)))
        t = cells - bound - (cells - len(start))
        if t < 1:
            prefix = hashes[: n - least + 1]
            keys = np.concatenate([keys, mix(prefix ^ mix(np.array([(band << 40) | (1 << 39)], np.uint64)))])
            t = 1
        out.append((keys, t))
    return out


def _set_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, sid`` of each row: the size and the identity of its set."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("sid", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(1))
            sizes, idents = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, hashes in shingle_sets(raw, at):
                sizes[row], idents[row] = len(hashes), set_id(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(idents)], schema.names)

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


_SENT = ("bucket int", "chunk long", "keys binary", "owners binary", "sids binary", "needs binary", "cells binary")


def _cells(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """Packed sketch cells of all sets, a row for each bucket and chunk, which is some of a task's distinct sets.

    A cell that several sets of the chunk have is sent once, with the number of sets as its owner; those sets are credited with it in
    rows of ``cells`` for the bucket of their ids, from ``buckets`` on.
    """
    names = [c.split()[0] for c in _SENT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owner_sid: list[int] = []
        owner_need: list[int] = []
        counts: list[int] = []
        seen: set[int] = set()
        held, chunk = 0, TaskContext.get().partitionId() << 24

        def row(bucket: int, k: np.ndarray | None, o: np.ndarray | None, s: np.ndarray, t: np.ndarray, c: np.ndarray | None) -> pa.RecordBatch:
            packed = (None if k is None else pack_sorted(k), None if o is None else _planes(o), s.tobytes(), _planes(t), None if c is None else _planes(c))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names)

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal held, chunk
            cells = np.concatenate(keys)
            owners = np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(cells)
            cells, owners = cells[order], owners[order]
            sids, needs = np.array(owner_sid, np.int64), np.array(owner_need, "<u4")
            for x in (keys, owner_sid, owner_need, counts, seen):
                x.clear()
            held = 0
            start = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
            sets = np.diff(np.append(start, len(cells)))
            credit = np.bincount(owners[np.repeat(sets > 1, sets)], minlength=len(sids))
            cells, owners = cells[start], np.where(sets > 1, len(sids), owners[start])
            cuts = _cuts(cells, buckets)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[b], cuts[b + 1])
                own, where = np.unique(owners[part], return_inverse=True)
                one = own < len(sids)
                yield row(b, cells[part], where, sids[own[one]], needs[own[one]], None)
            some = np.flatnonzero(credit)
            some = some[np.argsort(sids[some].view(np.uint64))]
            cuts = _cuts(sids[some].view(np.uint64), buckets)
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = some[cuts[b] : cuts[b + 1]]
                yield row(buckets + b, None, None, sids[own], needs[own], credit[own])
            chunk += 1

        for batch in batches:
            raw, at = buffers(batch.column(0))
            for _, hashes in shingle_sets(raw, at):
                ident = set_id(hashes)
                if ident in seen:
                    continue
                seen.add(ident)
                for cells, need in sketch(hashes):
                    keys.append(cells)
                    owner_sid.append(ident)
                    owner_need.append(need)
                    counts.append(len(cells))
                    held += len(cells)
                if held >= HELD_CELLS:
                    yield from hand_on()
        if held:
            yield from hand_on()
        trim()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, ", ".join(_SENT))


def _cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted((sorted_keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_COUNTS = ("part int", "sids binary", "needs binary", "chunks binary", "cells binary")


def _counter(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """How many cells of one bucket each set of each chunk shares with other sets in each of its bands, packed by buckets of set ids."""
    names = [c.split()[0] for c in _COUNTS]

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows = table.to_pylist()
        if bucket >= buckets:  # what chunks have counted by themselves
            columns = [[bucket - buckets] * len(rows), *([r[c] for r in rows] for c in ("sids", "needs")), [np.full(len(r["sids"]) // 8, r["chunk"]).tobytes() for r in rows], [r["cells"] for r in rows]]
            return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=names)
        keys, sids, needs, chunks, several = [], [], [], [], []
        for r in rows:
            owners = _from_planes(r["owners"]).astype(np.int64)
            own = np.frombuffer(r["sids"], np.int64)
            keys.append(unpack_sorted(r["keys"]))
            several.append(owners == len(own))
            sids.append(np.append(own, 0)[owners])
            needs.append(np.append(_from_planes(r["needs"]), 0)[owners].astype(np.int32))
            chunks.append(np.full(len(owners), r["chunk"]))
        key, sid, need, chunk, many = (np.concatenate(x) for x in (keys, sids, needs, chunks, several))
        order = np.argsort(key)
        key, sid, need, chunk, many = key[order], sid[order], need[order], chunk[order], many[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = np.logical_or.reduceat(many, start) | (np.minimum.reduceat(np.where(many, np.iinfo(np.int64).max, sid), start) < np.maximum.reduceat(np.where(many, np.iinfo(np.int64).min, sid), start))
        own = np.repeat(shared, np.diff(np.append(start, len(key)))) & ~many
        sid, need, chunk = sid[own].view(np.uint64), need[own], chunk[own]
        order = np.lexsort((chunk, need, sid))
        sid, need, chunk = sid[order], need[order], chunk[order]
        start = _starts(sid, need, chunk)
        cells = np.diff(np.append(start, len(sid)))
        sid, need, chunk = sid[start], need[start], chunk[start]
        cuts = _cuts(sid, buckets)
        some = np.flatnonzero(np.diff(cuts)).tolist()
        parts = [slice(cuts[b], cuts[b + 1]) for b in some]
        columns = [pa.array([f(x[p]) for p in parts], pa.binary()) for f, x in ((np.ndarray.tobytes, sid), (_planes, need), (np.ndarray.tobytes, chunk), (_planes, cells))]
        trim()
        return pa.table([pa.array(some, pa.int32()), *columns], names=names)

    return run


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values of sorted columns start."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))


def _going_on(table: pa.Table) -> pa.Table:
    """The sets of one bucket of ids that share as many cells as they need in one of their bands."""
    sid, chunk = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("sids", "chunks"))
    need, cells = (np.concatenate([_from_planes(x) for x in table.column(c).to_pylist()]) for c in ("needs", "cells"))
    order = np.lexsort((chunk, need, sid))
    sid, need, chunk, cells = sid[order], need[order], chunk[order], cells[order]
    start = _starts(sid, need, chunk)
    enough = np.add.reduceat(cells.astype(np.int64), start) >= need[start]
    trim()
    return pa.table([pa.array(np.unique(sid[start][enough]))], names=["sid"])


def _buckets(spark: SparkSession, volume: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // BUCKET_BYTES))


_FINE = "cell long, sid long, n int, place int, rank int"


def _finest(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``cell, sid, n, place, rank, head``: the cells of the finest resolution in which similar sets must meet; and ``sid, bits``, their sketches.

    ``place``: cells of the set that stand before this one. ``rank``: the smaller, the more central is the set.
    ``head``: the cell's most central set. Blocks of sets ask how many sets have each of their cells, once for a block; a cell's sets
    are only ever pre-aggregated, or joined to one row.
    """
    spark = texts.sparkSession
    blocks = scratch.save(_set_blocks(texts), "blocks")
    cells_in_all = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = _buckets(spark, 8 * cells_in_all)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found, sets = np.unique(np.frombuffer(r["cells"], np.uint64), return_counts=True)
                cuts = _cuts(found, buckets)
                some = np.flatnonzero(np.diff(cuts)).tolist()
                parts = [slice(cuts[b], cuts[b + 1]) for b in some]
                columns = [pa.array(some, pa.int32()), pa.array([r["block"]] * len(some), pa.int64()), pa.array([pack_sorted(found[p]) for p in parts], pa.binary()), pa.array([_planes(sets[p]) for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "keys", "sets"])
        trim()

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        bounds = np.append(0, np.cumsum([len(k) for k in keys])).tolist()
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        sets = np.bincount(place, np.concatenate([_from_planes(x) for x in table.column("sets").to_pylist()])).astype(np.int64)[place]
        trim()
        return pa.table([table.column("block"), table.column("bucket"), pa.array([_planes(np.minimum(sets[a:b], 0xFFFFFFFF)) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["block", "bucket", "sets"])

    asked = blocks.select("block", "cells").mapInArrow(ask, "bucket int, block long, keys binary, sets binary")
    answers = scratch.save(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "block long, bucket int, sets binary"), "shared")

    def first_cells(left: pa.Table, right: pa.Table) -> pa.Table:
        [r] = left.to_pylist()
        hashes, sids, sizes = np.frombuffer(r["cells"], np.uint64), np.frombuffer(r["sids"], np.int64), np.frombuffer(r["sizes"], np.int64)
        found, place = np.unique(hashes, return_inverse=True)
        sets = np.concatenate([_from_planes(x) for _, x in sorted(zip(right.column("bucket").to_pylist(), right.column("sets").to_pylist(), strict=True))])[place].astype(np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for sid, a, b in zip(sids.tolist(), (np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
            n, least = b - a, -(-LEAST * (b - a) // 100)
            several = np.flatnonzero(sets[a:b] > 1)
            if len(several) < least:
                continue
            own = several[np.lexsort((hashes[a:b][several], sets[a:b][several]))][: len(several) - least + 1] + a
            before = np.arange(n - len(several), n - len(several) + len(own))
            own, before = (x[(100 + LEAST) * (n - before) // LEAST - n >= least] for x in (own, before))
            rank = -int(sets[a:b][several].sum()) // n
            out.append((hashes[own].view(np.int64), *(np.full(len(own), v) for v in (sid, n)), before, np.full(len(own), rank)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        trim()
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 3, strict=True)], names=[c.split()[0] for c in _FINE.split(", ")])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hashes, ends = np.frombuffer(r["cells"], np.uint64), np.cumsum(np.frombuffer(r["sizes"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["sids"], np.int64)), pa.array([parity_bits(x) for x in np.split(hashes, ends[:-1])], pa.list_(pa.int64()))], ["sid", "bits"])

    cells = blocks.select("block", "cells", "sids", "sizes").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(first_cells, _FINE)
    # what stands before a cell bounds the size of a similar set that has it, too; keep a set where such sizes occur
    kind = lambda c: f"cast(floor(ln({c}) / ln({CLASS})) as int)"
    least, most = f"(({LEAST} * n + 99) div 100)", f"(({100 + LEAST} * (n - place)) div {LEAST} - n)"
    cells = scratch.save(cells, "cells")
    rows = cells.count()
    together = cells.groupBy("cell").agg(F.count("*").alias("sets"), F.collect_set(F.expr(kind("n"))).alias("sizes"), F.min(F.struct("rank", "sid", "n", "place")).alias("head"))
    together = scratch.save(together.where("sets > 1").drop("sets"), "together", rows)  # by itself, so that a cell of many sets can be split where it is joined
    cells = cells.join(together, "cell").where(F.expr(f"exists(sizes, k -> k between {kind(least)} - 1 and {kind(most)} + 1)"))
    kept = scratch.save(cells.select("cell", "sid", "n", "place", "rank", "head"), "kept", rows)
    return kept, blocks.select("sids", "sizes", "cells").mapInArrow(sketches, "sid long, bits array<long>")


def parity_bits(hashes: np.ndarray) -> list[int]:
    """A sketch of SKETCH bits: each shingle turns one over, so that two sketches differ in at most as many bits as their sets in shingles."""
    odd = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _set_blocks(texts: DataFrame) -> DataFrame:
    """Whole sets of ``texts`` (sid, text), some to a row: ``block, size, sids, sizes, cells``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        sids: list[int] = []
        sets: list[np.ndarray] = []

        def hand_on() -> pa.RecordBatch:
            nonlocal number
            cells = np.concatenate(sets)
            parts = (np.array(sids, np.int64), np.array([len(x) for x in sets], np.int64), cells)
            out = [pa.array([number], pa.int64()), pa.array([len(cells)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
            number += 1
            sids.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays(out, ["block", "size", "sids", "sizes", "cells"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            raw, at = buffers(batch.column(1))
            for row, hashes in shingle_sets(raw, at):
                if len(hashes):
                    sids.append(own[row])
                    sets.append(hashes)
                if sum(map(len, sets[-1:])) and sum(map(len, sets)) >= HELD_CELLS:
                    yield hand_on()
        if sets:
            yield hand_on()
        trim()

    return texts.select("sid", "text").mapInArrow(run, "block long, size long, sids binary, sizes binary, cells binary")


def _verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str, rows: int) -> DataFrame:
    """Those of ``pairs`` (a, b: set ids) that are similar, by their whole texts (``sid, text``).

    Pairs are grouped by a, at most GROUP of them together, and a's text goes to each such group. ``rows``: about how many pairs.
    """
    pairs = pairs.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("a", F.pmod(F.xxhash64("b"), F.lit(64))).orderBy("b")) - 1) / GROUP) * 64 + F.pmod(F.xxhash64("b"), F.lit(64)))
    pairs = scratch.save(pairs, f"{name}-pairs", rows)
    n = pairs.count()
    rows = pairs.select("a", "part", F.col("b").alias("sid")).union(pairs.select("a", "part", F.col("a").alias("sid")).distinct())
    rows = rows.join(texts, "sid").select("a", "part", "sid", "text")

    def run(table: pa.Table) -> pa.Table:
        leader = table.column("a")[0].as_py()
        sids = table.column("sid").to_numpy()
        raw, at = buffers(table.column("text"))
        own = int(np.flatnonzero(sids == leader)[0])
        (_, first), *_ = shingle_sets(raw[at[own] : at[own + 1]], np.array([0, at[own + 1] - at[own]]))
        near = []
        for row, hashes in shingle_sets(raw, at):
            if row != own and similar(first, hashes):
                near.append(int(sids[row]))
        return pa.table([pa.array([leader] * len(near), pa.int64()), pa.array(near, pa.int64())], names=["a", "b"])

    return scratch.save(rows.groupBy("a", "part").applyInArrow(run, "a long, b long"), f"{name}-links", n, PAIRS)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct hashes have a Jaccard similarity of LEAST / 100 or more."""
    if min(len(x), len(y)) * 100 < LEAST * max(len(x), len(y)):
        return False
    if not len(x):
        return False
    where = np.searchsorted(x, y)
    where[where == len(x)] = 0
    common = int((x[where] == y).sum())
    return 100 * common >= LEAST * (len(x) + len(y) - common)


def _filtered(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Adds ``_perhaps``: whether the value of ``column`` may be in ``wanted`` (of the same column); false only if it isn't.

    A filter of FILTER_BITS bits, as a broadcast table of bounded size, says so without a shuffle of ``rows``. Where it is full, all may be there.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    words = wanted.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits"))
    found = rows.withColumn("_bit", bit).withColumn("_word", F.floor(F.col("_bit") / 64)).join(F.broadcast(words), "_word", "left")
    return found.withColumn("_perhaps", F.coalesce(F.expr("(shiftright(_bits, cast(_bit % 64 as int)) & 1) = 1"), F.lit(False))).select(*rows.columns, "_perhaps")


def _perhaps_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose value of ``column`` isn't in ``wanted``."""
    return _filtered(rows, column, wanted).where("_perhaps").drop("_perhaps")


def _texts_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, scratch: Scratch, buckets: int) -> DataFrame:
    """``sid, text`` for ``wanted`` (key, sid), each set once, in buckets of their ids; other texts aren't shuffled.

    A repeated key may have several texts, so that sets are told by their own ids.
    """
    found = _perhaps_in(docs.select(F.col(key), F.col(text).cast("string").alias("text")), key, wanted.select(key))
    own = found.select(F.lit(0).alias("none"), "text").mapInArrow(_with_own_id, "sid long, text string").repartition(buckets, "sid")
    return scratch.save_by(own.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "texts", "sid", buckets, dealt=True)


def jaccard_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles long, component_id`` of each row, by links of a similarity of 0.75 or more.

    Words are runs without ASCII white space, A-Z lower-cased; a set is the distinct 5-word shingles; a text with
    fewer words is one shingle. ``component_id`` is the smallest key reachable by links, itself included. A text
    that is null or has no words has no shingles and no links. Rows with equal texts are linked; a repeated key
    is the same node. A row whose key is null takes no part, its ``component_id`` is null. Other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    volume = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = _buckets(spark, volume)
    sets = scratch.save(_set_ids(docs, key, text), "sets")
    total = sets.count()
    cells = _cells(docs.where(F.col(key).isNotNull()), text, buckets)  # not kept: a second reading of the texts is cheaper
    shared = cells.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_counter(buckets), ", ".join(_COUNTS))
    going_on = scratch.save(shared.repartition(buckets, "part").groupBy("part").applyInArrow(_going_on, "sid long"), "going-on", total)
    least = scratch.save(sets.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy("sid").agg(F.min(key).alias("least")), "least", total)
    wanted = scratch.save(going_on.join(least, "sid").select(F.col("least").alias(key), "sid"), "wanted", total)
    found = wanted.count()
    texts = _texts_of(docs, wanted, key, text, scratch, max(files(found, TEXTS), min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    kept, sketches = _finest(texts, scratch)
    links = _linked(kept, sketches, texts, scratch)
    scratch.forget()
    links = links.unionByName(_same_key(sets, key))
    roots = connected_components(links, scratch, "components", total)
    by_set = least.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    by_set = scratch.save(by_set, "roots", total)
    smallest = scratch.save(by_set.groupBy("root").agg(F.min("least").alias("component_id")), "smallest", total)  # by itself, so that a large group can be split where it is joined
    by_set = by_set.join(smallest, "root").select("sid", "component_id")
    out = sets.join(by_set, "sid", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(key))
    out = out.select(F.col(key), F.col("n").alias("n_shingles"), F.when(F.col(key).isNotNull(), own).alias("component_id"))
    return out.coalesce(files(total))


def _with_own_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = buffers(batch.column(1))
        own = np.zeros(batch.num_rows, np.int64)
        for row, hashes in shingle_sets(raw, at):
            own[row] = set_id(hashes)
        yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(1)], ["sid", "text"])
    trim()


def _same_key(sets: DataFrame, key: str) -> DataFrame:
    """Links between the sets of a repeated key."""
    spans = sets.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy(key).agg(F.collect_set("sid").alias("sids")).where(F.size("sids") > 1)
    return spans.select(F.col("sids")[0].alias("a"), F.explode("sids").alias("b")).where("a <> b")


def _linked(kept: DataFrame, sketches: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that join the same sets as all links between sets that share a kept cell do.

    A cell's first set is its most central one: that whose cells are shared by the most sets, on average. An original
    is more central than its altered copies, so that most of them are linked to it at once. In the last turn sets of different
    components meet in blocks of MEET sets of a cell, and a pair leaves its task only if sizes, places and sketches allow a link.
    """
    rows = kept.count()
    own = F.struct("rank", "sid", "n", "place")
    apart = " + ".join(f"bit_count({{0}}.bits[{i}] ^ {{1}}.bits[{i}])" for i in range(SKETCH // 64))
    possible = f"{LEAST} * greatest({{0}}.n, {{1}}.n) <= 100 * least({{0}}.n, {{1}}.n) and {100 + LEAST} * least({{0}}.n - {{0}}.place, {{1}}.n - {{1}}.place) >= {LEAST} * ({{0}}.n + {{1}}.n)"
    alike = possible + f" and {100 + LEAST} * ({apart}) <= {100 - LEAST} * ({{0}}.n + {{1}}.n)"
    stars = kept.withColumn("own", own).where("head.sid <> sid").where(possible.format("head", "own"))
    tried = stars.groupBy(F.col("sid").alias("b")).agg(F.min("head").alias("a")).select("a.sid", "b").toDF("a", "b")
    links = _verify(tried, texts, scratch, "first", rows)
    tried = scratch.spark.read.parquet(f"{scratch.root}/first-pairs").select("a", "b")
    for turn, all_pairs in (("stars", False), ("all", True)):
        roots = connected_components(links, scratch, f"{turn}-components", rows)
        open_ = kept.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        open_ = scratch.save(open_.drop("head"), f"{turn}-roots", rows)
        heads = F.min(F.struct("rank", "sid", "n", "place", "root")).alias("a")
        several = open_.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("sets"), heads).where("low <> high").drop("low", "high")
        several = scratch.save(several, f"{turn}-several", rows)
        open_ = _perhaps_in(open_, "cell", several.select("cell"))
        if all_pairs:
            blocks = F.ceil(F.col("sets") / MEET).cast("int")
            meet = open_.join(several.select("cell", blocks.alias("blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("sid"), "blocks").cast("int"))
            meet = meet.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            meet = meet.join(_perhaps_in(sketches, "sid", meet.select("sid").distinct()), "sid")
            meet = scratch.save(meet.select("cell", "i", "j", "block", "sid", "n", "place", "bits", "root"), "all-meet", rows)
            left, right = meet.where("block = i").alias("l"), meet.where("block = j").alias("r")
            more = left.join(right, F.expr("l.cell = r.cell and l.i = r.i and l.j = r.j and (l.i < l.j or l.sid < r.sid) and l.root <> r.root and " + alike.format("l", "r")))
            more = more.select(F.least("l.sid", "r.sid").alias("a"), F.greatest("l.sid", "r.sid").alias("b")).distinct()
        else:
            more = open_.withColumn("own", own).join(several.select("cell", "a"), "cell").where("root <> a.root").where(possible.format("a", "own")).select(F.col("a.sid").alias("a"), F.col("sid").alias("b")).distinct()
        done = tried.union(tried.select("b", "a"))
        more = more.join(done, ["a", "b"], "left_anti")
        found = _verify(more, texts, scratch, turn, rows)
        tried = tried.union(scratch.spark.read.parquet(f"{scratch.root}/{turn}-pairs").select("a", "b"))
        links = links.union(found)
    return links


def keep_one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that ``jaccard_groups`` puts in a group of a smaller key.

    Of rows with one key one stays; rows with a null key all stay.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kept")
    groups = jaccard_groups(docs, key=key, text=text).where(F.col(key).isNotNull())
    groups = scratch.save(groups.select(key, (F.col(key) != F.col("component_id")).alias("other")), "groups")
    others = scratch.save(groups.where("other").select(key).distinct(), "others", groups.count())
    marked = _filtered(docs, key, others)  # only the texts of few other documents are shuffled
    out = marked.where("not _perhaps").unionByName(marked.where("_perhaps").join(others, key, "left_anti")).select(*docs.columns)
    if groups.groupBy(key).count().where("count > 1").isEmpty():
        return out
    return out.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(out.where(F.col(key).isNull()))
