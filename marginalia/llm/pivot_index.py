"""Embedding near-duplicates (operator 3) by a pivot-permutation index.

A vector is described by its nearest of some reference vectors (pivots), in order. Pivots come from a bounded
sample, and none is within twice the angle of a link of another, so that a dense cluster doesn't take them all, while
vectors that all point much the same way still get many. Two vectors are candidates if they have at least SHARED of
their NEAREST pivots in common. Lists are inverted over the rarest of each vector's pivots only: with NEAREST - SHARED + 1
of them, in one order for all, such two still meet. A list that is too long is split by the next pivot that two
of its vectors share, and again, so that lists don't grow with the table though pivots are of a bounded number.

Lists first hold numbers of vectors and of their pivots alone. Only vectors that share enough pivots with another
of their list are fetched and compared, in the first list that has both, by their cosine in double precision.

A list that is long after SHARED pivots, as that of a dense cluster, is split into blocks, and every two blocks meet in a
task of their own. Of a task's links only sums for each vector and a spanning forest leave it, so a cluster of any size
gives rows in proportion to its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.components import connected_components, forest
from marginalia.llm.shared import Scratch, files, trim

#: Pivots of a vector, of which candidates share so many.
NEAREST, SHARED = 8, 4
#: Vectors to a pivot, pivots at most, the sample they come from (vectors, and bytes of the whole), and how many angles of a link they keep apart.
VECTORS_TO_A_PIVOT, PIVOTS, SAMPLE, SAMPLE_BYTES, APART = 16, 1024, 8192, 32 << 20, 2.2
#: Rows of a list or of a block, and rows of short lists that are handled at once.
BLOCK, LIST_ROWS = 1024, 20_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled first so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, most: int, threshold: float = 0.98) -> np.ndarray:
    """Unit vectors of the sample, none near another; the rarest first, as the sample's vectors have them nearest."""
    units = unit(sample)
    apart = np.cos(min(APART * np.arccos(min(threshold, 1.0)), np.pi / 2))
    chosen = np.empty((most, units.shape[1]))
    n = 0
    for v in units:
        if n == most:
            break
        if not n or (chosen[:n] @ v).max() < apart:
            chosen[n] = v
            n += 1
    pivots = chosen[:n]
    k = min(NEAREST, n)
    near = np.argpartition(-(units @ pivots.T), k - 1, 1)[:, :k]
    return pivots[np.argsort(np.bincount(near.ravel(), minlength=n), kind="stable")]


def permutations(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, the nearest first."""
    k = min(NEAREST, len(pivots))
    scores = units @ pivots.T
    near = np.argpartition(-scores, k - 1, 1)[:, :k]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(scores, near, 1), 1, kind="stable"), 1).astype(np.uint16)


def needed(pivots: int) -> int:
    """How many pivots candidates share, if there are so many in all."""
    k = min(NEAREST, pivots)
    return min(SHARED, max(1, k // 2))


def _one_hot(perms: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(perms), len(columns)), np.float32)
    place = np.searchsorted(columns, perms)
    place[place == len(columns)] = 0
    hit = columns[place] == perms
    rows = np.broadcast_to(np.arange(len(perms))[:, None], perms.shape)
    out[rows[hit], place[hit]] = 1
    return out


def candidates(p: np.ndarray, q: np.ndarray, key: list[int], share: int) -> np.ndarray:
    """Which rows of two blocks of the list ``key`` are candidates, by their pivots (the rarest is the smallest number).

    They share at least ``share`` pivots, of which the first are those of the list; so each pair is compared in one list.
    """
    columns = np.unique(p if q is p else np.concatenate([p.ravel(), q.ravel()]))
    left = _one_hot(p, columns)
    right = left if q is p else _one_hot(q, columns)
    found = left @ right.T >= share
    earlier = int(np.searchsorted(columns, key[-1]))
    if earlier:
        found &= left[:, :earlier] @ right[:, :earlier].T == len(key) - 1
    return found


def block_links(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the ``wanted`` pairs of rows are linked, by unit vectors x and y."""
    cosine = x @ y.T
    links = wanted & (cosine >= threshold)
    close = np.argwhere(wanted & (np.abs(cosine - threshold) < 1e-12))
    for i, j in close:  # the same sum for a pair, wherever it is compared
        links[i, j] = float((x[i] * y[j]).sum()) >= threshold
    return links


def near_vectors(vectors: DataFrame, *, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """``key, n_links long, component_id, kept boolean`` of each vector.

    Vectors of one label and length link if their cosine is ``threshold`` or more. One whose embedding is null, zero
    or holds a null or non-finite component, and one without label, links with nothing. ``n_links``: other vectors
    linked directly, copies included; ``component_id``: the smallest key reachable; ``kept``: whether it is the own.
    Rows equal in all three columns are one vector and give one row. A null key links with nothing, its component is
    null and it isn't kept. Other columns are left out, so clashing names do no harm.

    Recall is that of the index; every vector is indexed. Copies, told by 128 bits of hashes, are compared once. To the driver
    goes the sample.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    digest = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(7), "embedding").alias("g")]
    rows = vectors.select(F.col(key), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label")).select("*", *digest).dropDuplicates([key, "label", "h", "g"])
    whole = "size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(embedding, x -> x <> 0)"
    usable = F.coalesce(F.expr(whole), F.lit(False)) & F.col("label").isNotNull() & F.col(key).isNotNull()
    rows = scratch.save(rows.withColumn("usable", usable), "rows")
    copies = rows.where("usable").groupBy("label", "h", "g").agg(F.min(key).alias("rep"), F.count_distinct(key).alias("copies"), F.any_value("embedding").alias("embedding"))
    copies = scratch.save(copies, "copies")
    n = copies.count()
    widest = copies.agg(F.max(F.size("embedding"))).first()[0] or 1
    size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * widest)))
    sample = copies.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(size).collect()
    most = int(min(PIVOTS, max(NEAREST, n // VECTORS_TO_A_PIVOT)))
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r[0]), []).append(r[0])
    pivots = {k: choose_pivots(np.array(v), most, threshold) for k, v in by_length.items()}
    described = scratch.save(_described(copies, pivots), "described", n)
    most_rows = (NEAREST - SHARED + 1) * n
    members = scratch.save(_members(_lists(described, scratch, n), most_rows), "members", most_rows)
    lists = ["length", "label", "key"]
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    meet = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    meet = meet.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select(*lists, "i", "j", "own", "rep")
    meet = meet.join(described.select("rep", "copies", "nearest"), "rep").join(copies.select("rep", "embedding"), "rep")

    def compare(table: pa.Table) -> pa.Table:
        pivot, low, high = table.column("key")[0].as_py(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own, rep, times = (table.column(c).to_numpy() for c in ("own", "rep", "copies"))
        units, nearest = (_matrix(table.column(c), k) for c, k in (("embedding", np.float64), ("nearest", np.int32)))
        units = unit(units)
        a = np.flatnonzero(own == low)
        b = a if low == high else np.flatnonzero(own == high)
        wanted = candidates(nearest[a], nearest[b], pivot, needed(nearest.shape[1]))
        found = block_links(units[a], units[b], np.triu(wanted, 1) if low == high else wanted, threshold)
        x, y = np.nonzero(found)
        node, root = forest(rep[a][x], rep[b][y])
        links = np.zeros(len(rep), np.int64)
        links[a] += (found.astype(np.float64) @ times[b]).astype(np.int64)  # whole numbers, exact in doubles
        links[b] += (found.T.astype(np.float64) @ times[a]).astype(np.int64)
        some = np.flatnonzero(links)
        nodes = np.concatenate([rep[some], node])
        roots = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(root, pa.int64())])
        trim()
        return pa.table([pa.array(nodes, pa.int64()), roots, pa.array(np.concatenate([links[some], np.zeros(len(node), np.int64)]))], names=["node", "root", "links"])

    found = scratch.save(meet.groupBy(*lists, "i", "j").applyInArrow(compare, "node long, root long, links long"), "found")
    degree = scratch.save(found.where("root is null").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links")), "degree", n)
    roots = connected_components(found.where("root is not null").select("node", "root"), scratch, "components", n).withColumnRenamed("node", "rep")
    by_rep = copies.select("label", "h", "g", "rep", "copies").join(degree, "rep", "left").join(roots, "rep", "left")
    by_rep = by_rep.select("label", "h", "g", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.where("usable").select(key, "label", "h", "g").join(by_rep, ["label", "h", "g"]).select(key, "links", "root")
    out = out.unionByName(rows.where("not usable").select(key, F.lit(0).cast("long").alias("links"), F.col(key).alias("root")))
    return out.select(key, F.col("links").alias("n_links"), F.col("root").alias("component_id"), F.coalesce(F.col(key) == F.col("root"), F.lit(False)).alias("kept"))


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(described: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """``length, label, key, n, rep, nearest``: the lists of each vector, of two vectors or more.

    The key of a list is its first pivots, as two of its vectors share them; a list of more than BLOCK vectors has one of
    another length, until a key has as many pivots as candidates share.
    """
    kept = []
    share = f"least({SHARED}, greatest(1, size(nearest) div 2))"
    open_ = described.select("length", "label", "rep", "nearest", F.expr(share).alias("share"), F.posexplode(F.expr(f"slice(nearest, 1, size(nearest) - {share} + 1)")).alias("last", "pivot"))
    open_ = open_.withColumn("key", F.array("pivot")).drop("pivot")
    for depth in range(1, SHARED + 1):
        open_ = scratch.save(open_, f"open-{depth}", (NEAREST - SHARED + 1) * n)
        sizes = open_.groupBy("length", "label", "key").agg(F.count("*").alias("n")).where("n > 1")
        open_ = open_.join(sizes, ["length", "label", "key"])
        whole = (F.col("n") <= BLOCK) | (F.col("share") <= depth)
        kept.append(open_.where(whole).select("length", "label", "key", "n", "rep", "nearest"))
        open_ = open_.where(~whole)
        if depth < SHARED:
            if sizes.where(F.col("n") > BLOCK).isEmpty():
                break
            open_ = open_.withColumn("next", F.explode(F.expr(f"sequence(last + 1, size(nearest) - share + {depth})")))
            open_ = open_.select("length", "label", "rep", "nearest", "share", F.col("next").alias("last"), F.expr("concat(key, array(nearest[next]))").alias("key"))
    out = kept[0]
    for x in kept[1:]:
        out = out.unionByName(x)
    return out


def _members(lists: DataFrame, rows: int) -> DataFrame:
    """Those rows of ``lists`` whose vector has a candidate in the list; all of a list that has more than BLOCK vectors. Without ``nearest``.

    Many short lists are handled at once, as they come by a hash.
    """
    schema = lists.select("length", "label", "key", "n", "rep").schema

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("list").to_numpy(), kind="stable")))
        names = table.column("list").to_numpy()
        (flat, at), (keys, key_at) = (_flat(table.column(c)) for c in ("nearest", "key"))
        kept = np.zeros(len(names), bool)
        start = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
        for a, b in zip(start.tolist(), np.append(start[1:], len(names)).tolist(), strict=True):
            own = {tuple(keys[key_at[i] : key_at[i + 1]]) for i in range(a, b)} if b - a > 1 else set()
            for key in own:  # more than one only if their hashes are equal
                rows = np.arange(a, b) if len(own) == 1 else np.array([i for i in range(a, b) if tuple(keys[key_at[i] : key_at[i + 1]]) == key])
                nearest = np.stack([flat[at[i] : at[i + 1]] for i in rows]) if len(own) > 1 else flat[at[a] : at[b]].reshape(b - a, -1)
                some = candidates(nearest, nearest, [int(x) for x in key], needed(nearest.shape[1]))
                np.fill_diagonal(some, False)
                kept[rows] = some.any(1)
        trim()
        return table.select(schema.names).filter(pa.array(kept))

    short = lists.where(F.col("n") <= BLOCK).withColumn("list", F.xxhash64("length", "label", "key")).withColumn("bucket", F.pmod("list", F.lit(files(rows, LIST_ROWS))))
    short = short.groupBy("bucket").applyInArrow(run, schema)
    return short.unionByName(lists.where(F.col("n") > BLOCK).select(*schema.names))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists one after another, and where each list's begin (n + 1)."""
    column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def _described(copies: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``length, label, rep, copies, nearest``: the pivots of each vector, the rarest first."""
    schema = T.StructType([T.StructField("length", T.IntegerType()), copies.schema["label"], copies.schema["rep"], T.StructField("copies", T.LongType()), T.StructField("nearest", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lengths = np.diff(batch.column(3).offsets.to_numpy())
                for length in np.unique(lengths).tolist():
                    pick = np.flatnonzero(lengths == length)
                    part = batch.take(pa.array(pick))
                    if length not in pivots:  # none of the sample is as long; one list for all
                        nearest = np.zeros((len(pick), 1), np.int32)
                    else:
                        vectors = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
                        nearest = np.sort(permutations(unit(vectors), pivots[length]), 1).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1) * nearest.shape[1], pa.int32()), pa.array(nearest.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), length), pa.int32()), part.column(0), part.column(1), part.column(2), lists], schema.names)
        trim()

    return copies.select("label", "rep", "copies", "embedding").mapInArrow(run, schema)
