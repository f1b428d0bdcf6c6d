"""Connected components of a graph given by its edges, without ever collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.shared import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that aren't roots; a root is the smallest node of its tree."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = where[: len(a)], where[len(a) :]
    while True:
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(parent, high[open_], low[open_])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    rest = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[rest], nodes[parent[rest]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str, rows: int | None = None) -> DataFrame:
    """``node, root`` of every node of ``edges`` (two long columns); a root is its component's smallest node.

    Each batch of edges first becomes a spanning forest. Then, until no edge is left, each node hooks on to its
    smallest neighbour, pointers are followed until they are stable, and the edges are drawn between roots.
    Every step is an aggregate or an equi-join of distinct rows; a hub's rows are only ever pre-aggregated or
    joined to one row, which a skewed join can split. Nulls and loops don't count. ``rows``: about how many edges, if known.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = scratch.save(edges.mapInArrow(_local_forests, "a long, b long").distinct(), f"{name}-edges-0", rows)
    rows = edges.count()  # of the files' footers; no later table has more than twice as many
    roots = None
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("root"))
        hook = scratch.save(hook, f"{name}-hook-{turn}-0", rows)
        jump = 0
        while True:
            nxt = hook.select(F.col("node").alias("root"), F.col("root").alias("further"))
            chained = hook.join(nxt, "root").where("further <> root")
            if chained.isEmpty():
                break
            jump += 1
            hook = scratch.save(hook.join(nxt, "root").select("node", F.col("further").alias("root")), f"{name}-hook-{turn}-{jump}", rows)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("y"))
        turn += 1
        drawn = edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = scratch.save(drawn, f"{name}-edges-{turn}", rows)
        if roots is None:
            roots = hook
        else:
            later = hook.select(F.col("node").alias("root"), F.col("root").alias("further"))
            roots = roots.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            roots = scratch.save(roots, f"{name}-roots-{turn}", rows)
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
