"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


#: Edges that a task holds at once.
HELD_EDGES = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The star forest of an edge list: (node, smallest node of its component) for every node but the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i, p in enumerate(parent):  # parents precede their children
        parent[i] = parent[p]
    root = np.asarray(parent, np.int64)
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as the star forests of up to HELD_EDGES of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out():
        a, b = forest(*(np.concatenate(x) for x in zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) > HELD_EDGES:
            yield out()
    if held:
        yield out()


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _starred(now: DataFrame, mark: tuple, max_rounds: int) -> DataFrame:
    """Edges (a > b) as stars: every node with its component's smallest one."""
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int = HELD_EDGES) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node.

    Nodes are longs.  Edges are first contracted in every task; if their count is
    then at most ``few`` (8 MB of them), one more task finishes, else each round
    joins every node's neighbours with its smallest one, until nothing changes.
    Lineage is cut by checkpoint() each round.  Null ends, loops and repeated
    edges are ignored; no edges give an empty table.  Raises if ``max_rounds``
    do not suffice (rounds grow with the logarithm of the longest path).
    """
    plain = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(F.col(a), F.col(b)).cast("long").alias("a"), F.least(F.col(a), F.col(b)).cast("long").alias("b"))
    now = checkpointed(plain.mapInArrow(_contract, "a long, b long").distinct())
    mark = _mark(now)
    if mark[0] <= few:
        now = checkpointed(now.repartition(1).mapInArrow(_contract, "a long, b long")) if mark[0] else now
    else:
        now = _starred(now, mark, max_rounds)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
