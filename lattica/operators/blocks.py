"""Connected components of labelled voxels, block by block.

Each block of the volume is labelled by one task; only the faces between blocks
are joined, and only the components that meet there go on to the distributed
components.  Voxels themselves are shuffled once for the blocks and once, by the
name of their block's component, for the result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .components import connected_components

AXES = ("x", "y", "z")
#: Kinds of neighbourhood: axes along which a step may go at once, and whether it may leave its z.
NEIGHBOURS = {4: (1, False), 8: (2, False), 6: (1, True), 18: (2, True), 26: (3, True)}


def half_steps(neighbours: int) -> list[tuple[int, int, int]]:
    """One of each two opposite steps to a neighbour."""
    most, across = NEIGHBOURS[neighbours]
    steps = [s for s in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, s)) <= most and (across or not s[2])]
    return [s for s in steps if s > (0, 0, 0)]


def smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n members the smallest member that each reaches over the edges a-b: hooking and pointer jumping on arrays."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if not (low < high).any():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _label_block(at: np.ndarray, label: np.ndarray, node: np.ndarray, steps: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """For the voxels of one block the smallest node of each one's component within the block."""
    low = at.min(axis=0) - 1
    span = at.max(axis=0) - low + 2
    key = np.ravel_multi_index(tuple((at - low).T), tuple(span))
    order = np.argsort(key)
    key, own = key[order], label[order]
    ends_a, ends_b = [], []
    for s in steps:
        there = np.searchsorted(key, key + (s[0] * span[1] + s[1]) * span[2] + s[2])
        there[there == len(key)] = 0
        hit = np.flatnonzero((key[there] - key == (s[0] * span[1] + s[1]) * span[2] + s[2]) & (own[there] == own))
        ends_a.append(hit)
        ends_b.append(there[hit])
    root = smallest_reached(len(key), np.concatenate(ends_a), np.concatenate(ends_b))
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, root, node[order])
    out = np.empty(len(key), np.int64)
    out[order] = least[root]
    return out


def _blockwise(neighbours: int):
    steps = half_steps(neighbours)

    def label(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        at = np.column_stack([t.column(i).to_numpy() for i in range(3, 6)])
        local = _label_block(at, t.column(6).to_numpy(), t.column(7).to_numpy(), steps)
        return pa.RecordBatch.from_arrays([*(t.column(i).combine_chunks() for i in range(3, 8)), pa.array(local)], names=[*AXES, "label", "node", "local"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1).tolist(), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and now != tuple(block[a]):
                    yield label(held)
                    held = []
                now = tuple(block[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield label(held)

    return run


def voxel_components(voxels: DataFrame, block: Sequence[int] = (64, 64, 64), neighbours: int = 26, label: str = "label", node: str = "node") -> DataFrame:
    """(x, y, z, label, node, component) of all labelled voxels; component is the smallest node of the component.

    Voxels are connected to those of their own label among 6, 18 or 26 neighbours, or
    among 4 or 8 within their z.  Labels that are null or zero are background and left
    out; ``node`` is a unique long; positions are unique and whole.  A task holds the
    voxels of one block, at most its volume.
    """
    some = voxels.where(F.col(label).isNotNull() & (F.col(label) != 0))
    kept = some.select(*[F.floor(F.col(a) / s).cast("long").alias(f"b{a}") for a, s in zip(AXES, block)], *[F.col(a).cast("long").alias(a) for a in AXES], F.col(label).cast("long").alias("label"), F.col(node).cast("long").alias("node"))
    keys = [f"b{a}" for a in AXES]
    inside = kept.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_blockwise(neighbours), "x long, y long, z long, label long, node long, local long")
    inside = checkpointed(inside)
    on_face = [(F.pmod(F.col(a), F.lit(s)) == 0) | (F.pmod(F.col(a), F.lit(s)) == s - 1) for a, s in zip(AXES, block)]
    face = inside.where(on_face[0] | on_face[1] | on_face[2])
    moves = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(AXES, s)]) for s in half_steps(neighbours)])
    sent = face.withColumn("m", F.explode(moves)).select(*[F.col(a).alias(f"_{a}") for a in AXES], *[(F.col(a) + F.col(f"m.{a}")).alias(a) for a in AXES], "label", F.col("local").alias("other"))
    leaves = [F.floor(F.col(a) / s) != F.floor(F.col(f"_{a}") / s) for a, s in zip(AXES, block)]
    met = sent.where(leaves[0] | leaves[1] | leaves[2]).join(face.select(*AXES, "label", "local"), [*AXES, "label"]).select("local", "other").distinct()
    merged = connected_components(met, "local", "other").withColumnRenamed("node", "local")
    return inside.join(merged, "local", "left").select(*AXES, "label", "node", F.coalesce("component", "local").alias("component"))
