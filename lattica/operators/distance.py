"""Exact distances on grids by separable passes along lines: no radius, no pairs of cells.

A pass sorts the cells of a line once and walks it; a task holds one line at a
time, so memory is bounded by the longest side of the volume.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAR = 1 << 40


def along(df: DataFrame, by: Sequence[str], axis: str, walk: Callable[[dict[str, list]], dict[str, list]], adds: dict[str, str]) -> DataFrame:
    """``df`` with the columns ``adds`` (name to type) that ``walk`` makes from each line: the rows of one key, sorted by ``axis``."""
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{n} {t}" for n, t in adds.items()])
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            line = pa.Table.from_batches(parts).combine_chunks()
            made = walk({n: line.column(n).to_pylist() for n in names})
            arrays = [c.chunk(0) for c in line.columns] + [pa.array(made[n], kinds[t]) for n, t in adds.items()]
            return pa.RecordBatch.from_arrays(arrays, names=[*names, *adds])

        now, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(names.index(k)).to_pylist() for k in by)))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if parts and keys[a] != now:
                    yield done(parts)
                    parts = []
                now = keys[a]
                parts.append(batch.slice(a, b - a))
        if parts:
            yield done(parts)

    return df.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, axis).mapInArrow(run, schema)


def _nearest_in_line(axis: str):
    """The distance along the line to the nearest marked cell."""

    def walk(line: dict[str, list]) -> dict[str, list]:
        at = np.asarray(line[axis], np.int64)
        marked = at[np.asarray(line["marked"], bool)]
        if not len(marked):
            return {"gap": [_FAR] * len(at)}
        i = np.searchsorted(marked, at)
        return {"gap": np.minimum(np.abs(at - marked[np.minimum(i, len(marked) - 1)]), np.abs(at - marked[np.maximum(i - 1, 0)]))}

    return walk


def envelope(at: Sequence[int], height: Sequence[int]) -> list[int]:
    """For each place p of ``at`` (ascending) the least (p - q)**2 + height(q) over its places q: the lower envelope of parabolas."""
    kept: list[int] = []
    begins: list[float] = []
    for i, (q, h) in enumerate(zip(at, height)):
        if h >= _FAR:
            continue
        begin = -np.inf
        while kept:
            j = kept[-1]
            begin = ((h + q * q) - (height[j] + at[j] * at[j])) / (2 * (q - at[j]))
            if begin > begins[-1]:
                break
            kept.pop()
            begins.pop()
            begin = -np.inf
        kept.append(i)
        begins.append(begin)
    out, k = [], 0
    for p in at:
        while k + 1 < len(kept) and begins[k + 1] < p:
            k += 1
        out.append((p - at[kept[k]]) ** 2 + height[kept[k]] if kept else _FAR)
    return out


def squared_distance(cells: DataFrame, by: Sequence[str], marked: str) -> DataFrame:
    """Cells (by, x, y and others) with ``d2``, the squared distance to the nearest marked cell of their group.

    Groups are regions whose marked cells include their outlines, or full rectangles:
    then every row and column of a nearest one is in the group as far as it matters.
    Groups without a marked cell have a null.
    """
    one = along(cells.withColumn("marked", F.col(marked).cast("boolean")), [*by, "x"], "y", _nearest_in_line("y"), {"gap": "long"})
    two = along(one, [*by, "y"], "x", lambda line: {"d2": envelope(line["x"], [g * g if g < _FAR else _FAR for g in line["gap"]])}, {"d2": "long"})
    return two.select(*cells.columns, F.when(F.col("d2") < _FAR, F.col("d2")).alias("d2"))


def outline(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells (by, x, y) with ``edge``: whether one of their four neighbours lies outside their group."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    own = cells.select(*by, "x", "y").distinct()
    around = own.withColumn("m", F.explode(moves)).select(*by, (F.col("x") + F.col("m.i")).alias("x"), (F.col("y") + F.col("m.j")).alias("y"))
    n = around.groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    return own.join(n, [*by, "x", "y"], "left").select(*by, "x", "y", (F.coalesce("n", F.lit(0)) < 4).alias("edge"))


def poles(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, x, y, distance): the cell of each group that lies farthest from the group's outline, ties to the smallest x, then y.

    Groups that are all outline give their smallest cell at distance 0.
    """
    far = squared_distance(outline(cells, by), by, "edge")
    best = far.groupBy(*by).agg(F.max(F.struct(F.col("d2"), (-F.col("x")).alias("mx"), (-F.col("y")).alias("my"))).alias("b"))
    return best.select(*by, (-F.col("b.mx")).alias("x"), (-F.col("b.my")).alias("y"), F.sqrt("b.d2").alias("distance"))


def _two(candidates: list[tuple]) -> list[tuple]:
    """The best candidate (distance, y, x, label) and the best one of another label."""
    best = min(candidates, default=None)
    if best is None:
        return []
    other = min((c for c in candidates if c[3] != best[3]), default=None)
    return [best] if other is None else [best, other]


def _swept(axis: str, given: Callable[[dict[str, list]], list[list[tuple]]]):
    """Candidates of each place from both sides: a step along the line costs its length."""

    def walk(line: dict[str, list]) -> dict[str, list]:
        at, own = line[axis], given(line)

        def one_way(order: range) -> dict[int, list[tuple]]:
            out, carried, last = {}, [], None
            for i in order:
                step = abs(at[i] - last) if last is not None else 0
                carried = _two(own[i] + [(d + step, *rest) for d, *rest in carried])
                out[i], last = carried, at[i]
            return out

        up, down = one_way(range(len(at))), one_way(range(len(at) - 1, -1, -1))
        both = [_two(up[i] + down[i]) for i in range(len(at))]
        return {f"{n}{k}": [c[k][j] if len(c) > k else None for c in both] for k in (0, 1) for j, n in enumerate(("d", "oy", "ox", "l"))}

    return walk


_TWO = {f"{n}{k}": "long" for k in (0, 1) for n in ("d", "oy", "ox", "l")}


def nearest_other_label(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(x, y, z, other, distance): for every labelled voxel the nearest different label within its z, however far.

    City-block distance; background (null or 0) is no label and does not hinder; of
    equally near ones the first in the order of (y, x).  Every place remembers
    the best two candidates of different labels, which both passes keep exact.  A slice is
    taken as a full grid: places that the table lacks within its bounds are background.
    Voxels of a slice with one label only are left out.
    """
    own = voxels.select("z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.coalesce(F.col(label).cast("long"), F.lit(0).cast("long")).alias("label"))
    bounds = own.groupBy("z").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = bounds.withColumn("x", F.explode(F.sequence("x0", "x1"))).select("z", "x", F.explode(F.sequence("y0", "y1")).alias("y"))
    grid = rows.join(own, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("label", F.lit(0).cast("long")).alias("label"))
    start = lambda line: [[(0, y, x, v)] if v else [] for x, y, v in zip(line["x"], line["y"], line["label"])]
    one = along(grid, ["z", "y"], "x", _swept("x", start), _TWO)
    two_of = lambda line: [[tuple(line[f"{n}{k}_"][i] for n in ("d", "oy", "ox", "l")) for k in (0, 1) if line[f"d{k}_"][i] is not None] for i in range(len(line["y"]))]
    two = along(one.withColumnsRenamed({c: f"{c}_" for c in _TWO}), ["z", "x"], "y", _swept("y", two_of), _TWO)
    differs = F.col("l0") != F.col("label")
    found = two.where("label <> 0").select("x", "y", "z", F.when(differs, F.col("l0")).otherwise(F.col("l1")).alias("other"), F.when(differs, F.col("d0")).otherwise(F.col("d1")).alias("distance"))
    return found.where("other is not null")
