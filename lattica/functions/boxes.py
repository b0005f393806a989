"""Boxes as (start, stop) columns per axis: construction, slices, splitting, striding.

Bounds are in nm.  ``Box`` values are lists of (start, stop) pairs of columns or numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import DIGITS, _lits

Box = Sequence[tuple[Column | float, Column | float]]


def _pairs(box: Box) -> list[tuple[Column, Column]]:
    return [tuple(_lits(axis)) for axis in box]


def from_corners(a: Sequence, b: Sequence, resolution: Sequence[float] = (1, 1, 1)) -> list[tuple[Column, Column]]:
    """The box between two corners in any order."""
    return [(F.round(F.least(x, y) * float(r), DIGITS), F.round(F.greatest(x, y) * float(r), DIGITS)) for x, y, r in zip(_lits(a), _lits(b), resolution)]


def from_slices(slices: Sequence[slice], resolution: Sequence[float] = (1, 1, 1)) -> list[tuple[float, float]]:
    """The box of index slices; strided or open ones are rejected."""
    if any(s.step not in (None, 1) for s in slices):
        raise ValueError("strided slices make no box")
    if any(s.start is None or s.stop is None for s in slices):
        raise ValueError("a slice needs both bounds")
    return [(round(s.start * r, DIGITS), round(s.stop * r, DIGITS)) for s, r in zip(slices, resolution)]


def slices(box: Box, resolution: Sequence[float], rounding: bool = False) -> list[tuple[Column, Column]]:
    """(first, after the last) grid index of each axis.

    Bounds off the grid raise, unless ``rounding``, which takes in the cells that the box touches.
    """
    out = []
    for (a, b), r in zip(_pairs(box), resolution):
        x, y = F.round(a / float(r), DIGITS), F.round(b / float(r), DIGITS)
        if not rounding:
            message = F.concat(F.lit("box off the grid: "), x.cast("string"), F.lit(" to "), y.cast("string"))
            bad = (x != F.floor(x)) | (y != F.floor(y))
            x, y = F.when(bad, F.raise_error(message).cast("double")).otherwise(x), F.when(bad, F.raise_error(message).cast("double")).otherwise(y)
        out.append((F.floor(x), F.ceil(y)))
    return out


def aligned(a: Box, b: Box) -> list[Column]:
    """For each axis, whether the starts agree and whether the stops do."""
    return [flag for (a0, a1), (b0, b1) in zip(_pairs(a), _pairs(b)) for flag in (a0 == b0, a1 == b1)]


def moved(box: Box, offset: Sequence, resolution: Sequence[float] = (1, 1, 1), start: bool = True, stop: bool = True) -> list[tuple[Column, Column]]:
    """The box with its start, its stop or both shifted."""
    out = []
    for (a, b), o, r in zip(_pairs(box), _lits(offset), resolution):
        by = o * float(r)
        out.append((F.round(a + by, DIGITS) if start else a, F.round(b + by, DIGITS) if stop else b))
    return out


def transposed(box: Box, i: int, j: int, local: bool = False) -> list[tuple[Column, Column]]:
    """Two axes swapped; ``local`` keeps the start and swaps only the sizes."""
    out = _pairs(box)
    if local:
        (a0, a1), (b0, b1) = out[i], out[j]
        out[i], out[j] = (a0, a0 + (b1 - b0)), (b0, b0 + (a1 - a0))
    else:
        out[i], out[j] = out[j], out[i]
    return out


def overridden(box: Box, offset: Sequence, size: Sequence) -> list[tuple[Column, Column]]:
    """Start and size replaced on the axes where they are given; a moved start keeps the size."""
    out = []
    for (a, b), o, s in zip(_pairs(box), offset, size):
        start = a if o is None else _lits([o])[0]
        out.append((start, start + (b - a if s is None else _lits([s])[0])))
    return out


def parts(df: DataFrame, bounds: Sequence[tuple[str, str]], n: Sequence[int], number: str = "part") -> DataFrame:
    """Each row's box cut into n parts per axis of equal size; ``number`` counts them with the last axis running fastest."""
    out = df.withColumn(number, F.explode(F.sequence(F.lit(0), F.lit(math.prod(n) - 1))))
    step, new = math.prod(n), {}
    for (a, b), k in zip(bounds, n):
        step //= k
        i = F.pmod(F.floor(F.col(number) / step), F.lit(k))
        size = (F.col(b) - F.col(a)) / k
        new[a], new[b] = F.round(F.col(a) + i * size, DIGITS), F.round(F.col(a) + (i + 1) * size, DIGITS)
    return out.withColumns(new)


def strided_exact(start: Sequence[float], stop: Sequence[float], size: Sequence[float], stride: Sequence[float] | None = None) -> list[tuple[int, float, float, float]]:
    """For each axis (full steps, first start, left edge, right edge): whole chunks, and the partial ones at the edges.

    Full chunks lie at multiples of the stride counted from zero; an edge of width 0 is none.
    """
    out = []
    for a, b, s, t in zip(start, stop, size, stride or size):
        first = math.ceil(round(a / t, DIGITS)) * t
        n = max(int(math.floor(round((b - first - s) / t, DIGITS))) + 1, 0)
        end = first + (n - 1) * t + s if n else min(first, b)
        out.append((n, first, round(min(first, b) - a, DIGITS), round(b - end, DIGITS)))
    return out


def exact_chunks(spark, start: Sequence[float], stop: Sequence[float], size: Sequence[float]) -> DataFrame:
    """(x0, x1, y0, y1, ...): the grid's cells clipped to a box, partial cells at the edges included; x slowest.

    Cells are numbered and made from their numbers, so tasks make them apart.
    """
    limits = [(math.floor(round(a / s, DIGITS)), math.ceil(round(b / s, DIGITS))) for a, b, s in zip(start, stop, size)]
    counts = [max(hi - lo, 0) for lo, hi in limits]
    df, below = spark.range(math.prod(counts)), math.prod(counts)
    for axis, (lo, _), n, a, b, s in zip("xyz", limits, counts, start, stop, size):
        below //= max(n, 1)
        cell = F.floor(F.col("id") / max(below, 1)) % max(n, 1) + lo
        df = df.withColumns({f"{axis}0": F.greatest(cell * F.lit(float(s)), F.lit(float(a))), f"{axis}1": F.least((cell + 1) * F.lit(float(s)), F.lit(float(b)))})
    return df.drop("id")


def child_cells(cell: Sequence, size: Sequence[float], child_size: Sequence[float]) -> list[tuple[Column, Column]]:
    """(first, after the last) index of the finer level's cells inside a cell; sizes must divide."""
    out = []
    for c, s, t in zip(_lits(cell), size, child_size):
        ratio = s / t
        if ratio != int(ratio) or ratio < 1:
            raise ValueError(f"cells of {t} do not tile one of {s}")
        out.append((c * int(ratio), (c + 1) * int(ratio)))
    return out


def check_levels(levels: Sequence[dict]) -> None:
    """Raises unless each level's cells tile those of the level above and cover the same extent."""
    for i, (up, down) in enumerate(zip(levels, levels[1:]), 1):
        for axis, (s, t, m, n) in enumerate(zip(up["chunk_size"], down["chunk_size"], up["grid_shape"], down["grid_shape"])):
            if t > s or s % t:
                raise ValueError(f"level {i}: cells of {t} do not tile {s} on axis {axis}")
            if n < m or n > m * (s // t):
                raise ValueError(f"level {i}: {n} cells on axis {axis} do not match {m} above")


def centred(point: Sequence, size: Sequence[int], resolution: Sequence[float]) -> list[tuple[Column, Column]]:
    """Grid box of a size around a point in nm: starts at ceil(point / resolution - size / 2)."""
    out = []
    for p, s, r in zip(_lits(point), size, resolution):
        start = F.ceil(F.round(p / float(r) - s / 2, DIGITS))
        out.append((start, start + s))
    return out


def chunk_aligned(box: Sequence[tuple[float, float]], offset: Sequence[float], chunk: Sequence[float], whole: Sequence[float] | None = None) -> None:
    """Raises unless a box starts and stops on chunk bounds (or at the end of the whole extent)."""
    for axis, ((a, b), o, c) in enumerate(zip(box, offset, chunk)):
        end = None if whole is None else o + whole[axis]
        if (a - o) % c or ((b - o) % c and b != end):
            lo, hi = o + math.floor((a - o) / c) * c, o + math.ceil((b - o) / c) * c
            raise ValueError(f"axis {axis}: {a} to {b} is not aligned to chunks; {lo} to {hi} would be")


def index_of(request, resolution: Sequence[float] = (1, 1, 1)) -> dict:
    """{"box": nm bounds, "resolution": ...} of what a caller may write: a box, slices, or (resolution, *slices)."""
    if isinstance(request, dict):
        return {"box": [tuple(x) for x in request["box"]], "resolution": tuple(request.get("resolution", resolution))}
    request = tuple(request)
    if request and not isinstance(request[0], slice):
        resolution, request = tuple(request[0]), request[1:]
    if len(request) != len(resolution):
        raise ValueError(f"{len(resolution)} slices are needed")
    return {"box": from_slices(request, resolution), "resolution": tuple(resolution)}


def scaled_index(start: Sequence, stop: Sequence, factors: Sequence[float], allow_rounding: bool = False) -> list[tuple[Column, Column]]:
    """(start, stop) of each axis in voxels ``factors`` times as large.

    A box that does not end on whole new voxels raises on the executors, or is rounded (half to even) if that is allowed.
    """
    out = []
    for a, b, f in zip(_lits(start), _lits(stop), factors):
        ends = []
        for end in (a, b):
            new = F.round(end / F.lit(float(f)), DIGITS)
            whole = F.bround(new, 0)
            ends.append((whole if allow_rounding else F.when(new == whole, whole).otherwise(F.raise_error("the box is not whole at the new resolution").cast("double"))).cast("long"))
        out.append(tuple(ends))
    return out
