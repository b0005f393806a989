"""Spatial predicates and grid arithmetic as column expressions.

Boxes are half-open; two boxes that merely touch do not intersect.  Bounds are
rounded to ten decimals, and grid arithmetic rounds before it floors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Columns = Sequence[Column]
DIGITS = 10


def _lits(values) -> list[Column]:
    return [v if isinstance(v, Column) else F.lit(v) for v in values]


def all_of(columns) -> Column:
    return reduce(and_, columns)


def box(start: Sequence[float], stop: Sequence[float], resolution: Sequence[float] = (1, 1, 1)) -> list[tuple[float, float]]:
    """[(start, stop)] of each axis in nm."""
    return [(round(a * r, DIGITS), round(b * r, DIGITS)) for a, b, r in zip(start, stop, resolution)]


def contains(point: Columns, bounds, resolution: Sequence[float] = (1, 1, 1)) -> Column:
    """Half-open point-in-box test."""
    return all_of((p * F.lit(float(r)) >= F.lit(lo)) & (p * F.lit(float(r)) < F.lit(hi)) for p, (lo, hi), r in zip(point, bounds, resolution))


def intersects(a: Sequence[tuple[Column, Column]], b) -> Column:
    """Strict overlap of boxes given as (start, stop) columns per axis."""
    return all_of((a1 > b0) & (b1 > a0) for (a0, a1), (b0, b1) in zip(a, ((_lits(x)) for x in b)))


def intersection(a, b) -> list[tuple[Column, Column]]:
    """Overlap of two boxes; all zero if they are disjoint."""
    hit = intersects(a, b)
    out = []
    for (a0, a1), x in zip(a, b):
        b0, b1 = _lits(x)
        out.append((F.when(hit, F.greatest(a0, b0)).otherwise(F.lit(0.0)), F.when(hit, F.least(a1, b1)).otherwise(F.lit(0.0))))
    return out


def contained_in(a, b) -> Column:
    """Closed containment."""
    return all_of((a0 >= b0) & (a1 <= b1) for (a0, a1), (b0, b1) in zip(a, ((_lits(x)) for x in b)))


def supremum(a, b) -> list[tuple[Column, Column]]:
    return [(F.least(a0, *_lits([b0])), F.greatest(a1, *_lits([b1]))) for (a0, a1), (b0, b1) in zip(a, b)]


def padded(bounds, pad: Sequence[float]):
    return [(a - p, b + p) for (a, b), p in zip(bounds, pad)]


def translated(bounds, by: Sequence[float]):
    return [(a + d, b + d) for (a, b), d in zip(bounds, by)]


def volume(bounds) -> Column:
    return reduce(lambda x, y: x * y, [b - a for a, b in bounds])


def line_hits(start: Columns, end: Columns, bounds) -> Column:
    """Whether a segment meets a box: an endpoint lies inside, or clipping the segment leaves a part.

    An axis along which the segment does not move is tested half-open, the others closed.
    """
    low, high, still = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q, (a, b) in zip(start, end, bounds):
        d = q - p
        moves = d != 0
        safe = F.when(moves, d).otherwise(F.lit(1.0))
        t0, t1 = (F.lit(a) - p) / safe, (F.lit(b) - p) / safe
        low = F.when(moves, F.greatest(low, F.least(t0, t1))).otherwise(low)
        high = F.when(moves, F.least(high, F.greatest(t0, t1))).otherwise(high)
        still = still & (moves | ((p >= F.lit(a)) & (p < F.lit(b))))
    return contains(start, bounds) | contains(end, bounds) | (still & (low <= high))


def snapped(value: Column, offset: float, size: float, mode: str, up: bool) -> Column:
    """A bound snapped to the grid offset + k * size; mode shrink, expand or floor, ``up`` for the upper bound."""
    k = F.round((value - F.lit(offset)) / F.lit(size), DIGITS)
    ceil = {"shrink": not up, "expand": up, "floor": False}[mode]
    return (F.ceil(k) if ceil else F.floor(k)) * F.lit(size) + F.lit(offset)


def chunk_index(point: Columns, resolution: Sequence[float], offset: Sequence[float], size: Sequence[float]) -> list[Column]:
    """Grid index of the chunk that holds a point in nm."""
    return [F.floor((p / F.lit(float(r)) - F.lit(float(o))) / F.lit(float(s))).cast("long") for p, r, o, s in zip(point, resolution, offset, size)]


def chunk_name(index: Columns, offset: Sequence[int], size: Sequence[int]) -> Column:
    """x0-x1_y0-y1_z0-z1 of a chunk in voxels."""
    return F.concat_ws("_", *[F.concat_ws("-", (i * s + o).cast("string"), ((i + 1) * s + o).cast("string")) for i, o, s in zip(index, offset, size)])


def nth_chunk(n: Column, shape: Sequence[int]) -> list[Column]:
    """Grid index of the n-th chunk, x fastest."""
    x, y, _ = shape
    return [n % x, F.floor(n / x) % y, F.floor(n / (x * y))]


def grid(df_spark, shape: Sequence[int]) -> DataFrame:
    """All chunks of a grid: n, cx, cy, cz."""
    n = df_spark.range(shape[0] * shape[1] * shape[2]).withColumnRenamed("id", "n")
    cx, cy, cz = nth_chunk(F.col("n"), shape)
    return n.select("n", cx.cast("long").alias("cx"), cy.cast("long").alias("cy"), cz.cast("long").alias("cz"))


def morton(index: Columns, shape: Sequence[int]) -> Column:
    """Compressed Morton code: the bits of the axes interleaved, each axis only as long as its grid needs."""
    bits = [max(int(n - 1).bit_length(), 0) for n in shape]
    out, at = F.lit(0).cast("long"), 0
    for level in range(max(bits, default=0)):
        for i, b in zip(index, bits):
            if level < b:
                out = out.bitwiseOR(F.shiftleft(F.shiftright(i.cast("long"), level).bitwiseAND(F.lit(1).cast("long")), at))
                at += 1
    return out


def minishard(id_: Column, preshift: int, minishard_bits: int) -> Column:
    return F.shiftrightunsigned(id_.cast("long"), preshift).bitwiseAND(F.lit((1 << minishard_bits) - 1).cast("long"))


def shard(id_: Column, preshift: int, minishard_bits: int, shard_bits: int) -> Column:
    return F.shiftrightunsigned(id_.cast("long"), preshift + minishard_bits).bitwiseAND(F.lit((1 << shard_bits) - 1).cast("long"))


def colour(index: Columns) -> Column:
    """Number (0..7) of a chunk's class such that no two neighbours share one."""
    x, y, z = index
    return F.pmod(x, F.lit(2)) * 4 + F.pmod(y, F.lit(2)) * 2 + F.pmod(z, F.lit(2))


def tight_box(df: DataFrame, point: Sequence[str], by: Sequence[str] = (), eps: float = 0.0) -> DataFrame:
    """Tight box of points, by group."""
    return df.groupBy(*by).agg(*[F.min(c).alias(f"{c}0") for c in point], *[(F.max(c) + eps).alias(f"{c}1") for c in point])


def isclose(a: Column, b: Column, rel: float = 1e-5, abs_: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def cells_of(df: DataFrame, bounds: Sequence[tuple[str, str]], size: Sequence[float], names: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    """Rows repeated for every grid cell that their closed box touches."""
    for (a, b), s, name in zip(bounds, size, names):
        df = df.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / s).cast("long"), F.floor(F.col(b) / s).cast("long"))))
    return df


def distance_pairs(left: DataFrame, right: DataFrame, radius: float, axes: Sequence[str], cells: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    """Pairs of rows whose points lie within ``radius``: an equi-join on grid cells twice that size, then the exact distance.

    The left side's axis columns are ``axes``; the right's carry the suffix ``_r``.  The right side is
    repeated for the cells that its sphere's box touches, at most two an axis, so give the smaller one there.
    """
    side, near = 2.0 * radius, right
    for c, a in zip(cells, axes):
        near = near.withColumn(c, F.explode(F.sequence(F.floor((F.col(f"{a}_r") - radius) / side).cast("long"), F.floor((F.col(f"{a}_r") + radius) / side).cast("long"))))
    own = left.withColumns({c: F.floor(F.col(a) / side).cast("long") for c, a in zip(cells, axes)})
    d2 = reduce(lambda x, y: x + y, [(F.col(a) - F.col(f"{a}_r")) * (F.col(a) - F.col(f"{a}_r")) for a in axes])
    return own.join(near, list(cells)).where(d2 < radius * radius).withColumn("dist", F.sqrt(d2)).drop(*cells)
