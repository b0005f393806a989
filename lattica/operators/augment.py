"""Random augmentation of arrays in long form, seeded by keys.

A random number is a function of a seed and of a row's key (an md5 of both), so it is the same in every run, for any
partitioning and after a lost executor.  Null keys count as empty texts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) by seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def uniform_between(seed: int, low: float, high: float, *key: Column) -> Column:
    return F.lit(low) + uniform(seed, *key) * (high - low)


def normal(seed: int, mean: float, deviation: float, *key: Column) -> Column:
    """A normally distributed number, from two uniform ones."""
    u, v = uniform(seed, *key, F.lit("u")), uniform(seed, *key, F.lit("v"))
    return F.lit(mean) + F.lit(deviation) * F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v)


def with_probability(p: float, seed: int, key: Sequence[Column], changed: Column, value: Column) -> Column:
    """The changed value for a share of the keys, the old one for the rest."""
    return F.when(uniform(seed, *key) < p, changed).otherwise(value)


def scalar_added(value: Column, amount: Column, mask: Column | None = None) -> Column:
    """A random amount added, only where the mask holds if there is one."""
    return value + amount if mask is None else F.when(mask, value + amount).otherwise(value)


def noisy(points: Column, deviation: float, seed: int, key: Column) -> Column:
    """Normal noise on an array of arrays of numbers, each by its place."""
    return F.transform(points, lambda p, i: F.transform(p, lambda x, j: x + normal(seed, 0.0, deviation, key, i, j)))


def rotated(points: Column, seed: int, key: Column) -> Column:
    """Points (x, y, z) turned about all three axes by angles of the key; distances stay."""
    a, b, c = (2 * math.pi * uniform(seed, key, F.lit(axis)) for axis in "xyz")

    def turn(p: Column) -> Column:
        x, y, z = p[0], p[1], p[2]
        y, z = y * F.cos(a) - z * F.sin(a), y * F.sin(a) + z * F.cos(a)
        x, z = x * F.cos(b) + z * F.sin(b), z * F.cos(b) - x * F.sin(b)
        x, y = x * F.cos(c) - y * F.sin(c), x * F.sin(c) + y * F.cos(c)
        return F.array(x, y, z)

    return F.transform(points, turn)


def tile_pattern(value: Column, axes: Sequence[Column], size: int, stride: int, change: float, seed: int, keep: float | None = None) -> Column:
    """Square tiles brightened or darkened, each by an amount of its own; values equal to ``keep`` stay."""
    tile = [F.floor(a / stride) for a in axes]
    inside = F.lit(True)
    for a in axes:
        inside = inside & (F.pmod(a, F.lit(stride)) < size)
    new = value + F.when(inside, uniform_between(seed, -change, change, *tile)).otherwise(F.lit(0.0))
    return new if keep is None else F.when(value == keep, value).otherwise(new)


def random_sections(df: DataFrame, axis: str, n: int, seed: int, name: str = "chosen") -> DataFrame:
    """Rows with a flag for n of the sections along an axis: those with the smallest random numbers.

    Sections are few (one row each), so they are ranked in one place and joined back.
    """
    ranked = df.select(axis).distinct().withColumn("_r", F.row_number().over(Window.orderBy(uniform(seed, F.col(axis)), axis)))
    return df.join(ranked.where(F.col("_r") <= n).select(axis, F.lit(True).alias(name)), axis, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def random_boxes(sizes: Sequence[int], box: Sequence[int], n: int, seed: int, partial: bool = True) -> list[list[tuple[Column, Column]]]:
    """n boxes of a size at random places, as (start, stop) columns; ``partial`` ones may reach beyond the array."""
    out = []
    for k in range(n):
        axes = []
        for i, (size, b) in enumerate(zip(sizes, box)):
            lo, hi = (-(b // 2), size - b // 2) if partial else (0, size - b)
            start = F.floor(F.lit(lo) + uniform(seed, F.lit(k), F.lit(i)) * (hi - lo + (0 if partial else 1))).cast("long")
            axes.append((start, start + b))
        out.append(axes)
    return out


def boxes_for_density(sizes: Sequence[int], box: Sequence[int], density: float) -> int:
    """How many boxes cover about a share of the array, overlaps not counted."""
    return max(round(density * math.prod(sizes) / math.prod(box)), 0)


def in_any(axes: Sequence[Column], boxes) -> Column:
    """Whether a position lies in one of the boxes."""
    hit = F.lit(False)
    for b in boxes:
        one = F.lit(True)
        for a, (lo, hi) in zip(axes, b):
            one = one & (a >= lo) & (a < hi)
        hit = hit | one
    return hit


def perlin(x: Column, y: Column, cell: int, seed: int) -> Column:
    """Gradient noise: smooth between random directions at the corners of cells."""
    i, j = F.floor(x / cell), F.floor(y / cell)
    u, v = (F.pmod(x, F.lit(cell)) + 0.5) / cell, (F.pmod(y, F.lit(cell)) + 0.5) / cell

    def corner(a: int, b: int) -> Column:
        angle = 2 * math.pi * uniform(seed, i + a, j + b)
        return F.cos(angle) * (u - a) + F.sin(angle) * (v - b)

    def fade(t: Column) -> Column:
        return t * t * t * (t * (t * 6 - 15) + 10)

    low = corner(0, 0) + fade(u) * (corner(1, 0) - corner(0, 0))
    high = corner(0, 1) + fade(u) * (corner(1, 1) - corner(0, 1))
    return math.sqrt(2) * (low + fade(v) * (high - low))


def perlin_octaves(x: Column, y: Column, cell: int, octaves: int, persistence: float, seed: int) -> Column:
    """Gradient noise of halving cells and falling strength, summed."""
    total = F.lit(0.0)
    for k in range(octaves):
        total = total + persistence**k * perlin(x, y, max(cell >> k, 1), seed + k)
    return total


def equalised(df: DataFrame, by: Sequence[str], value: str, clip: float, bins: int = 256) -> DataFrame:
    """Contrast-limited histogram equalisation within each group: bins are clipped at ``clip`` of a group's values, what is cut
    off is spread over all bins, and a value in [0, 1] becomes the share of the values up to its bin."""
    bin_ = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by)
    limit = F.lit(clip) * F.col("total")
    cut = counts.withColumn("total", F.sum("n").over(own)).withColumn("over", F.greatest(F.col("n") - limit, F.lit(0.0))).withColumn("spare", F.sum("over").over(own))
    up_to = F.sum(F.col("n") - F.col("over")).over(own.orderBy("bin")) + F.col("spare") * (F.col("bin") + 1) / bins
    levels = cut.select(*by, "bin", (up_to / F.col("total")).alias("level"))
    return df.withColumn("bin", bin_).join(levels, [*by, "bin"]).withColumn(value, F.col("level")).drop("bin", "level")
