"""Indexers and seeded sampling of boxes, rows and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spatial import cells_of


def strided_boxes(spark: SparkSession, start: Sequence[int], stop: Sequence[int], size: Sequence[int], stride: Sequence[int]) -> DataFrame:
    """(n, x0, x1, ...): all boxes of a size that lie in a region, at a stride; x fastest."""
    counts = [max((b - a - s) // t + 1, 0) for a, b, s, t in zip(start, stop, size, stride)]
    nx, ny, nz = counts
    n = F.col("n")
    at = [n % max(nx, 1), F.floor(n / max(nx, 1)) % max(ny, 1), F.floor(n / max(nx * ny, 1))]
    out = spark.range(nx * ny * nz).withColumnRenamed("id", "n")
    for axis, k, a, s, t in zip("xyz", at, start, size, stride):
        out = out.withColumn(f"{axis}0", (k * t + a).cast("long")).withColumn(f"{axis}1", (k * t + a + s).cast("long"))
    return out


def chained(parts: Sequence[DataFrame], index: str = "n") -> DataFrame:
    """Datasets one after another, with a running index; sizes are one aggregated number each."""
    offset, out = 0, None
    for i, part in enumerate(parts):
        moved = part.withColumn(index, F.col(index) + offset).withColumn("dataset", F.lit(i))
        out = moved if out is None else out.unionByName(moved)
        offset += part.count()
    return out


def looped(df: DataFrame, n: int, index: str = "n") -> DataFrame:
    """Rows repeated round and round up to n."""
    size = df.count()
    if not size:
        return df
    return df.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // size).cast("long")))).withColumn(index, F.col(index) + F.col("_k") * size).where(F.col(index) < n).drop("_k")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with a position in a seeded order; equal for any partitioning."""
    return df.withColumn("order", F.xxhash64(F.lit(seed), F.col(key)))


def sampled(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """A share of the rows chosen by a hash of their key."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))


def padded_or_cut(array: Column, size: int, fill) -> Column:
    """An array of a fixed length."""
    return F.slice(F.concat(array, F.array_repeat(F.lit(fill), size)), 1, size)


def with_noise(df: DataFrame, column: str, key: str, scale: float, seed: int) -> DataFrame:
    """Seeded noise, uniform in (-scale, scale), by the key: the same in every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    return df.withColumn(column, F.col(column) + (u * 2 - 1) * scale)


def hierarchical(df: DataFrame, key: str, levels: int, per_level: float, seed: int) -> DataFrame:
    """Each row with the level that shows it: level k takes a share of those that the levels before left."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / float(1 << 20)
    level = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        level = F.when(u < 1 - (1 - per_level) ** (k + 1), k).otherwise(level)
    return df.withColumn("level", level)


def subdivided(df: DataFrame, id_col: str, bounds: Sequence[tuple[str, str]], sizes: Sequence[Sequence[float]], rates: Sequence[float], seed: int) -> DataFrame:
    """Rows dealt over the levels of a spatial index, cell by cell: level, cx, cy, cz, then the row.

    On each level a cell shows its rows at the level's rate and pushes every other one to those
    of its child cells that the row's closed box touches; the last level shows all.  A row that
    several cells hold is drawn in each by itself.  Sizes divide each other; draws come from
    the MD5 of seed, id, level and cell.  One pass for each level, no cell is collected.
    """
    names = ("cx", "cy", "cz")
    if len(rates) != len(sizes):
        raise ValueError("a rate for each level is needed")
    out, now = None, cells_of(df, bounds, sizes[0], names)
    for level, (size, rate) in enumerate(zip(sizes, rates)):
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col), F.lit(str(level)), *names)), 1, 8), 16, 10).cast("long")
        shown = F.lit(True) if level == len(sizes) - 1 else draw < F.lit(int(rate * (1 << 32)))
        part = now.where(shown).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        if level + 1 < len(sizes):
            inner = ("_cx", "_cy", "_cz")
            pushed = cells_of(now.where(~shown), bounds, sizes[level + 1], inner)
            for outer, c, parent, child in zip(names, inner, size, sizes[level + 1]):
                pushed = pushed.where(F.floor(F.col(c) * child / parent) == F.col(outer))
            now = pushed.drop(*names).withColumnsRenamed(dict(zip(inner, names)))
    return out.select("level", *names, *df.columns)


def zipped(left: DataFrame, right: DataFrame, left_order: Column, right_order: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows of two datasets side by side by their position within each group, up to the shorter."""
    a = left.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(left_order)))
    b = right.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(right_order)))
    return a.join(b, [*by, "_i"]).drop("_i")
