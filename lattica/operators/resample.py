"""Resampling at any factor and tiled contrast equalisation: generated weights, equi-joins and grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the slope of the cubic kernel.
CUBIC = -0.75


def _near(t: Column) -> Column:
    return ((CUBIC + 2) * t - (CUBIC + 3)) * t * t + 1


def _far(t: Column) -> Column:
    return ((CUBIC * t - 5 * CUBIC) * t + 8 * CUBIC) * t - 4 * CUBIC


def weights(spark: SparkSession, size: int, wanted: int, mode: str = "linear", corners: bool = False) -> DataFrame:
    """(o, i, w): what old position i adds to new position o, when an axis of ``size`` is resampled to ``wanted``.

    Modes: nearest, linear, cubic, area.  ``corners`` keeps the first and last positions in place, else pixel centres
    are aligned; the ends are repeated.  One to four rows a position, for area as many as it covers.
    """
    o = F.col("o")
    new = spark.range(wanted).withColumnRenamed("id", "o")
    if mode == "nearest":
        return new.select("o", F.floor(o * size / wanted).alias("i"), F.lit(1.0).alias("w"))
    if mode == "area":
        first, last = F.floor(o * size / wanted), F.ceil((o + 1) * size / wanted)
        return new.select("o", F.explode(F.sequence(first, last - 1)).alias("i"), (F.lit(1.0) / (last - first)).alias("w"))
    at = o * F.lit((size - 1) / max(wanted - 1, 1)) if corners else (o + 0.5) * F.lit(size / wanted) - 0.5
    if mode == "linear":
        at = F.greatest(at, F.lit(0.0))
        taps = [(0, 1 - (at - F.floor(at))), (1, at - F.floor(at))]
    elif mode == "cubic":
        t = at - F.floor(at)
        taps = [(-1, _far(t + 1)), (0, _near(t)), (1, _near(1 - t)), (2, _far(2 - t))]
    else:
        raise ValueError(f"no mode {mode}")
    tap = F.explode(F.array(*[F.struct((F.floor(at) + k).alias("i"), w.alias("w")) for k, w in taps]))
    placed = new.select("o", tap.alias("p")).select("o", F.least(F.greatest("p.i", F.lit(0)), F.lit(size - 1)).cast("long").alias("i"), F.col("p.w").alias("w"))
    return placed.groupBy("o", "i").agg(F.sum("w").alias("w"))


def resampled(df: DataFrame, sizes: dict[str, int], wanted: dict[str, int], mode: str = "linear", corners: bool = False, column: str = "v") -> DataFrame:
    """An array in long form (one row a position) resampled axis by axis.

    Each axis is one equi-join with its weights and one grouped sum; axes that shrink
    go first, so that little is carried.  Positions that the table lacks, and null values, count as zero.
    """
    for axis in sorted(wanted, key=lambda a: wanted[a] / sizes[a]):
        rest = [c for c in df.columns if c not in (axis, column)]
        w = weights(df.sparkSession, sizes[axis], wanted[axis], mode, corners).withColumnsRenamed({"i": axis, "o": "_o", "w": "_w"})
        df = df.join(w, axis).groupBy(*rest, F.col("_o").alias(axis)).agg(F.sum(F.coalesce(F.col(column), F.lit(0.0)) * F.col("_w")).alias(column))
    return df


def equalised_tiles(df: DataFrame, by: Sequence[str], size: tuple[int, int], tiles: tuple[int, int], clip: float, column: str = "v") -> DataFrame:
    """Contrast-limited adaptive equalisation of whole values 0 to 255 at (x, y) within each group; zeros stay zero.

    Every tile gets a table of 256 levels: its histogram is clipped at ``clip`` times the
    mean bin, what is cut off is spread evenly, the running sum is scaled to 255.
    A position blends the tables of the four tiles around it.  Sides are multiples of
    their number of tiles, else the last tile is smaller and uses its own area.
    """
    side = [-(-s // t) for s, t in zip(size, tiles)]
    value = F.col(column).cast("int")
    tile = [F.floor(F.col(a) / s).cast("long").alias(t) for a, s, t in zip("xy", side, ("tx", "ty"))]
    counts = df.groupBy(*by, *tile, value.alias("bin")).agg(F.count("*").alias("n"))
    areas = counts.groupBy(*by, "tx", "ty").agg(F.sum("n").alias("area"))
    full = areas.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255)))).join(counts, [*by, "tx", "ty", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = Window.partitionBy(*by, "tx", "ty")
    most = F.greatest(F.floor(F.lit(float(clip)) * F.col("area") / 256), F.lit(1))
    cut = full.withColumn("over", F.greatest(F.col("n") - most, F.lit(0))).withColumn("spare", F.sum("over").over(own))
    even, left = F.floor(F.col("spare") / 256), F.col("spare") % 256
    step = F.greatest(F.floor(F.lit(256) / F.greatest(left, F.lit(1))), F.lit(1))
    extra = F.when((left > 0) & (F.col("bin") % step == 0) & (F.col("bin") / step < left), 1).otherwise(0)
    level = F.bround(F.sum(F.col("n") - F.col("over") + even + extra).over(own.orderBy("bin")) * 255.0 / F.col("area"), 0)
    tables = cut.select(*by, "tx", "ty", "bin", F.least(level, F.lit(255.0)).alias("level"))
    lows = [F.floor(F.col(a) / s - 0.5) for a, s in zip("xy", side)]
    parts = [F.col(a) / s - 0.5 - low for a, s, low in zip("xy", side, lows)]
    corner = lambda i, j: F.struct(*[F.least(F.greatest(low + k, F.lit(0)), F.lit(n - 1)).cast("long").alias(t) for low, k, n, t in zip(lows, (i, j), tiles, ("tx", "ty"))], ((parts[0] if i else 1 - parts[0]) * (parts[1] if j else 1 - parts[1])).alias("w"))
    seen = df.withColumn("bin", value).withColumn("c", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).select(*df.columns, "bin", "c.tx", "c.ty", "c.w")
    rest = [c for c in df.columns if c != column]
    blended = seen.join(tables, [*by, "tx", "ty", "bin"]).groupBy(*rest, "bin").agg(F.bround(F.round(F.sum(F.col("level") * F.col("w")), 9), 0).alias("level"))
    return blended.select(*rest, F.when(F.col("bin") == 0, 0).otherwise(F.col("level")).cast("int").alias(column))


def at_resolution(df: DataFrame, sizes: dict[str, int], have: dict[str, float], want: dict[str, float], mode: str = "linear", threshold: float | None = None, column: str = "v") -> DataFrame:
    """An array read at resolution ``have``, brought to resolution ``want``; with a threshold as a mask of zeros and ones.

    New sizes must be whole.
    """
    wanted = {}
    for a, n in sizes.items():
        new = n * have[a] / want[a]
        if abs(new - round(new)) > 1e-6 or round(new) < 1:
            raise ValueError(f"{a} has {new} positions at the wanted resolution")
        if round(new) != n:
            wanted[a] = round(new)
    out = resampled(df, sizes, wanted, mode, column=column) if wanted else df
    return out if threshold is None else out.withColumn(column, (F.col(column) > threshold).cast("int"))
