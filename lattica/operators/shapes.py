"""Arrays in long form (index columns and a value column): axes, crops, padding, resampling, erosion.

Missing positions count as absent; an array without rows stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def applied(df: DataFrame, f, targets: Sequence[str] | None = None, but: Sequence[str] = ()) -> DataFrame:
    """``f`` on the named value columns (all but ``but`` by default), the others as they are."""
    return df.withColumns({c: f(F.col(c)) for c in (targets if targets is not None else df.columns) if c not in but})


def rearranged(df: DataFrame, axes: Sequence[str], order: Sequence[str | Sequence[str]], sizes: dict[str, int]) -> DataFrame:
    """Axes in another order; a list of axes in ``order`` is flattened into one, the last running fastest."""
    named = []
    for k, item in enumerate(order):
        group = [item] if isinstance(item, str) else list(item)
        flat = fold(lambda acc, a: acc * sizes[a] + F.col(a), group[1:], F.col(group[0]))
        named.append(flat.alias(f"i{k}"))
    return df.select(*named, *[c for c in df.columns if c not in axes])


def split_axis(df: DataFrame, axis: str, names: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """One axis as several, the last running fastest."""
    out, step = [], 1
    for name, size in zip(reversed(names), reversed(sizes)):
        out.append(F.pmod(F.floor(F.col(axis) / step), F.lit(size)).alias(name))
        step *= size
    return df.select(*[c for c in df.columns if c != axis], *reversed(out))


def reduced(df: DataFrame, keep: Sequence[str], how: str, value: str = "v") -> DataFrame:
    """Sum, mean, max, min or product over all axes but ``keep``."""
    ways = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "prod": F.product}
    if how not in ways:
        raise ValueError(f"no reduction {how}")
    return df.groupBy(*keep).agg(ways[how](value).alias(value))


def repeated(df: DataFrame, axis: str, n: int) -> DataFrame:
    """A new axis of n equal slices."""
    return df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def squeezed(df: DataFrame, axis: str, strict: bool = True) -> DataFrame:
    """The array without an axis of one slice; raises on the executors if there are others and ``strict``."""
    odd = F.when(F.col(axis) != 0, F.raise_error(F.lit(f"axis {axis} has more than one slice")).cast("long")).otherwise(F.lit(0))
    return (df.where(odd == 0) if strict else df).drop(axis)


def cropped(df: DataFrame, sizes: dict[str, int], crop: dict[str, int]) -> DataFrame:
    """The same number of positions off both ends of each named axis; indices start at zero again."""
    kept = [(F.col(a) >= c) & (F.col(a) < sizes[a] - c) for a, c in crop.items()]
    return df.where(fold(lambda x, y: x & y, kept)).withColumns({a: F.col(a) - c for a, c in crop.items()})


def cropped_centre(df: DataFrame, sizes: dict[str, int], wanted: dict[str, int]) -> DataFrame:
    """The middle of each named axis; of an odd rest the smaller half goes at the front."""
    if any(wanted[a] > sizes[a] for a in wanted):
        raise ValueError("cannot crop to more than there is")
    first = {a: (sizes[a] - wanted[a]) // 2 for a in wanted}
    kept = [(F.col(a) >= first[a]) & (F.col(a) < first[a] + wanted[a]) for a in wanted]
    return df.where(fold(lambda x, y: x & y, kept)).withColumns({a: F.col(a) - first[a] for a in wanted})


def _source(i: Column, size: int, mode: str) -> Column:
    """The position inside 0..size-1 that padding at i repeats."""
    if mode == "replicate":
        return F.least(F.greatest(i, F.lit(0)), F.lit(size - 1))
    if mode == "circular":
        return F.pmod(i, F.lit(size))
    period = max(2 * (size - 1), 1)  # reflect
    m = F.pmod(i, F.lit(period))
    return F.least(m, F.lit(period) - m) if size > 1 else F.lit(0)


def _paired(shift: int, size: int, mode: str):
    return lambda i: F.struct(i.alias("i"), _source(i - shift, size, mode).alias("source"))


def _from(axis: str):
    return lambda p: p["source"] == F.col(axis)


def padded_centre(df: DataFrame, sizes: dict[str, int], wanted: dict[str, int], mode: str = "constant", value: float = 0.0, column: str = "v") -> DataFrame:
    """The array in the middle of a larger one: ``value`` around it, or what reflect, replicate or circular padding repeats.

    Other axes than the padded ones keep the values that occur in them.
    """
    rest = [c for c in df.columns if c not in sizes and c != column]
    before = {a: (wanted[a] - sizes[a]) // 2 for a in wanted}
    if mode != "constant":  # each position of the old array says where it is seen
        out = df
        for a in wanted:
            shift, size = before[a], sizes[a]
            places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(wanted[a] - 1)), _paired(shift, size, mode)), _from(a))
            out = out.withColumn("_p", F.explode(places)).withColumn(a, F.col("_p.i").cast("long")).drop("_p")
        return out
    grid = df.select(*rest).distinct() if rest else df.sparkSession.range(1).select()
    for a in wanted:
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wanted[a] - 1).cast("long"))))
    placed = df.withColumns({a: (F.col(a) + before[a]).cast("long") for a in wanted})
    return grid.join(placed, [*rest, *wanted], "left").withColumn(column, F.coalesce(column, F.lit(value)))


def upsampled(df: DataFrame, axes: Sequence[str], factors: Sequence[int], value_scale: float = 1.0, column: str = "v") -> DataFrame:
    """Nearest neighbours at an integer factor; ``value_scale`` multiplies the values, as displacements need it."""
    out = df
    for a, f in zip(axes, factors):
        out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(f - 1)))).withColumn(a, F.col(a) * f + F.col("_k")).drop("_k")
    return out.withColumn(column, F.col(column) * F.lit(value_scale)) if value_scale != 1 else out


def upsampled_linear(df: DataFrame, axis: str, size: int, factor: int, column: str = "v") -> DataFrame:
    """Linear interpolation along an axis by an integer factor, pixel centres aligned (ends are repeated).

    Each old position adds its share to the new ones within reach: one grouped sum, no join.
    """
    rest = [c for c in df.columns if c not in (axis, column)]
    spread = df.withColumn("_j", F.explode(F.sequence(F.greatest(F.lit(0), F.col(axis) * factor - factor), F.least(F.lit(size * factor - 1), F.col(axis) * factor + 2 * factor - 1))))
    at = F.least(F.greatest((F.col("_j") + 0.5) / factor - 0.5, F.lit(0.0)), F.lit(float(size - 1)))
    weight = F.greatest(F.lit(0.0), 1 - F.abs(at - F.col(axis)))
    return spread.groupBy(*rest, F.col("_j").alias(axis)).agg(F.sum(F.col(column) * weight).alias(column))


def thresholded(df: DataFrame, threshold: float, column: str = "v") -> DataFrame:
    """A resampled mask as zeros and ones."""
    return df.withColumn(column, (F.col(column) > threshold).cast("int"))


def eroded(df: DataFrame, axes: Sequence[str], sizes: dict[str, int], steps: int, column: str = "v") -> DataFrame:
    """Non-zero positions whose neighbours along the axes within ``steps`` are all non-zero (outside counts as non-zero).

    Zeros reach out to what they erase: an equi-join on positions.
    """
    zeros = df.where(F.col(column) == 0).select(*axes)
    reach = fold(lambda d, a: d.unionByName(zeros.withColumn(a, F.explode(F.sequence(F.greatest(F.col(a) - steps, F.lit(0)), F.least(F.col(a) + steps, F.lit(sizes[a] - 1)))))), axes, zeros).distinct()
    return df.where(F.col(column) != 0).join(reach, list(axes), "left_anti")


def pixel_error(a: DataFrame, b: DataFrame, axes: Sequence[str], sizes: dict[str, int], steps: int = 0) -> DataFrame:
    """|a - b| where both survive erosion, else 0."""
    x, y = a.withColumnRenamed("v", "va"), b.withColumnRenamed("v", "vb")
    alive = eroded(a, axes, sizes, steps).select(*axes).join(eroded(b, axes, sizes, steps).select(*axes), list(axes)).withColumn("alive", F.lit(True))
    both = x.join(y, list(axes)).join(alive, list(axes), "left")
    return both.select(*axes, F.when(F.col("alive"), F.abs(F.col("va") - F.col("vb"))).otherwise(F.lit(0.0)).alias("v"))


def erode_combined(a: DataFrame, b: DataFrame, axes: Sequence[str], sizes: dict[str, int], steps: int = 0) -> DataFrame:
    """a or b where only one survives erosion, their mean where both do, else 0."""
    x, y = eroded(a, axes, sizes, steps).withColumnRenamed("v", "va"), eroded(b, axes, sizes, steps).withColumnRenamed("v", "vb")
    grid = a.select(*axes).union(b.select(*axes)).distinct()
    both = grid.join(x, list(axes), "left").join(y, list(axes), "left")
    mean = (F.col("va") + F.col("vb")) / 2
    return both.select(*axes, F.coalesce(mean, "va", "vb", F.lit(0.0)).alias("v"))


def touches_edge(df: DataFrame, by: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """Whether any position of each group lies on the border of the named axes."""
    on = fold(lambda x, y: x | y, [(F.col(a) == 0) | (F.col(a) == n - 1) for a, n in sizes.items()])
    return df.groupBy(*by).agg(F.bool_or(on).alias("touches"))


def blacked_out(df: DataFrame, label: str, listed: DataFrame) -> DataFrame:
    """Labels of a list set to zero."""
    hit = listed.select(label).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, label, "left").withColumn(label, F.when(F.col("_hit"), F.lit(0)).otherwise(F.col(label))).drop("_hit").select(*df.columns)


def common_least(df: DataFrame, layer: str, value: str) -> DataFrame:
    """One row: the smallest value that every layer has; null without any."""
    each = df.select(layer, value).distinct()
    n = each.agg(F.count_distinct(layer).alias("n"))  # one row
    full = each.groupBy(value).agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n"))
    return full.agg(F.min(value).alias(value))
