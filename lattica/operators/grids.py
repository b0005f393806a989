"""Stencils, resampling and blending on voxels in long form (one row a voxel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def footprint(shape: str, radius: int) -> list[tuple[int, int]]:
    """Offsets in x and y of a kernel: square, diamond or disk."""
    span = range(-radius, radius + 1)
    inside = {"square": lambda i, j: True, "diamond": lambda i, j: abs(i) + abs(j) <= radius, "disk": lambda i, j: i * i + j * j <= radius * radius}[shape]
    return [(i, j) for i in span for j in span if inside(i, j)]


def morphology(voxels: DataFrame, value: str, offsets: Sequence[tuple[int, int]], erode: bool) -> DataFrame:
    """Grey erosion or dilation within each z: the least or greatest value under the kernel, outside ignored.

    Every voxel sends its value to its neighbours, so one partial aggregation and one shuffle do.
    """
    moves = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in offsets])
    sent = voxels.select(*AXES, F.col(value).alias("v"), F.explode(moves).alias("m")).select((F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), "z", "v")
    best = sent.groupBy(*AXES).agg((F.min if erode else F.max)("v").alias(value))
    return best.join(voxels.select(*AXES), list(AXES), "left_semi")


def opening(voxels: DataFrame, value: str, offsets) -> DataFrame:
    return morphology(morphology(voxels, value, offsets, True), value, offsets, False)


def closing(voxels: DataFrame, value: str, offsets) -> DataFrame:
    return morphology(morphology(voxels, value, offsets, False), value, offsets, True)


def coarse(factor: Sequence[int]) -> list[Column]:
    return [F.floor(F.col(a) / f).cast("long").alias(a) for a, f in zip(AXES, factor)]


def downsample_mean(voxels: DataFrame, value: str, factor: Sequence[int]) -> DataFrame:
    return voxels.groupBy(*coarse(factor)).agg(F.avg(value).alias(value))


def downsample_mode(voxels: DataFrame, label: str, factor: Sequence[int]) -> DataFrame:
    """The most frequent label of each block, the smallest among equals."""
    counts = voxels.groupBy(*coarse(factor), F.col(label).alias("l")).agg(F.count("*").alias("n"))
    return counts.groupBy(*AXES).agg(F.max_by("l", F.struct(F.col("n"), -F.col("l"))).alias(label))


def pyramid(voxels: DataFrame, value: str, factors: Sequence[Sequence[int]], labels: bool) -> dict[int, DataFrame]:
    """Levels 1, 2, ..., each made of the one before."""
    out, now = {}, voxels
    for level, factor in enumerate(factors, 1):
        now = (downsample_mode if labels else downsample_mean)(now, value, factor)
        out[level] = now
    return out


def first_hit(voxels: DataFrame, value: str, axis: str = "z", background: int = 0, last: bool = False) -> DataFrame:
    """First (or last) value along an axis that is not background."""
    keep = [a for a in AXES if a != axis]
    return voxels.where(F.col(value) != background).groupBy(*keep).agg((F.max_by if last else F.min_by)(value, axis).alias(value), (F.max if last else F.min)(axis).alias(axis))


def ramp(kind: str, t: Column) -> Column:
    """Weight at t in (0, 1) of the way into an overlap; the two sides' weights sum to one."""
    if kind == "linear":
        return t
    if kind == "quadratic":
        return F.when(t < 0.5, 2 * t * t).otherwise(1 - 2 * (1 - t) * (1 - t))
    if kind == "bump":
        up, down = F.exp(-1 / (1 - (t - 1) * (t - 1))), F.exp(-1 / (1 - t * t))
        return up / (up + down)
    raise ValueError(f"no such blending: {kind}")


def overlapped(df: DataFrame, at: str, size: int, overlap: int, start: int, stop: int) -> DataFrame:
    """Rows repeated for every chunk of a line whose padded range holds them: chunk, first, last (exclusive)."""
    step, half = size, overlap
    low = F.greatest(F.floor((F.col(at) - start - half) / step).cast("long"), F.lit(0).cast("long"))
    count = -(-(stop - start) // size)
    high = F.least(F.floor((F.col(at) - start + half) / step).cast("long"), F.lit(count - 1).cast("long"))
    out = df.withColumn("chunk", F.explode(F.sequence(low, high)))
    return out.withColumn("first", F.lit(start) + F.col("chunk") * step).withColumn("last", F.col("first") + step).withColumn("n_chunks", F.lit(count))


def blend_weight(kind: str, at: str, overlap: int) -> Column:
    """Weight of a row in its chunk: one inside, a ramp over the overlaps, none suppressed at the ends of the region."""
    x = F.col(at) + 0.5
    t_low, t_high = (x - (F.col("first") - overlap)) / (2 * overlap), ((F.col("last") + overlap) - x) / (2 * overlap)
    low = F.when((F.col("chunk") == 0) | (t_low >= 1), F.lit(1.0)).otherwise(ramp(kind, t_low))
    high = F.when((F.col("chunk") == F.col("n_chunks") - 1) | (t_high >= 1), F.lit(1.0)).otherwise(ramp(kind, t_high))
    return low * high


def blend(df: DataFrame, at: str, value: Column, kind: str, overlap: int) -> DataFrame:
    """Overlapping rows reduced to one for each place: a weighted sum, or for ``max`` the greatest, from zero on."""
    if kind == "max":
        return df.groupBy(at).agg(F.greatest(F.max(value), F.lit(0.0)).alias("value"))
    return df.groupBy(at).agg(F.sum(blend_weight(kind, at, overlap) * value).alias("value"))


def overlapped_on(df: DataFrame, axes: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """Rows repeated for every chunk of a grid whose padded box holds them.

    ``axes`` gives (size, overlap, start, stop) of each axis; a row gets c_<axis>, first_<axis>, last_<axis> and n_<axis>.
    """
    names = ("chunk", "first", "last", "n_chunks")
    for a, (size, overlap, start, stop) in axes.items():
        df = overlapped(df, a, size, overlap, start, stop).withColumnsRenamed({n: f"{s}_{a}" for n, s in zip(names, ("c", "first", "last", "n"))})
    return df


def weight_on(kind: str, axes: dict[str, tuple[int, int, int, int]], open_faces: Sequence[tuple[str, int]] = ()) -> Column:
    """The product of the axes' weights of a row in its chunk: ramps over the overlaps, none at the ends of the region.

    ``open_faces`` name ends of the region, (axis, -1 or 1), that get a ramp all the same.
    """
    weight = F.lit(1.0)
    for a, (_, overlap, _, _) in axes.items():
        if not overlap:
            continue
        x, c = F.col(a) + 0.5, F.col(f"c_{a}")
        t_low, t_high = (x - (F.col(f"first_{a}") - overlap)) / (2 * overlap), (F.col(f"last_{a}") + overlap - x) / (2 * overlap)
        ends = (F.lit(False) if (a, -1) in open_faces else c == 0, F.lit(False) if (a, 1) in open_faces else c == F.col(f"n_{a}") - 1)
        for t, end in ((t_low, ends[0]), (t_high, ends[1])):
            weight = weight * F.when(end | (t >= 1), F.lit(1.0)).otherwise(ramp(kind, t))
    return weight


def blend_on(df: DataFrame, axes: dict[str, tuple[int, int, int, int]], value: Column, kind: str, whole: bool = False, open_faces: Sequence[tuple[str, int]] = ()) -> DataFrame:
    """Overlapping rows of a grid of chunks reduced to one for each place by a weighted sum, or the greatest for ``max``.

    ``whole`` rounds half to even, as layers of whole values need it.
    """
    total = F.greatest(F.max(value), F.lit(0.0)) if kind == "max" else F.sum(weight_on(kind, axes, open_faces) * value)
    return df.groupBy(*axes).agg((F.bround(F.round(total, 9), 0) if whole else total).alias("value"))


def median_outliers(df: DataFrame, by: Sequence[str], value: str, sigmas: float) -> DataFrame:
    """Rows with their group's median, and the value replaced by it where it lies beyond ``sigmas`` normalised deviations."""
    median = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    off = df.join(median, list(by)).withColumn("off", F.abs(F.col(value) - F.col("median")))
    mad = off.groupBy(*by).agg((F.percentile("off", F.lit(0.5)) * 1.4826).alias("mad"))
    out = off.join(mad, list(by))
    return out.withColumn("outlier", F.col("off") > F.col("mad") * sigmas).withColumn("filtered", F.when(F.col("outlier"), F.col("median")).otherwise(F.col(value))).drop("off")


def grid_edges(voxels: DataFrame, node: str, label: str) -> DataFrame:
    """(a, b): neighbours along an axis with the same label that is not background."""
    here = voxels.where(F.col(label) != 0).select(*AXES, F.col(node).alias("a"), F.col(label).alias("l"))
    out = None
    for axis in AXES:
        there = here.select(*[(F.col(c) - 1 if c == axis else F.col(c)).alias(c) for c in AXES], F.col("a").alias("b"), F.col("l").alias("m"))
        pairs = here.join(there, list(AXES)).where("l = m").select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def blended_max(rows: DataFrame, at: str, value: Column, size: int) -> DataFrame:
    """Overlapping rows reduced to their greatest value, from zero on; chunks without any value above zero are left out."""
    one = rows.groupBy(at).agg(F.greatest(F.max(value), F.lit(0.0)).alias("value")).withColumn("chunk", F.floor(F.col(at) / size))
    filled_chunks = one.groupBy("chunk").agg(F.max("value").alias("_most")).where("_most > 0").select("chunk")
    return one.join(filled_chunks, "chunk", "left_semi").drop("chunk")
