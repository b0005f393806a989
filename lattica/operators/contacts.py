"""Contact extraction between segments: faces, pairs, filters, centres and records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def axis_faces(voxels: DataFrame, axis: str, label: str = "label") -> DataFrame:
    """(seg_a, seg_b, x, y, z): faces along one axis where the label changes between neighbours that are not background."""
    here = voxels.where(F.col(label) != 0).select(*AXES, F.col(label).alias("here"))
    there = here.select(*[(F.col(a) - 1 if a == axis else F.col(a)).alias(a) for a in AXES], F.col("here").alias("there"))
    centre = [(F.col(a) + 0.5 if a == axis else F.col(a).cast("double")).alias(a) for a in AXES]
    return here.join(there, list(AXES)).where("here <> there").select(F.least("here", "there").alias("seg_a"), F.greatest("here", "there").alias("seg_b"), *centre)


def faces(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Faces along all axes."""
    return reduce(DataFrame.unionByName, [axis_faces(voxels, a, label) for a in AXES])


def affinities(voxels: DataFrame, shift: Sequence[int], label: str = "label") -> DataFrame:
    """(x, y, z, aff): 1 where a voxel and the one ``shift`` away share a label that is not background, else 0."""
    there = voxels.select(*[(F.col(a) - s).alias(a) for a, s in zip(AXES, shift)], F.col(label).alias("there"))
    return voxels.join(there, list(AXES)).select(*AXES, ((F.col(label) == F.col("there")) & (F.col(label) != 0)).cast("int").alias("aff"))


def weighted_centre(points: DataFrame, by: Sequence[str], weight: str, axes: Sequence[str] = AXES, scale: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """Centre of each group weighted by ``weight``, or the plain mean where the weights do not sum to more than zero."""
    total = F.sum(weight)
    aggregates = [(F.when(total > 0, F.try_divide(F.sum(F.col(a) * F.col(weight)), total)).otherwise(F.avg(a)) * s).alias(f"com_{a}") for a, s in zip(axes, scale)]
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(weight).alias("mean_weight"), *aggregates)


def drop_groups_touching(points: DataFrame, by: Sequence[str], on_boundary: Column) -> DataFrame:
    """Rows of the groups of which no row lies on the boundary."""
    touching = points.where(on_boundary).select(*by).distinct()
    return points.join(touching, list(by), "left_anti")


def above_mean(points: DataFrame, by: Sequence[str], weight: str, threshold: float) -> DataFrame:
    """Rows of the groups whose mean weight reaches the threshold; all rows if it is not positive."""
    if threshold <= 0:
        return points
    return points.join(points.groupBy(*by).agg(F.avg(weight).alias("_mean")).where(F.col("_mean") >= threshold).select(*by), list(by), "left_semi")


def nearest_to_mean(points: DataFrame, by: Sequence[str], axes: Sequence[str] = AXES) -> DataFrame:
    """The member of each group that is nearest to its mean; the smallest among equals."""
    means = points.groupBy(*by).agg(*[F.avg(a).alias(f"m_{a}") for a in axes])
    d2 = reduce(lambda p, q: p + q, [(F.col(a) - F.col(f"m_{a}")) * (F.col(a) - F.col(f"m_{a}")) for a in axes])
    near = points.join(means, list(by)).groupBy(*by).agg(F.min(F.struct(F.round(d2, 9).alias("d2"), *axes)).alias("best"))
    return near.select(*by, *[F.col(f"best.{a}").alias(a) for a in axes])


def contact_records(points: DataFrame, overlaps: DataFrame, by: Sequence[str], weight: str, min_count: int, min_mean: float, boundary: Column, overlap_threshold: int) -> DataFrame:
    """The whole pipeline: pairs off the boundary with enough faces and mean weight, their centre, representative
    point, and whether the two sides' references have a member in common (should_merge).

    ``by`` names the two segment columns.
    """
    a, b = by
    kept = above_mean(drop_groups_touching(points, by, boundary), by, weight, min_mean)
    centre = weighted_centre(kept, by, weight).where(F.col("n") >= min_count)
    best = nearest_to_mean(kept, by)
    refs = overlaps.where(F.col("n") >= overlap_threshold).groupBy("seg").agg(F.collect_set("ref").alias("refs"))
    left, right = refs.select(F.col("seg").alias(a), F.col("refs").alias("refs_a")), refs.select(F.col("seg").alias(b), F.col("refs").alias("refs_b"))
    out = centre.join(best, list(by)).join(left, a, "left").join(right, b, "left")
    return out.withColumn("should_merge", F.coalesce(F.arrays_overlap("refs_a", "refs_b"), F.lit(False))).drop("refs_a", "refs_b")
