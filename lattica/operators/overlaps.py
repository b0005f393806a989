"""Overlap statistics between segments and reference components; label 0 is background everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_counts(cells: DataFrame, seg: str, ref: str) -> DataFrame:
    """(seg, ref, n): shared cells of every pair."""
    return cells.where((F.col(seg) != 0) & (F.col(ref) != 0)).groupBy(F.col(seg).alias("seg"), F.col(ref).alias("ref")).agg(F.count("*").alias("n"))


def merger_segments(overlaps: DataFrame, threshold: int) -> DataFrame:
    """Segments that overlap two or more references by the threshold each."""
    return overlaps.where(F.col("n") >= threshold).groupBy("seg").agg(F.count("*").alias("n_refs")).where("n_refs >= 2")


def unclaimed_segments(segments: DataFrame, overlaps: DataFrame, threshold: int) -> DataFrame:
    """(seg, most): segments whose largest overlap is below the threshold, or that have none."""
    best = overlaps.groupBy("seg").agg(F.max("n").alias("most"))
    return segments.join(best, "seg", "left").withColumn("most", F.coalesce("most", F.lit(0).cast("long"))).where(F.col("most") < threshold)


def small_segments(cells: DataFrame, seg: str, threshold: int) -> DataFrame:
    return cells.where(F.col(seg) != 0).groupBy(F.col(seg).alias("seg")).agg(F.count("*").alias("n")).where(F.col("n") < threshold)


def references_of(overlaps: DataFrame, threshold: int) -> DataFrame:
    """(seg, refs): the sorted references that a segment overlaps by the threshold."""
    return overlaps.where(F.col("n") >= threshold).groupBy("seg").agg(F.sort_array(F.collect_set("ref")).alias("refs"))


def modal_label(cells: DataFrame, by: list[str], label: str) -> DataFrame:
    """Most frequent non-zero label of each group, the smallest among equals, and its count."""
    counts = cells.where(F.col(label) != 0).groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max_by(F.struct("label", "n"), F.struct(F.col("n"), -F.col("label"))).alias("top")).select(*by, "top.label", "top.n")
