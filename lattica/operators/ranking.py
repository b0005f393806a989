"""Top rows, winners among duplicates, fallback chains and sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_of_each(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def duplicate_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups of more than one row, with their size; null keys form no group."""
    known = df
    for c in by:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def marked_duplicates(df: DataFrame, by: Sequence[str], order: Sequence[Column], flag: str = "is_duplicate") -> DataFrame:
    """All rows; those after the first of their group are flagged."""
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1)


def rows_of_groups(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of the groups with more than one member."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n > 1").drop("_n")


def fallback_chain(parts: Sequence[DataFrame], by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """For each group the best row of the first part that has any; ``strategy`` tells which."""
    ranked = [p.withColumn("strategy", F.lit(i)) for i, p in enumerate(parts, 1)]
    every = ranked[0]
    for p in ranked[1:]:
        every = every.unionByName(p)
    return top_of_each(every, by, [F.col("strategy"), *order])


def sessions(df: DataFrame, by: Sequence[str], at: str, gap_seconds: int) -> DataFrame:
    """(by, session_start, session_end, n): runs of rows that are no more than the gap apart."""
    w = Window.partitionBy(*by).orderBy(at)
    new = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("int")
    marked = df.withColumn("_s", F.sum(F.coalesce(new, F.lit(1))).over(w))
    return marked.groupBy(*by, "_s").agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count("*").alias("n")).drop("_s")


def share_of_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each row's value as a share of the total, which is one aggregated row joined back."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.join(F.broadcast(total), F.lit(True)).withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total")
