"""Task records, price lookups, cost roll-ups and comparisons of keyed sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_prices(prices: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """The price of the keys that have exactly one; ambiguous keys have none."""
    return prices.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(price).alias(price)).where("_n = 1").drop("_n")


def costs(usage: DataFrame, prices: DataFrame, keys: Sequence[str], hours: Column, price: str, by: str) -> DataFrame:
    """Cost and hours by group and in total (group null); usage without a price costs nothing."""
    priced = usage.join(unique_prices(prices, keys, price), list(keys), "left").withColumn("_h", hours)
    return priced.rollup(by).agg(F.sum("_h").alias("hours"), F.sum(F.col("_h") * F.coalesce(F.col(price), F.lit(0.0))).alias("cost"))


def compared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of two sets, told as both, left or right."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right").alias("side"))


def ready(dependencies: DataFrame, item: str, satisfied: Column) -> DataFrame:
    """(item, n, n_open, is_ready): an item is ready when all it depends on is satisfied."""
    return dependencies.groupBy(item).agg(F.count("*").alias("n"), F.count_if(~satisfied).alias("n_open")).withColumn("is_ready", F.col("n_open") == 0)


def counted(df: DataFrame, values: Sequence[str], column: str) -> DataFrame:
    """Rows of each of the given values, zero where there are none."""
    fixed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(fixed).join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def stale(runs: DataFrame, beats: DataFrame, run: str, now: Column, lookback_seconds: int) -> DataFrame:
    """Runs of either table whose last sign of life, the beat or else the start, is older than the lookback."""
    out = runs.join(beats, run, "full").withColumn("seen", F.coalesce("beat", "started"))
    return out.where(F.coalesce(F.unix_micros(F.col("seen").cast("timestamp")), F.lit(0)) < F.unix_micros(now) - lookback_seconds * 1_000_000)


def retried(queue: DataFrame, failed: DataFrame, key: str, max_retries: int) -> DataFrame:
    """The queue after failures: one more retry, and status failed once the limit is reached (none if it is not positive)."""
    hit = failed.select(key).distinct().withColumn("_failed", F.lit(True))
    n = F.when(F.col("_failed"), F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    over = F.lit(max_retries > 0) & (n >= max_retries)
    out = queue.join(hit, key, "left")
    return out.withColumns({"retry_count": n, "status": F.when(F.col("_failed"), F.when(over, "failed").otherwise("pending")).otherwise(F.col("status"))}).drop("_failed")
