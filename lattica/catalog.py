"""Tables by name: each is a lazy DataFrame of one parquet path."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Fixed names of the tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"no such table: {name}")
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))
