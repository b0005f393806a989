"""Tabular layers: a table dealt into spatial chunks, with its geometry in an info file.

A layer is a folder with ``info.json`` and parquet data partitioned by
(cx, cy, cz).  Boxes prune partitions before any file is opened; a write
replaces the chunks that it touches and leaves the others.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spatial import chunk_index, contains

CELLS = ("cx", "cy", "cz")


@dataclass(frozen=True)
class LayerInfo:
    resolution: tuple[float, float, float]
    voxel_offset: tuple[int, int, int]
    size: tuple[int, int, int]
    chunk_size: tuple[int, int, int]
    schema: str

    def bounds(self) -> list[tuple[float, float]]:
        return [(o * r, (o + s) * r) for o, s, r in zip(self.voxel_offset, self.size, self.resolution)]


def _text(spark: SparkSession, path: str) -> str | None:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0].content).decode() if rows else None


def read_info(spark: SparkSession, root: str) -> LayerInfo:
    """The layer's geometry; FileNotFoundError if there is none."""
    try:
        text = _text(spark, f"{root}/info.json")
    except Exception as e:
        raise FileNotFoundError(f"no layer in {root}") from e
    raw = json.loads(text or "{}")
    return LayerInfo(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def write_info(spark: SparkSession, root: str, info: LayerInfo, overwrite: bool = False) -> None:
    """Writes the geometry; an existing one must be equal unless overwritten."""
    try:
        old = read_info(spark, root)
    except FileNotFoundError:
        old = None
    if old is not None and old != info and not overwrite:
        differ = [k for k in asdict(info) if getattr(old, k) != getattr(info, k)]
        raise RuntimeError(f"layer exists with other {', '.join(differ)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/info.json")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(json.dumps(asdict(info)).encode()))
    out.close()


def with_chunks(df: DataFrame, info: LayerInfo, point: Sequence[str]) -> DataFrame:
    """Rows with the grid index of their point (nm); points outside the layer raise."""
    at = chunk_index([F.col(p) for p in point], info.resolution, info.voxel_offset, info.chunk_size)
    inside = contains([F.col(p) for p in point], info.bounds())
    return df.withColumns({c: F.when(inside, a).otherwise(F.raise_error("point outside the layer").cast("long")) for c, a in zip(CELLS, at)})


def write_rows(df: DataFrame, root: str, point: Sequence[str]) -> None:
    """Replaces every chunk that has rows in ``df``."""
    info = read_info(df.sparkSession, root)
    out = with_chunks(df, info, point).repartition(*CELLS)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CELLS).parquet(f"{root}/data")


def read_box(spark: SparkSession, root: str, point: Sequence[str], start: Sequence[float], stop: Sequence[float]) -> DataFrame:
    """Rows whose point lies in the half-open box in nm; only chunks that it touches are read."""
    info = read_info(spark, root)
    fields = ", ".join([info.schema, *(f"{c} long" for c in CELLS)])
    df = spark.read.schema(fields).parquet(f"{root}/data")
    for c, a, b, r, o, s in zip(CELLS, start, stop, info.resolution, info.voxel_offset, info.chunk_size):
        low, high = int((a / r - o) // s), int(((b - 1e-3) / r - o) // s)
        df = df.where((F.col(c) >= low) & (F.col(c) <= high))
    return df.where(contains([F.col(p) for p in point], list(zip(start, stop)))).drop(*CELLS)


def chunk_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every chunk of the grid, zero for empty ones."""
    from ..functions.spatial import grid

    info = read_info(spark, root)
    shape = [-(-s // c) for s, c in zip(info.size, info.chunk_size)]
    fields = ", ".join([info.schema, *(f"{c} long" for c in CELLS)])
    counts = spark.read.schema(fields).parquet(f"{root}/data").groupBy(*CELLS).agg(F.count("*").alias("n"))
    return grid(spark, shape).drop("n").join(counts, list(CELLS), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def read_text_table(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    """CSV or JSON rows read as text and cast, so that 64-bit ids beyond 2**53 stay whole."""
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names))
    df = raw.option("header", True).csv(path) if fmt == "csv" else raw.option("primitivesAsString", True).json(path)
    types = spark.createDataFrame([], schema).schema
    return df.select(*[F.col(f.name).try_cast(f.dataType.simpleString()).alias(f.name) for f in types.fields])


def delete_chunks(spark: SparkSession, root: str, chunks: Sequence[Sequence[int]]) -> int:
    """Removes the given chunks (cx, cy, cz) and says how many there were; rows of others stay."""
    found = 0
    for cx, cy, cz in chunks:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/cx={cx}/cy={cy}/cz={cz}")
        found += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return found


def serialised(df: DataFrame, fmt: str) -> DataFrame:
    """Every row as one text (column ``line``): csv fields or a json record, in the order of the columns; nulls are empty or left out."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"no text format {fmt}")
    return df.select((F.to_csv if fmt == "csv" else F.to_json)(F.struct(*df.columns)).alias("line"))


def write_text_table(df: DataFrame, path: str, fmt: str) -> None:
    """Rows as csv files with a header, or as json records."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"no text format {fmt}")
