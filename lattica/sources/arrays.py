"""Array layers: one row per chunk, with the chunk's values in an array, read and written in long form.

The table of a layer has columns cx, cy, cz (chunk numbers) and data (values, the last axis running fastest).
Parquet's statistics on the chunk numbers prune what a box does not touch.  Positions outside the layer, and
chunks never written, read as zero.  A chunk's array is bounded by the chunk size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits

AXES = ("x", "y", "z")
CELLS = ("cx", "cy", "cz")


def chunked(df: DataFrame, chunk: Sequence[int], value: str = "v", fill: float = 0, bounds: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Rows (x, y, z, value) as chunks; what lies outside ``bounds`` is left out, of repeated positions the largest value counts."""
    if bounds is not None:
        for a, (lo, hi) in zip(AXES, bounds):
            df = df.where((F.col(a) >= lo) & (F.col(a) < hi))
    place = F.lit(0)
    for a, c in zip(AXES, chunk):
        place = place * c + F.pmod(F.col(a), F.lit(c))
    cells = [F.floor(F.col(a) / c).cast("long").alias(n) for a, n, c in zip(AXES, CELLS, chunk)]
    one = df.groupBy(*cells, place.cast("int").alias("place")).agg(F.max(value).alias("v"))
    held = one.groupBy(*CELLS).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))
    kind = df.schema[value].dataType.simpleString()
    return held.select(*CELLS, F.transform(F.sequence(F.lit(0), F.lit(math.prod(chunk) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(fill).cast(kind))).alias("data"))


def write_array(df: DataFrame, path: str, chunk: Sequence[int], value: str = "v", bounds: Sequence[tuple[int, int]] | None = None) -> None:
    """Adds chunks to a layer; chunks written before are replaced (read the old ones, write the whole anew elsewhere and
    swap: here both live in one folder per write, the later one wins)."""
    rows = chunked(df, chunk, value, bounds=bounds).withColumn("version", F.current_timestamp())
    rows.repartitionByRange(*CELLS).write.mode("append").parquet(path)


def commit_chunks(df: DataFrame, path: str, chunk: Sequence[int], value: str = "v", bounds: Sequence[tuple[int, int]] | None = None, fill: float = 0, delete_empty: bool = False, unsigned: bool = False, base: int | None = None) -> int:
    """Writes chunks as one commit of a layer with versions (see ``commits``) and gives its number.

    ``delete_empty`` deletes chunks that hold nothing but ``fill``; ``unsigned`` raises on a negative value.
    """
    spark = df.sparkSession
    base = commits.latest(spark, path) if base is None else base
    if unsigned:
        df = df.withColumn(value, F.when(F.col(value) < 0, F.raise_error(F.lit("negative value in an unsigned layer")).cast(df.schema[value].dataType)).otherwise(F.col(value)))
    rows = chunked(df, chunk, value, fill, bounds)
    kept = rows.where(F.exists("data", lambda v: v != fill)) if delete_empty else rows
    touched = rows.select(*CELLS) if base else None
    return commits.commit(spark, path, {"chunks": kept}, CELLS, touched, base)


def delete_chunks(spark: SparkSession, path: str, cells: DataFrame, base: int | None = None) -> int:
    """Deletes the chunks of given numbers (cx, cy, cz) in one commit; chunks that are not there are no error."""
    base = commits.latest(spark, path) if base is None else base
    none = commits.read(spark, path, "chunks", CELLS, base).where("false")
    return commits.commit(spark, path, {"chunks": none}, CELLS, cells.select(*[F.col(c).cast("long") for c in CELLS]), base)


def compact_chunks(spark: SparkSession, path: str) -> int:
    """Writes the newest version as a whole one, so that reads join nothing; gives its number."""
    return commits.compacted(spark, path, ["chunks"], CELLS)


def version_chunks(spark: SparkSession, path: str, version: int | None = None, box: Sequence[tuple[int, int]] | None = None, chunk: Sequence[int] | None = None) -> DataFrame:
    """The chunks of a version, those that a box touches where one is given."""
    df = commits.read(spark, path, "chunks", CELLS, version)
    for n, (lo, hi), c in zip(CELLS, box or (), chunk or ()):
        df = df.where((F.col(n) >= math.floor(lo / c)) & (F.col(n) <= math.floor((hi - 1) / c)))
    return df


def read_chunks(spark: SparkSession, path: str, box: Sequence[tuple[int, int]], chunk: Sequence[int]) -> DataFrame:
    """The newest version of each chunk that a box touches."""
    df = spark.read.parquet(path)
    for n, (lo, hi), c in zip(CELLS, box, chunk):
        df = df.where((F.col(n) >= math.floor(lo / c)) & (F.col(n) <= math.floor((hi - 1) / c)))
    return df.groupBy(*CELLS).agg(F.max_by("data", "version").alias("data"))


def cutout(chunks: DataFrame, box: Sequence[tuple[int, int]], chunk: Sequence[int], filled: bool = False, value: str = "v") -> DataFrame:
    """(x, y, z, value) of all positions of a box that chunks hold; ``filled`` adds the others as zero."""
    rows = chunks.select(*CELLS, F.posexplode("data").alias("place", value))
    size = math.prod(chunk)
    for a, n, c in zip(AXES, CELLS, chunk):
        size //= c
        rows = rows.withColumn(a, F.col(n) * c + F.pmod(F.floor(F.col("place") / size), F.lit(c)))
    rows = rows.select(*AXES, value)
    for a, (lo, hi) in zip(AXES, box):
        rows = rows.where((F.col(a) >= lo) & (F.col(a) < hi))
    return constant(chunks.sparkSession, box, None, value).drop(value).join(rows, list(AXES), "left").withColumn(value, F.coalesce(value, F.lit(0))) if filled else rows


def constant(spark: SparkSession, box: Sequence[tuple[int, int]], value, name: str = "v") -> DataFrame:
    """A box of one value, made where it is read: no position passes the driver."""
    sizes = [hi - lo for lo, hi in box]
    out, step, n = spark.range(math.prod(sizes)), 1, {}
    for a, (lo, _), s in reversed(list(zip(AXES, box, sizes))):
        n[a] = F.pmod(F.floor(F.col("id") / step), F.lit(s)) + lo
        step *= s
    return out.select(*(n[a].cast("long").alias(a) for a in AXES), F.lit(value).alias(name))


def together(layers: dict[str, DataFrame], value: str = "v") -> DataFrame:
    """Layers read as one: a column for each, at the positions that all of them have."""
    out = None
    for name, df in layers.items():
        own = df.select(*AXES, F.col(value).alias(name))
        out = own if out is None else out.join(own, list(AXES))
    return out


def apart(df: DataFrame, names: Sequence[str]) -> dict[str, DataFrame]:
    """The layers of a joint table, each to be written by itself."""
    return {n: df.select(*AXES, F.col(n).alias("v")) for n in names}
