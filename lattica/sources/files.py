"""Files of points, annotations and ledgers as tables.

Malformed rows raise when they are read: a wrong coordinate must not become a null one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tables(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Parquet files of a glob (or several) as one table; columns are told by name, missing ones are null."""
    return spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line annotations of a JSON array: id and the two ends as arrays of three numbers."""
    rows = spark.read.schema("id string, pointA array<double>, pointB array<double>").option("multiLine", "true").json(path)
    return rows.select("id", _triple(F.col("pointA"), "pointA").alias("a"), _triple(F.col("pointB"), "pointB").alias("b"))


def _triple(point: Column, name: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"{name} is not three numbers: "), F.coalesce(F.to_json(point), F.lit("null")))).cast("array<double>")
    return F.when((F.size(point) == 3) & ~F.exists(point, lambda x: x.isNull()), point).otherwise(bad)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z) of a JSON file: a list of triples, or an object whose ``segments`` hold a ``centroid`` each."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    listed = F.from_json("doc", "array<array<double>>")
    named = F.map_values(F.from_json("doc", "struct<segments: map<string, struct<centroid: array<double>>>>")["segments"])
    points = F.when(F.ltrim("doc").startswith("["), listed).otherwise(F.transform(named, lambda v: v["centroid"]))
    rows = whole.select(F.explode(points).alias("p")).select(_triple(F.col("p"), "coordinate").alias("p"))
    return rows.select(*(F.col("p")[i].alias(a) for i, a in enumerate("xyz")))


def read_points(spark: SparkSession, url: str, name: str, where: str = "true", id_col: str = "id", point_col: str = "pt_position", units: Sequence[float] = (1, 1, 1), **options) -> DataFrame:
    """(id, x, y, z) of a database table with point columns, in nm; the condition and the projection run in the database."""
    query = f"SELECT {id_col} AS id, ST_X({point_col}) AS x, ST_Y({point_col}) AS y, ST_Z({point_col}) AS z FROM {name} WHERE {where}"
    rows = spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    return rows.withColumns({a: F.col(a) * float(u) for a, u in zip("xyz", units)})


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Points and boxes of a JSON annotation layer in nm: kind, and the corners a and b (equal for a point)."""
    kind = "struct<type: string, point: array<double>, pointA: array<double>, pointB: array<double>>"
    rows = spark.read.schema(f"resolution array<double>, annotations array<{kind}>").option("multiLine", "true").json(path)
    each = rows.select("resolution", F.explode("annotations").alias("a"))
    nm = lambda p: F.zip_with(p, F.col("resolution"), lambda x, r: x * r)
    return each.select(F.coalesce("a.type", F.when(F.col("a.point").isNotNull(), "point").otherwise("axis_aligned_bounding_box")).alias("kind"), nm(F.coalesce("a.point", "a.pointA")).alias("a"), nm(F.coalesce("a.point", "a.pointB")).alias("b"))


def lines_of(df: DataFrame, start: Sequence[str], stop: Sequence[str], id_col: str) -> DataFrame:
    """Rows as lines: id and both ends as arrays."""
    return df.select(F.col(id_col).alias("id"), F.array(*start).cast("array<double>").alias("a"), F.array(*stop).cast("array<double>").alias("b"))


def nonempty_chunks(df: DataFrame, axes: Sequence[str], size: Sequence[int]) -> DataFrame:
    """The distinct chunk numbers that hold a row: distinct in every partition first, then over all."""
    return df.select(*(F.floor(F.col(a) / s).cast("long").alias(f"c{a}") for a, s in zip(axes, size))).distinct()


def with_children(df: DataFrame, key: Sequence[str], child: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(parents with an id, children that name it): the id is a hash of the key, so that both writes agree without a shared counter."""
    tagged = df.withColumn("id", F.xxhash64(*key).bitwiseAND((1 << 62) - 1))
    return tagged.drop(*child), tagged.select(F.col("id").alias("parent_id"), *(F.col(c).alias(n) for c, n in child.items()))


def record_done(ids: DataFrame, path: str, name: str) -> None:
    """Completed ids appended to a ledger."""
    ids.select(F.lit(name).alias("checkpoint"), "id", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def still_open(ids: DataFrame, path: str) -> DataFrame:
    """The ids that no checkpoint of the ledger names."""
    return ids.join(ids.sparkSession.read.parquet(path).select("id").distinct(), "id", "left_anti")
