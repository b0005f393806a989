"""Annotation layers with commits: cells of several levels, an index by id and an index by relation change at once.

All tables carry the annotation's id, and a commit touches ids: the cells of every level lose an annotation with
the index by id, in one version.  A change writes the rows of the annotations that it changes, not their cells.
Of repeated ids the first in the order of all columns counts.  Annotations without an id are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotations import cell_limits, related_index, spatial_index
from ..session import checkpointed
from . import commits

CELLS = ("cx", "cy", "cz")
NAMES = ("spatial", "by_id", "related")


class AnnotationLayer(NamedTuple):
    """Where a layer lies and how it is indexed: bounds are (low, high) columns for x, y, z, sizes the cells of each level,
    the coarsest first; ``relation`` is a column with an array of related keys, or None."""

    path: str
    bounds: Sequence[tuple[str, str]]
    sizes: Sequence[Sequence[float]]
    relation: str | None = None
    id_col: str = "id"


def _tables(layer: AnnotationLayer, df: DataFrame) -> dict[str, DataFrame]:
    related = df.select(layer.id_col, F.explode(layer.relation).alias("related")) if layer.relation else df.select(layer.id_col, F.lit(None).cast("long").alias("related")).where("false")
    cells = spatial_index(df, layer.bounds, layer.sizes)
    return {"spatial": cells.withColumns({c: F.col(c).cast("long") for c in CELLS}), "by_id": df, "related": related}


def _once(layer: AnnotationLayer, df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != layer.id_col]
    return df.where(F.col(layer.id_col).isNotNull()).groupBy(layer.id_col).agg(F.min(F.struct(*rest)).alias("r")).select(layer.id_col, "r.*").select(*df.columns)


def created(layer: AnnotationLayer, df: DataFrame) -> int:
    """Writes a layer, or replaces all of one, and gives its version."""
    spark = df.sparkSession
    return commits.commit(spark, layer.path, _tables(layer, _once(layer, df)), [layer.id_col], None, commits.latest(spark, layer.path))


def changed(layer: AnnotationLayer, new: DataFrame, gone: DataFrame | None = None, base: int | None = None) -> int:
    """Adds or replaces annotations and deletes those whose ids are in ``gone``, in one commit; gives its version."""
    spark = new.sparkSession
    base = commits.latest(spark, layer.path) if base is None else base
    one = checkpointed(_once(layer, new))
    ids = one.select(layer.id_col)
    return commits.commit(spark, layer.path, _tables(layer, one), [layer.id_col], ids if gone is None else ids.unionByName(gone.select(layer.id_col)), base)


def _in_cell(layer: AnnotationLayer, df: DataFrame, level: int, cell: Sequence[int]) -> DataFrame:
    for (a, b), c, s in zip(layer.bounds, cell, layer.sizes[level]):
        df = df.where((F.floor(F.col(a) / s) <= c) & (F.floor(F.col(b) / s) >= c))
    return df


def replaced_cell(spark: SparkSession, layer: AnnotationLayer, level: int, cell: Sequence[int], change: Callable[[DataFrame], DataFrame] | None, filter_bounds: bool = True) -> int:
    """One cell's annotations replaced by ``change`` of them, on all levels; None deletes them.

    New annotations that do not touch the cell are left out unless ``filter_bounds`` is off.
    """
    base = commits.latest(spark, layer.path)
    old = commits.read(spark, layer.path, "spatial", [layer.id_col], base).where(F.col("level") == level)
    for name, c in zip(CELLS, cell):
        old = old.where(F.col(name) == c)
    old = checkpointed(old.drop("level", *CELLS))
    new = old.where("false") if change is None else change(old)
    return changed(layer, _in_cell(layer, new, level, cell) if filter_bounds else new, old, base)


def read_all(spark: SparkSession, layer: AnnotationLayer, level: int = 0, version: int | None = None) -> DataFrame:
    """All annotations, each once, from the cells of one level."""
    rows = commits.read(spark, layer.path, "spatial", [layer.id_col], version).where(F.col("level") == level)
    return rows.drop("level", *CELLS).dropDuplicates([layer.id_col])


def read_box(spark: SparkSession, layer: AnnotationLayer, box: Sequence[tuple[float, float]], level: int, version: int | None = None) -> DataFrame:
    """The annotations whose closed bounds meet a box, from the cells of one level that it touches."""
    rows = commits.read(spark, layer.path, "spatial", [layer.id_col], version).where(F.col("level") == level)
    for name, (a, b), (lo, hi), s in zip(CELLS, layer.bounds, box, layer.sizes[level]):
        rows = rows.where(F.col(name).between(int(lo // s), int(hi // s)) & (F.col(b) >= lo) & (F.col(a) <= hi))
    return rows.drop("level", *CELLS).dropDuplicates([layer.id_col])


def read_by_id(spark: SparkSession, layer: AnnotationLayer, ids: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """The annotations of given ids, or all, from the index by id."""
    rows = commits.read(spark, layer.path, "by_id", [layer.id_col], version)
    return rows if ids is None else rows.join(ids.select(layer.id_col).distinct(), layer.id_col, "left_semi")


def read_related(spark: SparkSession, layer: AnnotationLayer, version: int | None = None) -> DataFrame:
    """(related, ids): the sorted ids of the annotations that name each key."""
    rows = commits.read(spark, layer.path, "related", [layer.id_col], version)
    return related_index(rows.withColumn("related", F.array("related")), "related", layer.id_col)


def limits(spark: SparkSession, layer: AnnotationLayer, version: int | None = None) -> DataFrame:
    """(level, n_cells, most): the cells of each level and the rows of its fullest."""
    return cell_limits(commits.read(spark, layer.path, "spatial", [layer.id_col], version))


def compacted(spark: SparkSession, layer: AnnotationLayer) -> int:
    """Writes the newest version as a whole one and gives its number."""
    return commits.compacted(spark, layer.path, NAMES, [layer.id_col])
