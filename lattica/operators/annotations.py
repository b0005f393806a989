"""Annotations: spatial and related indices, deduplication, ids, lines through voxels, and fields from lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spatial import cells_of
from ..session import checkpointed

AXES = ("x", "y", "z")
CELL = ("cx", "cy", "cz")
#: Cells of a change that are broadcast (some 100 bytes each).
FEW_CELLS = 1 << 16
#: Fixed value: the DNS namespace of name-based ids.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def spatial_index(df: DataFrame, bounds: Sequence[tuple[str, str]], sizes: Sequence[Sequence[float]]) -> DataFrame:
    """Every row in every cell that its box touches, on every level (level, cx, cy, cz, then the row)."""
    levels = [cells_of(df, bounds, size).withColumn("level", F.lit(k)) for k, size in enumerate(sizes)]
    return reduce(DataFrame.unionByName, levels)


def cell_limits(index: DataFrame) -> DataFrame:
    """(level, n_cells, most): cells of each level and rows of the fullest."""
    cells = index.groupBy("level", "cx", "cy", "cz").agg(F.count("*").alias("n"))
    return cells.groupBy("level").agg(F.count("*").alias("n_cells"), F.max("n").alias("most"))


def write_layer(df: DataFrame, path: str, bounds: Sequence[tuple[str, str]], sizes: Sequence[Sequence[float]], id_col: str = "id") -> None:
    """An annotation layer: a spatial index with a folder for each cell of each level, and an index sorted by id.

    Repeated rows of one id count once, the first in the order of all columns.  Rows are shuffled by id, then, once for all
    levels, by the finest cell in which they begin; a large cell is written by several tasks.
    """
    spark = df.sparkSession
    levels = [(k, *map(float, size)) for k, size in enumerate(sizes)]
    spark.createDataFrame(levels, "level int, sx double, sy double, sz double").coalesce(1).write.mode("overwrite").parquet(f"{path}/levels")
    one = df.repartitionByRange(id_col).groupBy(id_col).agg(F.min(F.struct(*[c for c in df.columns if c != id_col])).alias("r")).select(id_col, "r.*").select(*df.columns)
    one.sortWithinPartitions(id_col).write.mode("overwrite").parquet(f"{path}/by_id")
    begin = {f"_{c}": F.floor(F.col(lo) / s) for c, (lo, _), s in zip(CELL, bounds, sizes[-1])}
    near = spark.read.schema(df.schema).parquet(f"{path}/by_id").withColumns(begin).hint("rebalance", *[F.col(c) for c in begin]).drop(*begin)
    spatial_index(near, bounds, sizes).write.mode("overwrite").partitionBy("level", *CELL).parquet(f"{path}/spatial")


def read_all(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """All annotations of the spatial index, each once: those of the coarsest level, which holds every one."""
    rows = spark.read.parquet(f"{path}/spatial").where("level = 0")
    return rows.drop("level", "cx", "cy", "cz").dropDuplicates([id_col])


def read_box(spark: SparkSession, path: str, bounds: Sequence[tuple[str, str]], box: Sequence[tuple[float, float]], size: Sequence[float], level: int, id_col: str = "id") -> DataFrame:
    """The annotations whose closed bounds meet a box; only the cells that the box touches are read."""
    rows = spark.read.parquet(f"{path}/spatial").where(F.col("level") == level)
    for cell, (a, b), (lo, hi), s in zip(("cx", "cy", "cz"), bounds, box, size):
        rows = rows.where((F.col(cell) >= int(lo // s)) & (F.col(cell) <= int(hi // s)) & (F.col(b) >= lo) & (F.col(a) <= hi))
    return rows.drop("level", "cx", "cy", "cz").dropDuplicates([id_col])


def read_by_id(spark: SparkSession, path: str, ids: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """The annotations of given ids, or all, from the index by id."""
    rows = spark.read.parquet(f"{path}/by_id")
    return rows if ids is None else rows.join(ids.select(id_col).distinct(), id_col, "left_semi")


def replace_cell(spark: SparkSession, path: str, bounds: Sequence[tuple[str, str]], level: int, cell: Sequence[int], size: Sequence[float], change: Callable[[DataFrame], DataFrame], id_col: str = "id", filter_bounds: bool = True) -> None:
    """One cell's annotations replaced by ``change`` of them, in every cell of every level that the old or new ones touch.

    New annotations outside the cell are left out (``filter_bounds``).  Only touched cells
    are written again, all by one write, their other rows without a shuffle; those that end up empty go with their folders.
    The index by id is written beside the old one and takes its place at the end.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path
    aside, keys = f"{path}/_aside-{uuid.uuid4().hex}", ["level", *CELL]
    at = " and ".join(f"{c} = {v}" for c, v in (("level", level), *zip(CELL, cell)))
    rows, by_id = spark.read.parquet(f"{path}/spatial"), spark.read.parquet(f"{path}/by_id")
    sizes = [tuple(r)[1:] for r in spark.read.parquet(f"{path}/levels").orderBy("level").collect()]
    old = rows.where(at).drop(*keys)
    new = change(old)
    for (a, b), c, s in zip(bounds, cell, size) if filter_bounds else ():
        new = new.where((F.col(b) >= c * s) & (F.floor(F.col(a) / s) <= c))
    new.write.parquet(f"{aside}/new")
    new = spark.read.schema(new.schema).parquet(f"{aside}/new")
    # an annotation lies in every cell that its box meets, so its bounds tell whether it is one of the cell's; others are known by id
    inside = reduce(and_, ((F.floor(F.col(a) / s) <= c) & (F.floor(F.col(b) / s) >= c) for (a, b), c, s in zip(bounds, cell, sizes[level])))
    gone = F.coalesce(inside, F.lit(False))
    moved = checkpointed(new.select(id_col).distinct().join(old.select(id_col), id_col, "left_anti"))
    some_moved = not moved.isEmpty()

    def without(df: DataFrame) -> DataFrame:
        return df.where(~gone).join(moved, id_col, "left_anti") if some_moved else df.where(~gone)

    here = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], *[c for c in rows.columns if c not in keys])
    placed = spatial_index(new, bounds, sizes).withColumns({k: F.col(k).cast("long") for k in keys})
    marks = here.select(*keys, gone.alias("gone")) if not some_moved else here.join(moved.withColumn("moved", F.lit(True)), id_col, "left").select(*keys, (gone | F.col("moved").isNotNull()).alias("gone"))
    marks = marks.select(*keys, F.col("gone").alias("changed"), (~F.col("gone")).alias("left")).unionByName(placed.select(*keys, F.lit(True).alias("changed"), F.lit(True).alias("left")))
    touched = checkpointed(marks.groupBy(*keys).agg(F.max("changed").alias("changed"), F.max("left").alias("left")).where("changed"))
    own = F.broadcast(touched.select(keys)) if touched.count() <= FEW_CELLS else touched.select(keys)
    without(by_id).unionByName(new).repartitionByRange(id_col).sortWithinPartitions(id_col).write.parquet(f"{aside}/by_id")
    # read and written in place: a dynamic overwrite moves its files when all of them are there
    after = without(here.join(own, keys, "left_semi")).unionByName(placed.repartition(*keys))
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/spatial")
    files = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, x, y, z in touched.where("not left").select(keys).collect():  # cells of one cell's annotations
        files.delete(folder(f"{path}/spatial/level={k}/cx={x}/cy={y}/cz={z}"), True)
    files.delete(folder(f"{path}/by_id"), True)
    if not files.rename(folder(f"{aside}/by_id"), folder(f"{path}/by_id")):
        raise RuntimeError(f"the new index by id of {path} stays in {aside}")
    files.delete(folder(aside), True)


def related_index(df: DataFrame, relation: str, id_col: str) -> DataFrame:
    """(related, ids): for each related key the sorted ids of the rows that name it."""
    return df.select(F.explode(relation).alias("related"), id_col).groupBy("related").agg(F.sort_array(F.collect_set(id_col)).alias("ids"))


def last_of_each(df: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """One row for each id, the last by ``order``: one aggregation, no sort."""
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(id_col, "r.*").select(*df.columns)


def name_id(name: Column) -> Column:
    """Version-5 id of a name in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    index = (F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)) - 1) % 4
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (index + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def voxels_on_line(df: DataFrame, start: Sequence[str], stop: Sequence[str]) -> DataFrame:
    """Rows repeated for the voxels of their line, the end left out: one step along the longest axis at a time."""
    d = [F.abs(F.col(b) - F.col(a)) for a, b in zip(start, stop)]
    n = F.greatest(*d)
    out = df.withColumn("_n", n).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1)))
    for axis, a, b, delta in zip(AXES, start, stop, d):
        out = out.withColumn(axis, (F.col(a) + F.signum((F.col(b) - F.col(a)).cast("double")) * F.floor((2 * F.col("_k") * delta + F.col("_n")) / (2 * F.col("_n")))).cast("long"))
    return out.drop("_n", "_k")


def labels_on_lines(lines: DataFrame, id_col: str, start: Sequence[str], stop: Sequence[str], voxels: DataFrame, label: str = "label") -> DataFrame:
    """(id, label): the labels that a line meets, background left out."""
    on = voxels_on_line(lines, start, stop)
    return on.join(voxels.select(*AXES, label), list(AXES)).where(F.col(label) != 0).select(id_col, label).distinct()


def labels_at(points: DataFrame, at: Sequence[str], voxels: DataFrame, label: str = "label") -> DataFrame:
    """Points with the label of the voxel that they round to, 0 outside."""
    own = points.withColumns({f"_{a}": F.bround(F.col(p), 0).cast("long") for a, p in zip(AXES, at)})
    there = voxels.select(*[F.col(a).alias(f"_{a}") for a in AXES], F.col(label).alias("label"))
    return own.join(there, [f"_{a}" for a in AXES], "left").withColumn("label", F.coalesce("label", F.lit(0).cast("long"))).drop(*[f"_{a}" for a in AXES])


def nearest_label(voxels: DataFrame, own: int, target: int, radius: int, label: str = "label") -> DataFrame:
    """(x, y, z, tx, ty, distance): for voxels of one label the nearest of another within the same z, by city-block distance."""
    span = range(-radius, radius + 1)
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in span for j in span if abs(i) + abs(j) <= radius])
    sent = voxels.where(F.col(label) == target).select(F.col("x").alias("tx"), F.col("y").alias("ty"), "z", F.explode(moves).alias("m")).select((F.col("tx") + F.col("m.i")).alias("x"), (F.col("ty") + F.col("m.j")).alias("y"), "z", "tx", "ty", (F.abs("m.i") + F.abs("m.j")).alias("distance"))
    best = voxels.where(F.col(label) == own).select(*AXES).join(sent, list(AXES)).groupBy(*AXES).agg(F.min(F.struct("distance", "tx", "ty")).alias("b"))
    return best.select(*AXES, "b.tx", "b.ty", "b.distance")


def field_from_points(df: DataFrame, at: Sequence[str], shift: Sequence[str]) -> DataFrame:
    """(cx, cy, dx, dy): displacements of each pixel, the nearer to its centre the heavier."""
    cx, cy = F.floor(F.col(at[0])), F.floor(F.col(at[1]))
    w = 1 - F.sqrt((F.col(at[0]) - cx - 0.5) ** 2 + (F.col(at[1]) - cy - 0.5) ** 2)
    cells = df.select(cx.alias("cx"), cy.alias("cy"), *[F.col(s) for s in shift], w.alias("_w"))
    return cells.groupBy("cx", "cy").agg(*[(F.sum(F.col(s) * F.col("_w")) / F.sum("_w")).alias(n) for s, n in zip(shift, ("dx", "dy"))])


def pole(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """The cell of each group that is farthest from the group's perimeter (cells with a neighbour outside it)."""
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    own = cells.select(*by, "x", "y")
    around = own.withColumn("m", F.explode(moves)).select(*by, (F.col("x") + F.col("m.i")).alias("x"), (F.col("y") + F.col("m.j")).alias("y"))
    full = around.join(own, [*by, "x", "y"], "left_semi").groupBy(*by, "x", "y").agg(F.count("*").alias("n")).where("n = 4").drop("n")
    edge = own.join(full, [*by, "x", "y"], "left_anti").select(*by, F.col("x").alias("ex"), F.col("y").alias("ey"))
    far = full.join(edge, list(by)).groupBy(*by, "x", "y").agg(F.min((F.col("x") - F.col("ex")) ** 2 + (F.col("y") - F.col("ey")) ** 2).alias("d2"))
    return far.groupBy(*by).agg(F.max(F.struct(F.col("d2"), (-F.col("x")).alias("mx"), (-F.col("y")).alias("my"))).alias("b")).select(*by, (-F.col("b.mx")).alias("x"), (-F.col("b.my")).alias("y"), F.sqrt("b.d2").alias("distance"))


def normalised(array: Column, centre: Column, radius: float) -> Column:
    """Nested points relative to their centre, in radii."""
    return F.transform(array, lambda p: F.zip_with(p, centre, lambda a, c: (a - c) / radius))


def nearest_other(voxels: DataFrame, radius: int, label: str = "label") -> DataFrame:
    """(x, y, z, other, distance): for every labelled voxel the nearest different label, background left out, by city-block
    distance up to ``radius`` within its z; of equally near ones the first in the order of (y, x)."""
    span = range(-radius, radius + 1)
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in span for j in span if 0 < abs(i) + abs(j) <= radius])
    some = voxels.where(F.col(label) != 0)
    sent = some.select(F.col(label).alias("other"), "z", F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(moves).alias("m")).select("other", "z", (F.col("ox") + F.col("m.i")).alias("x"), (F.col("oy") + F.col("m.j")).alias("y"), "ox", "oy", (F.abs("m.i") + F.abs("m.j")).alias("distance"))
    both = some.select(*AXES, F.col(label).alias("own")).join(sent, list(AXES)).where("own <> other")
    return both.groupBy(*AXES).agg(F.min(F.struct("distance", "oy", "ox", "other")).alias("b")).select(*AXES, "b.other", "b.distance")
