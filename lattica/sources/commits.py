"""Layers of several tables that change together: commits, versions, compaction.

A layer is a folder.  Each commit writes its rows below ``data/<number>-<token>/<table>``, the keys whose earlier
rows no longer count below ``.../touched``, and last of all one marker ``commits/<number>``; a reader sees the
commits that have a marker, so all tables of a layer (levels, indices) change at once or not at all.  Files are
never overwritten: readers of an older version go on, and a job that dies leaves only a folder without a marker.
The marker is moved into place without overwriting; of two writers that began from one version the second gets
``Conflict`` (on file systems whose rename is atomic).

Reading joins the rows with the newest commit of each touched key.  Touched keys are few beside the rows, and AQE
broadcasts them while they are small; ``compacted`` writes a version that needs no join.  Null keys are a key like any other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "_version"


class Conflict(RuntimeError):
    """Another commit came first: read again and repeat the change."""


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def log(spark: SparkSession, path: str, version: int | None = None) -> list[dict]:
    """The commits that make up a version (the newest one by default), the oldest first: a whole one and the changes after it."""
    folder, fs = _hadoop(spark, f"{path}/commits")
    if not fs.exists(folder):
        return []
    marks = spark.read.schema("version long, folder string, whole boolean").json(str(folder.toString())).where("version is not null")
    every = sorted((r.asDict() for r in marks.collect()), key=lambda r: r["version"])
    if version is not None:
        if version not in {r["version"] for r in every}:
            raise ValueError(f"no version {version} in {path}")
        every = [r for r in every if r["version"] <= version]
    whole = [i for i, r in enumerate(every) if r["whole"]]
    return every[whole[-1] :] if whole else every


def latest(spark: SparkSession, path: str) -> int:
    """The number of the newest commit, 0 before the first."""
    commits = log(spark, path)
    return commits[-1]["version"] if commits else 0


def _marked(spark: SparkSession, path: str, mark: dict) -> None:
    """Moves the marker into place, or raises Conflict if one of its number is there."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    hidden, fs = _hadoop(spark, f"{path}/commits/_{uuid.uuid4().hex}")
    target, _ = _hadoop(spark, f"{path}/commits/{mark['version']:012d}")
    out = fs.create(hidden, False)
    out.write(bytearray(json.dumps(mark).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(hidden), fs.makeQualified(target), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {mark['version']} of {path} was written by another commit") from e
        raise


def commit(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], keys: Sequence[str], touched: DataFrame | None, base: int) -> int:
    """Writes one version after ``base`` and gives its number.

    ``tables`` hold the new rows of every table of the layer, ``touched`` the keys whose
    rows up to ``base`` no longer count; None replaces the whole layer.  A key that is touched
    and has no new row is deleted.  Tables must keep their columns.
    """
    if latest(spark, path) != base:
        raise Conflict(f"{path} has changed since version {base}")
    if touched is not None:
        for name, df in tables.items():
            have = read(spark, path, name, keys, base).schema.simpleString()
            if df.schema.simpleString() != have:
                raise ValueError(f"table {name} has {have}, not {df.schema.simpleString()}")
    version = base + 1
    folder = f"{version}-{uuid.uuid4().hex}"
    number = F.lit(version).cast("long").alias(VERSION)
    for name, df in tables.items():
        order = [k for k in keys if k in df.columns]
        laid = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        laid.select("*", number).write.parquet(f"{path}/data/{folder}/{name}")
    if touched is not None:
        touched.select(*keys).distinct().select("*", number).write.parquet(f"{path}/data/{folder}/touched")
    _marked(spark, path, {"version": version, "folder": folder, "whole": touched is None})
    return version


def read(spark: SparkSession, path: str, table: str, keys: Sequence[str], version: int | None = None) -> DataFrame:
    """The rows of a table in a version, the newest by default; filters on its columns reach the scan."""
    commits = log(spark, path, version)
    if not commits:
        raise ValueError(f"no commit in {path}")
    rows = spark.read.parquet(*[f"{path}/data/{c['folder']}/{table}" for c in commits])
    changed = [c["folder"] for c in commits if not c["whole"]]
    if not changed:
        return rows.drop(VERSION)
    newest = spark.read.parquet(*[f"{path}/data/{f}/touched" for f in changed])
    newest = newest.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(VERSION).alias("_newest"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    current = rows.join(newest, same, "left").where(F.col("_newest").isNull() | (F.col(VERSION) >= F.col("_newest")))
    return current.drop(VERSION, "_newest", *[f"_{k}" for k in keys])


def compacted(spark: SparkSession, path: str, names: Sequence[str], keys: Sequence[str]) -> int:
    """Writes the newest version as a whole one, which reads without a join, and gives its number."""
    base = latest(spark, path)
    return commit(spark, path, {n: read(spark, path, n, keys, base) for n in names}, keys, None, base)


def expired(spark: SparkSession, path: str) -> int:
    """Removes what came before the newest whole version, markers first, and folders of commits that failed; gives the number of folders.

    Not to be called while a commit is being written or an older version read.
    """
    kept = log(spark, path)
    if not kept:
        return 0
    marks, fs = _hadoop(spark, f"{path}/commits")
    for s in fs.listStatus(marks):
        name = s.getPath().getName()
        if not name.isdigit() or int(name) < kept[0]["version"]:
            fs.delete(s.getPath(), True)
    old = [s.getPath() for s in fs.listStatus(_hadoop(spark, f"{path}/data")[0]) if s.getPath().getName() not in {c["folder"] for c in kept}]
    for p in old:
        fs.delete(p, True)
    return len(old)
