"""Document-style queries and writes: filters, array updates, partial updates, upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def clause(name: str, values: Sequence) -> Column:
    """``-col``: the array holds any of the values; ``>col``: greater than any of them; else equal to any."""
    if name.startswith("-"):
        return F.arrays_overlap(F.col(name[1:]), F.array(*[F.lit(v) for v in values]))
    if name.startswith(">"):
        return reduce(or_, [F.col(name[1:]) > F.lit(v) for v in values])
    return F.col(name).isin(list(values))


def matching(df: DataFrame, filters: dict[str, Sequence], union: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that meet any clause (``union``) or all of them; no clauses select all rows."""
    out = df
    if filters:
        out = df.where(reduce(or_ if union else and_, [F.coalesce(clause(k, v), F.lit(False)) for k, v in filters.items()]))
    return out.select(*columns) if columns else out


def by_keys(df: DataFrame, keys: Sequence, key: str) -> DataFrame:
    """A row for every wanted key in the order of the request (column ``ordinal``), null where it is missing."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"ordinal int, {key} {df.schema[key].dataType.simpleString()}")
    return F.broadcast(wanted).join(df, key, "left") if len(keys) < 10_000 else wanted.join(df, key, "left")


def array_updated(old: Column, add: Column, remove: Column) -> Column:
    """The array without ``remove`` and with ``add``, sorted and without repeats; null counts as empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.array_except(F.coalesce(old, empty), F.coalesce(remove, empty)), F.coalesce(add, empty)))


def partial_update(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by the change's where that is not null; unknown keys change nothing."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def upsert(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` in place of those with equal keys, and the others."""
    return df.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def deleted(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def cascade_deleted(tables: Sequence[DataFrame], keys: DataFrame, links: Sequence[tuple[str, str]]) -> list[DataFrame]:
    """Each table without the rows that hang from deleted ones; links are (own key, parent's key) of the tables in order."""
    out, gone = [], keys
    for df, (own, parent) in zip(tables, links):
        hit = df.join(gone.select(F.col(gone.columns[0]).alias(parent)).distinct(), parent, "left_semi")
        out.append(df.join(gone.select(F.col(gone.columns[0]).alias(parent)).distinct(), parent, "left_anti"))
        gone = hit.select(own)
    return out


def batch_of(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """The i-th of n batches by a hash of the key."""
    if not 0 <= i < n:
        raise IndexError(f"batch {i} of {n}")
    return df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def expanded(df: DataFrame, key: str, path: str, value: str) -> DataFrame:
    """(key, doc): documents from rows of dotted paths, as maps of maps; a path's first part names the outer entry.

    Deeper paths keep their rest as the inner name.  Of equal paths the largest value counts.
    """
    one = df.groupBy(key, path).agg(F.max(value).alias(value))
    parts = one.select(key, F.substring_index(path, ".", 1).alias("_a"), F.when(F.instr(path, ".") > 0, F.expr(f"substring({path}, instr({path}, '.') + 1)")).otherwise(F.lit("")).alias("_b"), value)
    inner = parts.groupBy(key, "_a").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_b", value)))).alias("_m"))
    return inner.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_a", F.to_json("_m").alias("_j"))))).alias("doc"))


def merged(df: DataFrame, changes: DataFrame, key: str, doc: str) -> DataFrame:
    """Documents (maps) with the entries of the changes in place of their own; documents that only the changes have are added."""
    new = changes.select(key, F.col(doc).alias("_new"))
    both = df.join(new, key, "full")
    names = F.array_distinct(F.concat(F.map_keys(F.coalesce(doc, F.create_map().cast("map<string,string>"))), F.map_keys(F.coalesce("_new", F.create_map().cast("map<string,string>")))))
    entry = F.transform(F.array_sort(names), lambda k: F.struct(k.alias("key"), F.coalesce(F.try_element_at("_new", k), F.try_element_at(doc, k)).alias("value")))
    return both.withColumn(doc, F.map_from_entries(entry)).drop("_new")


def nested(leaves: DataFrame, key: str, path: str = "path", value: str = "value") -> DataFrame:
    """(key, doc): documents as JSON text from rows of dotted paths of any depth, names in order.

    A plain value that other paths of its document go through gives way to them; of equal paths the
    largest value counts; values are kept as JSON strings.  Each level is one grouped step, the deepest first.
    """
    name = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    rows = checkpointed(leaves.groupBy(key, F.split(path, r"\.").alias("at")).agg(F.max(F.col(value).cast("string")).alias("v")).select(key, "at", F.coalesce(name("v"), F.lit("null")).alias("v")))
    depth = rows.agg(F.max(F.size("at"))).first()[0] or 0
    carried = None
    for level in range(depth, 0, -1):
        here = rows.where(F.size("at") == level)
        if carried is not None:
            here = here.join(carried.select(key, "at"), [key, "at"], "left_anti").select(key, "at", "v").unionByName(carried)
        entry = F.struct(F.element_at("at", -1).alias("n"), F.concat(name(F.element_at("at", -1)), F.lit(":"), F.col("v")).alias("e"))
        up = here.groupBy(key, F.slice("at", 1, F.lit(level - 1)).alias("at")).agg(F.sort_array(F.collect_list(entry)).alias("es"))
        carried = up.select(key, "at", F.concat(F.lit("{"), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("}")).alias("v"))
    return rows.select(key, F.lit("{}").alias("doc")).limit(0) if carried is None else carried.select(key, F.col("v").alias("doc"))


def leaves(docs: DataFrame, key: str, doc: str = "doc") -> DataFrame:
    """(key, path, value): the plain values of JSON documents under their dotted paths, level by level."""
    found, now = None, docs.select(key, F.lit("").alias("path"), F.col(doc).alias("value")).where("value IS NOT NULL")
    while True:
        inner = checkpointed(now.select(key, "path", F.explode(F.from_json("value", "map<string,string>")).alias("n", "value")).select(key, F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), "n").alias("path"), "value"))
        is_map = F.coalesce(F.col("value").startswith("{") & F.from_json("value", "map<string,string>").isNotNull(), F.lit(False))
        plain = inner.where(~is_map)
        found = plain if found is None else found.unionByName(plain)
        now = inner.where(is_map)
        if now.isEmpty():
            return found


def merged_leaves(have: DataFrame, changes: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Leaves (key, path, value) of documents after changes, at any depth.

    A change replaces the leaf at its path, everything below it and any plain value above it; all else stays.
    """
    parts = F.split(path, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    new = changes.select(key, F.explode(prefixes).alias("_p"), path)
    at_or_below = have.withColumn("_p", F.explode(prefixes)).join(new.where(F.col("_p") == F.col(path)).select(key, "_p").distinct(), [key, "_p"], "left_semi").select(key, path).distinct()
    above = new.select(key, F.col("_p").alias(path)).distinct()
    kept = have.join(at_or_below, [key, path], "left_anti").join(above, [key, path], "left_anti")
    return kept.select(key, path, "value").unionByName(changes.select(key, path, "value"))


def layer_groups(groups: DataFrame, ids: Sequence | None = None, collections: Sequence | None = None) -> DataFrame:
    """Layer groups of collections if any are given, else those of the ids, else all."""
    if collections is not None:
        return groups.where(F.col("collection").isin(list(collections)))
    return groups if ids is None else groups.where(F.col("id").isin(list(ids)))


def annotation_rows(df: DataFrame, name: Column) -> DataFrame:
    """Annotations with a deterministic id by ``name`` and tags without repeats; the first of equal ids stays."""
    from .annotations import name_id

    out = df.withColumn("id", name_id(name)).withColumn("tags", F.array_distinct("tags"))
    return out.dropDuplicates(["id"])


def decoded_shapes(text: Column) -> Column:
    """struct(kind, a, b, radii) of a polymorphic annotation in JSON: points and ellipsoids have one place, lines and boxes two;
    null for an unknown kind."""
    d = F.from_json(text, "struct<type: string, point: array<double>, pointA: array<double>, pointB: array<double>, center: array<double>, radii: array<double>>")
    kind, none = d["type"], F.lit(None).cast("array<double>")
    return F.when(kind.isin("point", "line", "axis_aligned_bounding_box", "ellipsoid"), F.struct(kind.alias("kind"), F.when(kind == "point", d["point"]).when(kind == "ellipsoid", d["center"]).otherwise(d["pointA"]).alias("a"), F.when(kind.isin("line", "axis_aligned_bounding_box"), d["pointB"]).otherwise(none).alias("b"), F.when(kind == "ellipsoid", d["radii"]).otherwise(none).alias("radii")))
