"""Training datasets: index tables joined with layers, fixed-size samples, collections of annotated boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer_samples(index: DataFrame, layer: DataFrame, axes: Sequence[str], size: Sequence[int], value: str = "v", number: str = "n") -> DataFrame:
    """(n, place, value): for each index box (n and its start per axis) the layer's values inside, by their place in it.

    Each box names the chunks of its own size that it touches (at most two an axis): an equi-join.
    """
    starts = {a: f"_s{a}" for a in axes}
    boxes = index.select(number, *(F.col(a).alias(starts[a]) for a in axes))
    rows = layer
    for a, s in zip(axes, size):
        boxes = boxes.withColumn(f"_c{a}", F.explode(F.array_distinct(F.array(F.floor(F.col(starts[a]) / s), F.floor((F.col(starts[a]) + s - 1) / s)))))
        rows = rows.withColumn(f"_c{a}", F.floor(F.col(a) / s))
    both = boxes.join(rows, [f"_c{a}" for a in axes])
    place = F.lit(0)
    for a, s in zip(axes, size):
        both = both.where((F.col(a) >= F.col(starts[a])) & (F.col(a) < F.col(starts[a]) + s))
        place = place * s + (F.col(a) - F.col(starts[a]))
    return both.select(number, place.cast("int").alias("place"), value)


def fixed_size(array: Column, size: int, fill: Column) -> tuple[Column, Column]:
    """(array of exactly that size, which of its entries are real)."""
    n = F.coalesce(F.size(array), F.lit(0))
    full = F.slice(F.concat(F.coalesce(array, F.array()), F.array_repeat(fill, size)), 1, size)
    return full, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < n)


def contact_samples(contacts: DataFrame, authority: str, max_faces: int, required: Sequence[str]) -> DataFrame:
    """Contacts that ``authority`` decided and that have all required columns, with faces cut or padded to a size.

    (contact_id, target, faces, faces_valid, required columns); ``contact_faces`` are arrays of structs.
    """
    out = contacts.withColumn("target", F.try_element_at("merge_decisions", F.lit(authority))).where("target is not null")
    for c in required:
        out = out.where(F.col(c).isNotNull())
    fields = contacts.schema["contact_faces"].dataType.elementType
    fill = F.struct(*(F.lit(0).cast(f.dataType).alias(f.name) for f in fields.fields))
    faces, valid = fixed_size(F.col("contact_faces"), max_faces, fill)
    return out.select("contact_id", "target", faces.alias("faces"), valid.alias("faces_valid"), *required)


def collection_boxes(annotations: DataFrame, collection: str, tags: Sequence[str], size: Sequence[int], stride: Sequence[int], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(annotation id, dataset, n, start per axis): strided boxes inside the annotated boxes of a collection that have all tags.

    Datasets are numbered in the order of their ids, and their boxes one after another.
    """
    own = annotations.where((F.col("collection") == collection) & (F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0))
    total = F.lit(1)
    for a, s, t in zip(axes, size, stride):
        own = own.withColumn(f"_n{a}", F.greatest(F.floor((F.col(f"{a}1") - F.col(f"{a}0") - s) / t) + 1, F.lit(0)))
        total = total * F.col(f"_n{a}")
    own = own.withColumn("_total", total).where("_total > 0")
    rows = own.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_total") - 1)))
    step, starts = F.lit(1), {}
    for a, t in zip(axes, stride):
        starts[a] = F.col(f"{a}0") + F.pmod(F.floor(F.col("n") / step), F.col(f"_n{a}")) * t
        step = step * F.col(f"_n{a}")
    return rows.select("id", "n", *(c.alias(a) for a, c in starts.items()))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Rows with their place in the order of an epoch: another one each epoch, the same in every run."""
    return df.withColumn("order", F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key)))


def rewritten_index(index: DataFrame, key: str, p: float, seed: int, axes: Sequence[str]) -> DataFrame:
    """A share of the index boxes read with two axes swapped: the flag travels with the row, so that what is read can be swapped back."""
    from .augment import uniform

    flip = uniform(seed, F.col(key)) < p
    a, b = axes[:2]
    return index.withColumn("swapped", flip).withColumns({a: F.when(flip, F.col(b)).otherwise(F.col(a)), b: F.when(flip, F.col(a)).otherwise(F.col(b))})
