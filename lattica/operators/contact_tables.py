"""Contacts as a core table and side tables keyed by contact: decisions, probabilities, supervoxels, point clouds.

A contact without rows in a side table gets null there; repeated rows of one key count once, the largest value.
Maps and arrays hold what belongs to one contact, which its face count bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_map(side: DataFrame, key: str, value: str, name: str, contact: str = "contact_id") -> DataFrame:
    """(contact, name): a map of each contact's keys, in their order."""
    one = side.where(F.col(key).isNotNull()).groupBy(contact, key).agg(F.max(value).alias(value))
    return one.groupBy(contact).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def with_decisions(contacts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Contacts with ``merge_decisions``: authority -> whether to merge."""
    return contacts.join(as_map(decisions, "authority", "should_merge", "merge_decisions"), "contact_id", "left")


def with_probabilities(contacts: DataFrame, probabilities: DataFrame) -> DataFrame:
    """Contacts with ``merge_probabilities``: authority -> probability."""
    return contacts.join(as_map(probabilities, "authority", "probability", "merge_probabilities"), "contact_id", "left")


def with_supervoxels(contacts: DataFrame, supervoxels: DataFrame) -> DataFrame:
    """Contacts with ``representative_supervoxels``: segment -> supervoxel."""
    return contacts.join(as_map(supervoxels, "segment_id", "supervoxel_id", "representative_supervoxels"), "contact_id", "left")


def with_points(contacts: DataFrame, points: DataFrame, configs: Sequence[tuple[int, int]], required: bool = True) -> DataFrame:
    """Contacts with one column of points a_<radius>_<n> and b_<radius>_<n> for each configuration and side, in the order of
    ``i``; contacts without a required configuration go."""
    out = contacts
    for radius, n in configs:
        own = points.where((F.col("radius_nm") == radius) & (F.col("n_points") == n))
        sides = own.groupBy("contact_id").agg(*(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("i", "x", "y", "z")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias(f"{s}_{radius}_{n}") for s in "ab"))
        out = out.join(sides, "contact_id", "inner" if required else "left")
    return out


def split_tables(contacts: DataFrame) -> dict[str, DataFrame]:
    """The core table and a long table for each nested column (the inverse of the ``with_`` functions)."""
    nested = {"merge_decisions": ("decisions", "authority", "should_merge"), "merge_probabilities": ("probabilities", "authority", "probability"), "representative_supervoxels": ("supervoxels", "segment_id", "supervoxel_id")}
    points = [c for c in contacts.columns if c[:2] in ("a_", "b_") and c.count("_") == 2]
    out = {"contacts": contacts.drop(*nested, *points)}
    for column, (name, key, value) in nested.items():
        if column in contacts.columns:
            out[name] = contacts.select("contact_id", F.explode(column).alias(key, value))
    clouds = [contacts.select("contact_id", F.lit(int(c.split("_")[1])).alias("radius_nm"), F.lit(int(c.split("_")[2])).alias("n_points"), F.lit(c[0]).alias("side"), F.posexplode(c).alias("i", "p")).select("contact_id", "radius_nm", "n_points", "side", "i", "p.x", "p.y", "p.z") for c in points]
    if clouds:
        both = clouds[0]
        for more in clouds[1:]:
            both = both.unionByName(more)
        out["points"] = both
    return out


def merged_configs(existing: Sequence[dict], new: Sequence[dict]) -> list[dict]:
    """Point cloud configurations by radius and count, the new ones in place of the old, sorted."""
    by_key = {(c["radius_nm"], c["n_points"]): c for c in [*existing, *new]}
    return [by_key[k] for k in sorted(by_key)]


def sphere_cells(df: DataFrame, axes: Sequence[str], radius: float, resolution: Sequence[float]) -> DataFrame:
    """Rows repeated for every grid position within ``radius`` (nm) of their point: columns named as the axes with suffix ``_v``."""
    out, d2 = df, F.lit(0.0)
    for a, r in zip(axes, resolution):
        lo, hi = F.ceil((F.col(a) - radius) / r).cast("long"), F.floor((F.col(a) + radius) / r).cast("long")
        out = out.withColumn(f"{a}_v", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
        d2 = d2 + F.pow(F.col(f"{a}_v") * r - F.col(a), 2)
    return out.where(d2 <= radius * radius)


def representatives(faces: DataFrame, voxels: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(contact_id, segment_id, x, y, z): for each side of a contact the segment's voxel nearest to the mean of its faces
    (ties by position), or that mean if the segment has no voxel there.

    ``faces`` are (contact_id, seg_a, seg_b, x, y, z), ``voxels`` (contact_id, segment_id, x, y, z) those looked at.
    """
    means = faces.groupBy("contact_id", "seg_a", "seg_b").agg(*(F.avg(a).alias(f"m{a}") for a in axes))
    sides = means.select("contact_id", F.explode(F.array("seg_a", "seg_b")).alias("segment_id"), *(f"m{a}" for a in axes))
    near = sides.join(voxels, ["contact_id", "segment_id"], "left")
    d2 = sum((F.pow(F.col(a) - F.col(f"m{a}"), 2) for a in axes), F.lit(0.0))
    best = near.groupBy("contact_id", "segment_id").agg(F.min_by(F.struct(*axes), F.struct(F.coalesce(d2, F.lit(float("inf"))), *axes)).alias("p"), *(F.first(f"m{a}").alias(f"m{a}") for a in axes))
    return best.select("contact_id", "segment_id", *(F.coalesce(F.col(f"p.{a}").cast("double"), F.col(f"m{a}")).alias(a) for a in axes))


def touching(voxels: DataFrame, reach: int) -> DataFrame:
    """(cell_1, cell_2, x, y, z): positions within ``reach`` steps in x and y (diamond-shaped) of two different cells."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if abs(i) + abs(j) <= reach))
    wide = voxels.where("label <> 0").select("label", "x", "y", "z", F.explode(steps).alias("s")).select("label", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), "z").distinct()
    a, b = wide.withColumnRenamed("label", "cell_1"), wide.withColumnRenamed("label", "cell_2")
    return a.join(b, ["x", "y", "z"]).where("cell_1 < cell_2")
