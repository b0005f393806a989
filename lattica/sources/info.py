"""Info files of layers: JSON documents with scales, merged as layers grow.

A new description of a layer may add scales; what it says of the old ones must agree, unless it overwrites them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import SparkSession

_EPS = 1e-3


def read_info(spark: SparkSession, path: str) -> dict:
    """The info document of a layer; raises FileNotFoundError if it is missing or empty."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(f"{path.rstrip('/')}/info.json", wholetext=True).collect()  # one small document
    except AnalysisException:
        rows = []
    if not rows or not rows[0][0].strip():
        raise FileNotFoundError(f"no info at {path}")
    return json.loads(rows[0][0])


def write_info(spark: SparkSession, path: str, info: dict) -> None:
    """Written through Spark's own file system access, so that any scheme works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/info.json")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(json.dumps(info, sort_keys=True, indent=1).encode()))
    finally:
        stream.close()


def scale(resolution: Sequence[float], start: Sequence[float], stop: Sequence[float], chunk: Sequence[int], **more) -> dict:
    """A scale for a box in nm: sizes rounded up, offsets rounded down, unless they are whole but for rounding."""

    def whole(x: float, otherwise) -> int:
        return round(x) if abs(x - round(x)) < _EPS else otherwise(x)

    offset = [whole(a / r, math.floor) for a, r in zip(start, resolution)]
    return {"key": "_".join(f"{r:g}" for r in resolution), "resolution": list(resolution), "voxel_offset": offset, "size": [whole((b - a) / r, math.ceil) for a, b, r in zip(start, stop, resolution)], "chunk_sizes": [list(chunk)], **more}


def merged_scales(existing: Sequence[dict], new: Sequence[dict]) -> list[dict]:
    """Scales by key, the new ones in place of the old, the finest first."""
    by_key = {s["key"]: s for s in [*existing, *new]}
    return sorted(by_key.values(), key=lambda s: s["resolution"])


def updated(existing: dict | None, new: dict, overwrite: bool = False, keep_scales: bool = True) -> dict:
    """The info document after an update.

    Without ``overwrite`` the new document may only extend the old one: equal fields, equal scales of the same key.
    """
    if existing is None:
        return {**new, "scales": merged_scales([], new.get("scales", []))}
    scales = merged_scales(existing.get("scales", []) if keep_scales else [], new.get("scales", []))
    out = {**existing, **new, "scales": scales}
    if not overwrite:
        changed = [k for k, v in existing.items() if k != "scales" and out.get(k) != v]
        now = {s["key"]: s for s in scales}
        changed += [f"scale {s['key']}" for s in existing.get("scales", []) if now.get(s["key"]) != s]
        if changed:
            raise ValueError(f"not an extension, these differ: {', '.join(changed)}")
    return out
