"""Row codecs of binary chunk files, read and written through binary columns.

Fixed layouts, little-endian.  Contacts: id, seg_a, seg_b (int64), centre (3 float32),
number of faces (uint32), faces (x, y, z, affinity: float32).  Points: number of rows (uint64), then rows of
x, y, z (float32), then ids (uint64).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = np.dtype([("id", "<i8"), ("seg_a", "<i8"), ("seg_b", "<i8"), ("com", "<f4", 3), ("n", "<u4")])
CONTACT_SCHEMA = "path string, id long, seg_a long, seg_b long, com array<float>, faces array<array<float>>"
POINT_SCHEMA = "path string, id decimal(20,0), x float, y float, z float"


def contacts_to_bytes(rows: list[tuple[int, int, int, list[float], list[list[float]]]]) -> bytes:
    parts = []
    for id_, a, b, com, faces in rows:
        head = np.zeros(1, _HEAD)
        head[0] = (id_, a, b, com, len(faces))
        parts += [head.tobytes(), np.asarray(faces, "<f4").reshape(-1, 4).tobytes()]
    return b"".join(parts)


def contacts_from_bytes(raw: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(raw):
        head = np.frombuffer(raw, _HEAD, 1, at)[0]
        at += _HEAD.itemsize
        n = int(head["n"])
        faces = np.frombuffer(raw, "<f4", 4 * n, at).reshape(n, 4)
        at += 16 * n
        out.append({"id": int(head["id"]), "seg_a": int(head["seg_a"]), "seg_b": int(head["seg_b"]), "com": head["com"].tolist(), "faces": faces.tolist()})
    return out


def contact_bytes(ids: np.ndarray, seg_a: np.ndarray, seg_b: np.ndarray, com: np.ndarray, n: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """(bytes of each, all bytes) of contacts as arrays; ``n`` faces of each stand one after the other in ``faces``."""
    head = np.zeros(len(ids), _HEAD)
    head["id"], head["seg_a"], head["seg_b"], head["com"], head["n"] = ids, seg_a, seg_b, com, n
    sizes = _HEAD.itemsize + 16 * n.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(_HEAD.itemsize)] = head.view(np.uint8).reshape(-1, _HEAD.itemsize)
    before = np.cumsum(n, dtype=np.int64) - n
    at = np.repeat(starts + _HEAD.itemsize - 16 * before, n) + 16 * np.arange(len(faces))
    out[at[:, None] + np.arange(16)] = np.ascontiguousarray(faces, "<f4").view(np.uint8).reshape(-1, 16)
    return sizes, out.data


def contact_rows(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(heads, faces one after the other, bytes used) of the whole contacts that ``raw`` begins with."""
    starts, at, most, faces_of = [], 0, len(raw) - _HEAD.itemsize, struct.Struct("<I").unpack_from
    while at <= most:
        end = at + _HEAD.itemsize + 16 * faces_of(raw, at + 36)[0]
        if end > len(raw):
            break
        starts.append(at)
        at = end
    data, begin = np.frombuffer(raw, np.uint8), np.asarray(starts, np.int64)
    head = data[begin[:, None] + np.arange(_HEAD.itemsize)].reshape(-1).view(_HEAD)
    n = head["n"].astype(np.int64)
    place = np.repeat(begin + _HEAD.itemsize - 16 * (np.cumsum(n) - n), n) + 16 * np.arange(int(n.sum()))
    return head, data[place[:, None] + np.arange(16)].reshape(-1).view("<f4").reshape(-1, 4), at


def points_to_bytes(ids: np.ndarray, xyz: np.ndarray) -> bytes:
    return np.array([len(ids)], "<u8").tobytes() + np.asarray(xyz, "<f4").tobytes() + np.asarray(ids, "<u8").tobytes()


def points_from_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    return np.frombuffer(raw, "<u8", n, 8 + 12 * n), np.frombuffer(raw, "<f4", 3 * n, 8).reshape(n, 3)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all contact files under a path; empty files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [{"path": p} | r for r in contacts_from_bytes(raw)]
                kinds = pa.schema([("path", pa.string()), ("id", pa.int64()), ("seg_a", pa.int64()), ("seg_b", pa.int64()), ("com", pa.list_(pa.float32())), ("faces", pa.list_(pa.list_(pa.float32())))])
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return _files(spark, path).mapInArrow(run, CONTACT_SCHEMA)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all point files under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, xyz = points_from_bytes(raw)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(ids)), pa.array(ids, pa.uint64()).cast(pa.decimal128(20, 0)), *(pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3))], names=["path", "id", "x", "y", "z"])

    return _files(spark, path).mapInArrow(run, POINT_SCHEMA)
