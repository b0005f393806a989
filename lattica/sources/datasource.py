"""Contact chunks in shard files, as a Spark data source: ``spark.read.format("lattica_contacts")``.

A shard file holds the binary records (sources/binary.py) of many chunks one
after the other, then an index with a row of chunk, offset, length and number of records for each, then
the number of index rows (uint64).  ``_manifest.json`` names the shards of the layer.

Reading plans from the indices alone: filters on x, y and z leave out chunks that
cannot hold a row, and every partition is a run of neighbouring chunks of one
shard, read by its byte range.  Writing makes a shard for each task; a commit
moves the shards in place and then swaps the manifest, so readers see all of a
write or nothing; an abort removes what was written.  Deal the rows by chunk
(``dealt``) before writing, so that a chunk lies in one run of a shard; large ones lie in several runs and shards.
Writers and readers hold HELD_BYTES of rows at a time, however large a chunk or a shard is.

Paths are local or of any store that pyarrow opens; driver and executors must share them.
Options: path; chunk (sizes ``sx,sy,sz``, for writing).  Rows: id, seg_a, seg_b,
centre x, y, z (float32 in the file), faces (x, y, z, affinity).  Null faces are none; a null elsewhere fails the write.
"""

from __future__ import annotations

import contextlib
import json
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .binary import contact_bytes, contact_rows

FORMAT = "lattica_contacts"
SCHEMA = "id bigint, seg_a bigint, seg_b bigint, x double, y double, z double, faces array<array<float>>"
AXES = ("x", "y", "z")
MANIFEST = "_manifest.json"
#: Bytes of one partition of a read, at least one chunk.
PART_BYTES = 16 << 20
#: Bytes of rows that a writer or reader holds at once.
HELD_BYTES = 4 << 20
_INDEX = np.dtype([("chunk", "<i8", 3), ("offset", "<u8"), ("length", "<u8"), ("rows", "<u8")])
_ARROW = pa.schema([("id", pa.int64()), ("seg_a", pa.int64()), ("seg_b", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("faces", pa.list_(pa.list_(pa.float32())))])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if ":" not in path:
        return fs.LocalFileSystem(), path.rstrip("/")
    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"file:///{rest.lstrip('/')}" if scheme == "file" else path.rstrip("/"))


def manifest(store: fs.FileSystem, root: str) -> dict:
    """The layer's chunk sizes and shards; none before the first write."""
    at = f"{root}/{MANIFEST}"
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return {"chunk": None, "shards": []}
    with store.open_input_stream(at) as f:
        return json.loads(f.read())


def shard_index(store: fs.FileSystem, path: str) -> np.ndarray:
    """A shard's index, from the end of the file."""
    with store.open_input_file(path) as f:
        size = f.size()
        n = int(np.frombuffer(f.read_at(8, size - 8), "<u8")[0])
        return np.frombuffer(f.read_at(n * _INDEX.itemsize, size - 8 - n * _INDEX.itemsize), _INDEX)


@dataclass
class ByteRange(InputPartition):
    """Some neighbouring chunks of one shard."""

    path: str
    offset: int
    length: int

    def __post_init__(self) -> None:
        super().__init__(None)


@dataclass
class ContactReader(DataSourceReader):
    path: str
    low: list[float] = field(default_factory=lambda: [-math.inf] * 3)
    high: list[float] = field(default_factory=lambda: [math.inf] * 3)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds on x, y and z prune chunks; Spark still applies every filter to the rows."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in AXES and isinstance(getattr(f, "value", None), (int, float)):
                k = AXES.index(name)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low[k] = max(self.low[k], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high[k] = min(self.high[k], f.value)
        return filters

    def partitions(self) -> list[ByteRange]:
        store, root = opened(self.path)
        layer = manifest(store, root)
        out: list[ByteRange] = []
        for name in layer["shards"]:
            index = shard_index(store, f"{root}/{name}")
            begin = index["chunk"] * np.asarray(layer["chunk"], float)
            hit = ((begin <= self.high) & (begin + layer["chunk"] >= self.low)).all(axis=1)
            end = None
            for row in index[hit]:
                if end == row["offset"] and out[-1].length + int(row["length"]) <= PART_BYTES:
                    out[-1].length += int(row["length"])
                else:
                    out.append(ByteRange(name, int(row["offset"]), int(row["length"])))
                end = row["offset"] + row["length"]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.length:
            return
        store, root = opened(self.path)
        with store.open_input_file(f"{root}/{partition.path}") as f:
            rest, at, end = b"", partition.offset, partition.offset + partition.length
            while at < end:
                raw = rest + f.read_at(min(HELD_BYTES, end - at), at)
                at += min(HELD_BYTES, end - at)
                head, faces, used = contact_rows(raw)
                rest = raw[used:]
                count = np.concatenate([[0], np.cumsum(head["n"], dtype=np.int64)])
                each = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(faces) + 1, 4), pa.int32()), pa.array(faces.ravel()))
                columns = [pa.array(np.ascontiguousarray(head[n])) for n in ("id", "seg_a", "seg_b")] + [pa.array(head["com"][:, k].astype(np.float64)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(count, pa.int32()), each)], schema=_ARROW)
            if rest:
                raise ValueError(f"the last contact of a part of {partition.path} is cut off")


@dataclass
class Written(WriterCommitMessage):
    shard: str | None


class ContactWriter(DataSourceArrowWriter):
    def __init__(self, path: str, chunk: list[float], overwrite: bool) -> None:
        self.path, self.chunk, self.overwrite, self.job = path, chunk, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One shard of all rows of the task, written as they come: those of a chunk together as far as they are held at once."""
        store, root = opened(self.path)
        folder, name = f"{root}/_temporary/{self.job}", f"{uuid.uuid4().hex}.shard"
        index: list[list] = []  # chunk, offset, length, rows of each run
        held: list[pa.RecordBatch] = []
        with contextlib.ExitStack() as stack:
            out, offset = None, 0

            def put() -> None:
                nonlocal out, offset
                cells, sizes, raw = self._encoded(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held.clear()
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = stack.enter_context(store.open_output_stream(f"{folder}/{name}"))
                out.write(raw)
                first = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]).any(axis=1)))
                for cell, length, n in zip(map(tuple, cells[first].tolist()), np.add.reduceat(sizes, first).tolist(), np.diff(np.append(first, len(cells))).tolist()):
                    if index and index[-1][0] == cell and index[-1][2] + length <= PART_BYTES:
                        index[-1][2:] = index[-1][2] + length, index[-1][3] + n
                    else:
                        index.append([cell, offset, length, n])
                    offset += length

            for batch in batches:
                for part in (batch.slice(i, 1 << 14) for i in range(0, batch.num_rows, 1 << 14)):
                    held.append(part)
                    if sum(h.nbytes for h in held) >= HELD_BYTES:
                        put()
            if held:
                put()
            if out is None:
                return Written(None)
            rows = np.array([tuple(r) for r in index], _INDEX)
            out.write(rows.tobytes() + np.array([len(rows)], "<u8").tobytes())
        return Written(name)

    def _encoded(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, memoryview]:
        """(chunk of each row, its length, the bytes of all) in the order of chunks."""
        if any(batch.column(c).null_count for c in ("id", "seg_a", "seg_b", *AXES)):
            raise ValueError("a contact needs ids and a centre")
        com = np.column_stack([batch.column(a).to_numpy(zero_copy_only=False).astype(np.float32) for a in AXES])
        if np.isnan(com).any():
            raise ValueError("a contact needs ids and a centre")
        cells = np.floor(com / np.asarray(self.chunk, np.float64)).astype(np.int64)
        order = np.lexsort(cells.T[::-1])
        batch = batch.take(pa.array(order))
        faces = batch.column("faces")
        each = faces.flatten()
        values = each.flatten()
        if each.null_count or values.null_count or (pc.list_value_length(each).to_numpy(zero_copy_only=False) != 4).any():
            raise ValueError("a face needs x, y, z and an affinity")
        n = pc.fill_null(pc.list_value_length(faces), 0).to_numpy(zero_copy_only=False)
        sizes, raw = contact_bytes(*(batch.column(c).to_numpy() for c in ("id", "seg_a", "seg_b")), com[order], n, values.to_numpy(zero_copy_only=False).reshape(-1, 4))
        return cells[order], sizes, raw

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        before = manifest(store, root)
        if not self.overwrite and before["chunk"] not in (None, self.chunk):
            raise ValueError(f"the layer has chunks of {before['chunk']}")
        fresh = [m.shard for m in messages if m is not None and m.shard]
        for name in fresh:
            store.move(f"{root}/_temporary/{self.job}/{name}", f"{root}/{name}")
        after = {"chunk": self.chunk, "shards": fresh if self.overwrite else before["shards"] + fresh}
        with store.open_output_stream(f"{root}/_{self.job}.json") as f:
            f.write(json.dumps(after).encode())
        store.move(f"{root}/_{self.job}.json", f"{root}/{MANIFEST}")
        for name in set(before["shards"]) - set(after["shards"]):
            store.delete_file(f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary/{self.job}")


class ContactSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ContactReader:
        return ContactReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ContactWriter:
        return ContactWriter(self.options["path"], [float(s) for s in self.options["chunk"].split(",")], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContactSource)


def dealt(contacts: DataFrame, chunk: tuple[float, float, float]) -> DataFrame:
    """The rows of SCHEMA, dealt and sorted by chunk; chunks that are large for a task are split into several."""
    names = [f"_{a}" for a in AXES]
    rows = contacts.select("id", "seg_a", "seg_b", *[F.col(a).cast("double").alias(a) for a in AXES], F.col("faces").cast("array<array<float>>").alias("faces"), *[F.floor(F.col(a).cast("float") / s).alias(n) for n, a, s in zip(names, AXES, chunk)])
    return rows.hint("rebalance", *[F.col(n) for n in names]).sortWithinPartitions(*names).drop(*names)
