"""Shard files: many small binary chunks in one file, found by chunk number.

A file holds, for each minishard, the place of its index; then the chunks' bytes; then the indexes, each with its
chunk numbers as differences, the gaps between chunks, and their sizes.  All numbers are 64-bit, little-endian.

A file is stored as parts, the rows of a table: each has some neighbouring chunks of one minishard and the blocks of
bytes that they take in the file (data, then the three runs of the index), with their places; one more part has the
file's head.  So tasks write and read any part of a file, and hold a part, whatever the size of a shard;
``file_blocks`` gives the files' bytes in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Chunks and bytes of a part, at least one chunk.
PART_CHUNKS, PART_BYTES = 1 << 14, 1 << 20
#: Bytes of an Arrow batch of parts.
BATCH_BYTES = 4 << 20
#: Parts whose places are broadcast (100 bytes each).
FEW_PARTS = 1 << 16
#: Row groups that a reader holds are small too.
_SMALL = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 8}
_BLOCKS = pa.list_(pa.struct([("at", pa.int64()), ("bytes", pa.binary())]))
_PARTS = pa.schema([("shard", pa.int64()), ("n_chunks", pa.int64()), ("minishard", pa.int64()), ("first", pa.int64()), ("blocks", _BLOCKS)])
_PARTS_DDL = "shard long, n_chunks long, minishard long, first long, blocks array<struct<at: long, bytes: binary>>"
_RUNS = pa.schema([("shard", pa.int64()), ("mini", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("data", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])
_RUNS_DDL = "shard long, mini long, part long, n long, size long, first long, last long, data binary, ids binary, sizes binary"


def shard_of(chunk_id: Column, preshift: int, minishard_bits: int, shard_bits: int) -> tuple[Column, Column]:
    """(shard, minishard) of a chunk number, whose bits are taken as they are."""
    h = F.shiftrightunsigned(chunk_id, preshift)
    return F.shiftrightunsigned(h, minishard_bits).bitwiseAND((1 << shard_bits) - 1), h.bitwiseAND((1 << minishard_bits) - 1)


def encoded(minishards: np.ndarray, ids: np.ndarray, blobs: list[bytes], minishard_bits: int) -> bytes:
    """The file of one shard; rows are sorted by minishard and chunk number."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    ends = np.cumsum(sizes)
    head, indexes, at = np.zeros((1 << minishard_bits, 2), "<u8"), [], int(ends[-1]) if len(ends) else 0
    for m in np.unique(minishards).tolist():
        own = np.flatnonzero(minishards == m)
        starts = ends[own] - sizes[own]
        gaps = np.diff(np.append(0, np.column_stack([starts, ends[own]]).ravel()))[::2]
        index = np.stack([np.diff(ids[own], prepend=0), gaps, sizes[own]]).astype("<u8").tobytes()
        indexes.append(index)
        head[m] = at, at + len(index)
        at += len(index)
    return head.tobytes() + b"".join(blobs) + b"".join(indexes)


def decoded(raw: bytes, minishard_bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(minishard, chunk number, bytes) of all chunks of a shard file."""
    base = 16 << minishard_bits
    for m, (a, b) in enumerate(np.frombuffer(raw[:base], "<u8").reshape(-1, 2).tolist()):
        if b > a:
            ids, gaps, sizes = np.frombuffer(raw[base + a : base + b], "<u8").reshape(3, -1).astype(np.int64)
            ends = np.cumsum(gaps + sizes)
            for i, start, size in zip(np.cumsum(ids).tolist(), (ends - sizes).tolist(), sizes.tolist()):
                yield m, i, raw[base + start : base + start + size]


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as batches of about BATCH_BYTES."""
    held: list[tuple] = []
    size = 0
    for n, row in rows:
        held.append(row)
        size += n + 100
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (shard, mini, id, data) as runs of one minishard of at most PART_CHUNKS and about PART_BYTES."""
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def runs() -> Iterator[tuple[int, tuple]]:
        nonlocal part
        now, ids, sizes, data = None, [], [], []
        count = size = 0

        def run() -> tuple[int, tuple]:
            every, lengths, raw = np.concatenate(ids), np.concatenate(sizes), b"".join(data)
            return len(raw) + 16 * len(every), (*now, part, len(every), len(raw), int(every[0]), int(every[-1]), raw, np.diff(every, prepend=every[0]).astype("<u8").tobytes(), lengths.astype("<u8").tobytes())

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, mini, id_ = (batch.column(i).to_numpy() for i in range(3))
            length = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.append(0, np.cumsum(length))
            values = batch.column(3).cast(pa.large_binary())  # its values stand one after the other
            offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            raw = memoryview(values.buffers()[2]) if values.buffers()[2] else memoryview(b"")
            i = 0
            change = np.append(np.flatnonzero((shard[1:] != shard[:-1]) | (mini[1:] != mini[:-1])) + 1, len(shard)).tolist()
            while i < len(shard):
                key = int(shard[i]), int(mini[i])
                if count and (key != now or count >= PART_CHUNKS or size >= PART_BYTES):
                    yield run()
                    part += 1
                    ids, sizes, data = [], [], []
                    count = size = 0
                now = key
                while change[0] <= i:
                    change.pop(0)
                most = int(np.searchsorted(before, before[i] + PART_BYTES - size))  # the chunk that passes the limit is the last
                j = min(change[0], i + PART_CHUNKS - count, max(most, i + 1))
                ids.append(id_[i:j])
                sizes.append(length[i:j])
                data.append(bytes(raw[offsets[i] : offsets[j]]))
                count, size, i = count + j - i, size + int(before[j] - before[i]), j
        if count:
            yield run()

    return _batches(runs(), _RUNS)


def write_shards(df: DataFrame, path: str, chunk_id: str, data: str, preshift: int, minishard_bits: int, shard_bits: int) -> DataFrame:
    """(shard, n_chunks, minishard, first, blocks): the parts of the written files, a file for each shard.

    Rows are sorted across tasks, and runs of them set aside beside ``path``; where each lies in its file follows from
    the sizes of those before it.  The files are rows of a table, so that lost tasks leave no half-written file behind.
    """
    shard, mini = shard_of(F.col(chunk_id), preshift, minishard_bits, shard_bits)
    rows = df.select(shard.cast("long").alias("shard"), mini.cast("long").alias("mini"), F.col(chunk_id).cast("long").alias("id"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("data"))
    spark, aside = df.sparkSession, f"{path}.runs-{uuid.uuid4().hex}"
    sorted_rows = rows.repartitionByRange("shard", "mini", "id").sortWithinPartitions("shard", "mini", "id")
    sorted_rows.mapInArrow(_runs, _RUNS_DDL).write.options(**_SMALL).parquet(aside)
    runs, base = spark.read.parquet(aside), 16 << minishard_bits

    order = ["mini", "first", "last", "part"]
    file, own = Window.partitionBy("shard").orderBy(*order), Window.partitionBy("shard", "mini").orderBy(*order)
    earlier = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    places = runs.select("shard", *order, "n", "size").withColumns({
        "at": earlier("size", file), "k": earlier("n", own), "of": F.sum("n").over(Window.partitionBy("shard", "mini")),
        "before": F.coalesce(F.lag("last").over(own), F.lit(0)), "index": F.sum("size").over(Window.partitionBy("shard")) + 24 * earlier("n", file),
    }).withColumn("index", F.col("index") - 24 * F.col("k"))
    keyed = places.select("shard", "part", "at", "k", "of", "before", "index")
    if runs.count() <= FEW_PARTS:
        keyed = F.broadcast(keyed)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    s, m, n, first, raw, ids, sizes, at, k, of, before, index = (batch.column(c)[i].as_py() for c in range(batch.num_columns))
                    word = lambda x: np.array([x], np.int64).astype("<u8").tobytes()
                    index += base
                    blocks = [(base + at, raw), (index + 8 * k, word(first - before) + ids[8:]), (index + 8 * (of + k), word(0 if k else at) + bytes(8 * (n - 1))), (index + 8 * (2 * of + k), sizes)]
                    yield len(raw) + 24 * n, (s, n, m, first, [{"at": a, "bytes": b} for a, b in blocks])

        return _batches(each(), _PARTS)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for s, minis in zip(*(c.to_pylist() for c in batch.columns)):
                    head = np.zeros((1 << minishard_bits, 2), "<u8")
                    for x in minis:
                        head[x["mini"]] = x["index"], x["index"] + 24 * x["of"]
                    yield head.nbytes, (s, 0, None, None, [{"at": 0, "bytes": head.tobytes()}])

        return _batches(each(), _PARTS)

    body = runs.drop("size", "last").join(keyed, ["shard", "part"]).select("shard", "mini", "n", "first", "data", "ids", "sizes", "at", "k", "of", "before", "index").mapInArrow(parts, _PARTS_DDL)
    tops = places.where("k = 0").groupBy("shard").agg(F.collect_list(F.struct("mini", "index", "of"))).mapInArrow(heads, _PARTS_DDL)
    body.unionByName(tops).write.mode("overwrite").options(**_SMALL).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(aside)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.parquet(path)


def file_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(shard, at, bytes): the blocks of each file; in the order of ``at`` they are the file without a gap."""
    return spark.read.parquet(path).select("shard", F.explode("blocks").alias("b")).select("shard", "b.at", "b.bytes").where("length(bytes) > 0")


def read_shards(spark: SparkSession, path: str, minishard_bits: int) -> DataFrame:
    """(shard, minishard, id, data) of all chunks of the files, part by part."""
    kinds = pa.schema([("shard", pa.int64()), ("minishard", pa.int64()), ("id", pa.int64()), ("data", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s, m, first, raw, deltas, sizes = (batch.column(c)[i].as_py() for c in range(6))
                step = np.frombuffer(deltas, "<u8").astype(np.int64)
                ids, ends = first + np.cumsum(step) - step[0], np.append(0, np.cumsum(np.frombuffer(sizes, "<u8").astype(np.int64)))
                data = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), s)), pa.array(np.full(len(ids), m)), pa.array(ids), data], schema=kinds)

    own = spark.read.parquet(path).where("minishard is not null")
    return own.select("shard", "minishard", "first", *[F.col("blocks")[k]["bytes"].alias(f"b{k}") for k in (0, 1, 3)]).mapInArrow(chunks, "shard long, minishard long, id long, data binary")
