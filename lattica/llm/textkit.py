"""Vectorised text helpers shared by the corpus operators.

Everything works on Arrow string batches.  A batch is walked in chunks of whole
documents (``byte_chunks``), so the numpy temporaries stay small whatever the
batch size; one document longer than the chunk size forms a chunk of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, shared_dir  # noqa: F401

CHUNK_BYTES = 1 << 18

#: ASCII white space of the word rules ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * CHUNK_BYTES), base & _MASK, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers.clear() if n > 64 * CHUNK_BYTES else None
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span ``buf[start:end]``."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_BASE_INV, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_BASE, n + 1)[ends]
    return mix(h ^ (ends - starts).astype(np.uint64))


def as_strings(column: pa.Array) -> pa.Array:
    """The column as strings with a text in every row: null counts as empty."""
    return column.cast(pa.string()).fill_null("")


def byte_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets into them) for runs of whole documents."""
    column = as_strings(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for every document the index of its first word (plus a last entry).

    Words are maximal runs of bytes for which ``separator`` is False; they never cross documents.
    """
    inside = ~separator[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = inside
    cut = offsets[(offsets > 0) & (offsets < len(buf))]
    start, end = after & ~before, before & ~after
    both = cut[before[cut] & after[cut]]
    start[both] = True
    end[both] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of one Arrow batch of whole texts: the default of 64 MB needs several times that in each Python worker.
BATCH_BYTES = 4 << 20


def text_rows(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` (or some of its columns), with the session's Arrow batches held to BATCH_BYTES for the functions that follow."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(name)).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id written as text, modulo ``m``: the split rule for held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % m


def segment_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[i]:firsts[i+1]]; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]
