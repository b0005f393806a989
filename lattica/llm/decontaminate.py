"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over consecutive words ignore some positions, so a seed still hits
where a word was substituted.  The seed hashes of the benchmark and of the
documents are joined in Spark.  Every seed carries the words around it, so a
joined row is verified by itself: the two texts are aligned at the seed, and an
overlap counts if in some window of WINDOW words (the whole item, if it is
shorter) at least SHARE of the words agree.

The masks miss no such window.  Items of WINDOW words or more allow two
substitutions in 13 words, which LONG_MASKS survive at every place; shorter
items allow two from ten words on and one below, which SHORT_MASKS survive.

Documents send only seeds that a bitmap of the benchmark's seeds lets through.
The bitmap has a fixed size (FILTER_BITS for each mask): a larger benchmark lets
more seeds through, and loses none.  The benchmark's seeds are broadcast up to
BROADCAST_BYTES by their own count; beyond that both sides are shuffled by seed,
and AQE splits the partitions of seeds that many documents share.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.

Defined cases: a null text counts as empty; items of fewer than MIN_WORDS words
are too short to tell anything and contaminate nothing; repeated items count
once per item_id; ids are of any type, a null item_id is one of its own; rows
with equal or null doc_id are judged separately; empty tables give an empty
result, or all documents; other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_scan import SEPARATOR
from .textkit import LOWER, byte_chunks, mix, span_hashes, text_rows, word_spans

WINDOW = 13
SHARE = 0.8
MIN_WORDS = 5
LONG_MASKS = ("111101", "111011", "1101011")
SHORT_MASKS = ("1111", "10111", "11011", "11101")
MASKS = LONG_MASKS + SHORT_MASKS
FILTER_BITS = 22
BROADCAST_BYTES = 16 << 20
#: Words before a seed's first word that a window with the seed can hold, and words of the whole context.
_BEFORE = WINDOW - 1
_CONTEXT = 2 * _BEFORE + max(map(len, MASKS))
#: Words outside a text: different on both sides, and no word's hash but by chance.
_NO_WORD, _NO_ITEM_WORD = np.uint64(0), np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def seeds(words: np.ndarray, number: int) -> np.ndarray:
    """The hash by mask ``number`` at every word where it fits, whatever text the words are of."""
    mask = MASKS[number]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(number + 1))
    for k, i in enumerate(i for i, c in enumerate(mask) if c == "1"):
        h += words[i : i + n] * _ODD[k]
        h ^= h >> np.uint64(32)
    return mix(h)


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for a, _, buf, offsets in byte_chunks(texts):
        low = LOWER[buf]
        starts, ends, firsts = word_spans(low, offsets, SEPARATOR)
        yield a, span_hashes(low, starts, ends), firsts


def _contexts(words: np.ndarray, firsts: np.ndarray, text: np.ndarray, at: np.ndarray, outside: np.uint64) -> np.ndarray:
    """The words around each place, (places, _CONTEXT); ``outside`` beyond the text."""
    where = at[:, None] - _BEFORE + np.arange(_CONTEXT)
    inside = (where >= firsts[text][:, None]) & (where < firsts[text + 1][:, None])
    return np.where(inside, words[np.clip(where, 0, len(words) - 1)], outside)


def _as_binary(rows: np.ndarray) -> pa.Array:
    """Rows of words as values of fixed length."""
    return pa.Array.from_buffers(pa.binary(8 * _CONTEXT), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _seed_rows(words: np.ndarray, firsts: np.ndarray, wanted, outside: np.uint64, masks=range(len(MASKS))):
    """(seed, mask, text, context) of one chunk; ``wanted(number, seeds)`` gives the places whose seeds of a mask are sent.

    Seeds that repeat in a text with the same words around them are sent once.
    """
    out = []
    for number in masks:
        h = seeds(words, number)
        at = wanted(number, h)
        text = np.searchsorted(firsts, at, "right") - 1
        ok = at + len(MASKS[number]) <= firsts[text + 1]
        if ok.any():
            at, text = at[ok], text[ok]
            out.append((h[at], np.full(len(at), number, np.int32), text, at))
    if not out:
        return None
    h, number, text, at = (np.concatenate(x) for x in zip(*out))
    around = _contexts(words, firsts, text, at, outside)
    digest = mix((around * np.arange(1, 2 * _CONTEXT, 2, dtype=np.uint64) * _ODD[0]).sum(1, dtype=np.uint64) ^ h)
    _, first = np.unique(np.column_stack([text.astype(np.uint64), digest]), axis=0, return_index=True)
    return h[first], number[first], text[first], around[first]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, text) -> (seed, mask, item, size, context): the masks of its length at every place of each item."""
    for batch in batches:
        for a, words, firsts in words_of(batch.column(1)):
            n = np.diff(firsts)
            each = np.repeat(n, n)

            def wanted(number, h, each=each):
                own = each[: len(h)]
                return np.flatnonzero(own >= WINDOW if number < len(LONG_MASKS) else (own >= MIN_WORDS) & (own < WINDOW))

            got = _seed_rows(words, firsts, wanted, _NO_ITEM_WORD)
            if got:
                h, number, text, around = got
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(number), batch.column(0).take(pa.array(a + text)), pa.array(np.minimum(n[text], WINDOW).astype(np.int32)), _as_binary(around)], names=["seed", "mask", "item", "size", "item_words"])


class _Filter:
    """Which seeds of each mask the benchmark has, as bitmaps of a fixed size."""

    def __init__(self, masks: np.ndarray, places: np.ndarray, bits: np.ndarray):
        self.maps: dict[int, np.ndarray] = {}
        for number in np.unique(masks).tolist():
            words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
            own = masks == number
            words[places[own]] = bits[own].view(np.uint64)
            self.maps[number] = words

    def wanted(self, number: int, h: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(64 - FILTER_BITS)
        return np.flatnonzero(self.maps[number][(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))


def _hits(docs: DataFrame, benchmark: DataFrame, tag, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(row, tag, item, n_same) of every verified hit: ``row`` numbers the documents, ``tag`` is a column of theirs."""
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType.simpleString()
    tag_type = docs.select(tag).schema[0].dataType.simpleString()
    items = text_rows(benchmark, benchmark[item_col].alias("item"), benchmark[item_text_col].alias("text")).mapInArrow(_item_seeds, f"seed long, mask int, item {item_type}, size int, item_words binary").distinct()
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    # at most 2 ** (FILTER_BITS - 6) rows a mask
    maps = items.groupBy("mask", F.shiftrightunsigned(place, 6).alias("place")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")).alias("bits"), F.count("*").alias("n")).toArrow()
    mask, at, bits, n = (maps.column(c).to_numpy() for c in ("mask", "place", "bits", "n"))
    shared = spark.sparkContext.broadcast(_Filter(mask, at, bits))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, words, firsts in words_of(batch.column(1)):
                got = _seed_rows(words, firsts, shared.value.wanted, _NO_WORD, shared.value.maps)
                if got:
                    h, _, text, around = got
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(row + a + text), batch.column(0).take(pa.array(a + text)), _as_binary(around)], names=["seed", "row", "tag", "doc_words"])
            row += batch.num_rows

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, _CONTEXT) for k in (4, 5))
            size = batch.column(3).to_numpy()
            whole, same = (np.cumsum(np.pad(v, ((0, 0), (1, 0))), axis=1) for v in ((x != _NO_WORD) & (y != _NO_ITEM_WORD), x == y))
            most = np.zeros(len(size), np.int32)
            for s in np.unique(size).tolist():
                own = np.flatnonzero(size == s)
                full = whole[own, s:] - whole[own, :-s] == s
                most[own] = np.where(full, same[own, s:] - same[own, :-s], 0).max(1)
            hit = pa.array(most >= SHARE * size)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit), batch.column(2).filter(hit), pa.array(most).filter(hit)], names=["row", "tag", "item", "n_same"])

    found = text_rows(docs, tag.alias("tag"), docs[text_col].alias("text")).mapInArrow(doc_seeds, f"seed long, row long, tag {tag_type}, doc_words binary")
    small = int(n.sum()) * (8 * _CONTEXT + 40) <= BROADCAST_BYTES
    both = found.join(F.broadcast(items) if small else items.hint("merge"), "seed").select("row", "tag", "item", "size", "doc_words", "item_words")
    return both.mapInArrow(verified, f"row long, tag {tag_type}, item {item_type}, n_same int")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, n_same): one row per document and item with a verified overlap, n_same its best window's agreeing words."""
    hits = _hits(docs, benchmark, docs[id_col], text_col, item_col, item_text_col)
    best = hits.groupBy("row", "tag", "item").agg(F.max("n_same").alias("n_same"))
    return best.select(F.col("tag").alias(id_col), F.col("item").alias("item_id"), "n_same")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without those that overlap any benchmark item; a document is told by two 64-bit hashes of its text."""

    def digest(text):
        text = F.coalesce(text, F.lit(""))
        return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))

    gone = _hits(docs, benchmark, digest(docs[text_col]), text_col, item_col, item_text_col).select("tag.x", "tag.y").distinct()
    mine = digest(docs[text_col])
    return docs.join(gone, (mine["x"] == gone["x"]) & (mine["y"] == gone["y"]), "left_anti")
