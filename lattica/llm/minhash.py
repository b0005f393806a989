"""MinHash document fingerprints over word shingles, in vectorised numpy.

A shingle's hash goes through many universal hash functions (multiply and add
modulo 2**64 with odd multipliers, so each permutes the hashes); the minimum of
each makes the signature.  Near-duplicates are found by joining signature bands
in Spark and verifying the Jaccard similarity of the shingle sets.

All pairs that share a band are settled.  First each text meets the texts that have
the same first text of their bands, in blocks of bounded size; verified links form
components.  Only bands that hold several components are looked at again: their
texts are compared across components, together with those of other bands where they
all fit a block, else band by band, and block by block where a band is larger.  A
comparison walks from the texts that are reached to those that are not, so groups of
near copies take steps in proportion to their members; each set of shingles travels
to the blocks that need it.

Defined cases: a null text counts as empty; texts without words share one
fingerprint (likeness 1 to each other, about 0 to others) and one component;
fewer words than a shingle has form one shingle; equal texts have equal
fingerprints; ids are integers, or of any other type and then ordered as strings;
rows with equal doc_id are ordered by a hash of their text; a null doc_id comes
last in descending order and is never a smallest id; an empty table gives an
empty result; other columns are not looked at.  Different texts are told apart by
two 64-bit hashes, and paired under the first of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .textkit import LOWER, byte_chunks, checkpointed, mix, span_hashes, text_rows, word_spans

SHINGLE_WORDS = 5
#: Hash functions, bits kept of each minimum, and bands of so many minima: of pairs at a similarity of 0.8 a share of
#: 1 - (1 - 0.8^6)^21 = 0.998 meets in a band, of those at 0.4, which are many, one in twelve.
FUNCTIONS = 128
BITS = 16
BANDS = 21
BAND_ROWS = 6
SIMILARITY = 0.8
#: Text of one block of the descending order of ids, the unit of the shuffle; beyond MAX_BLOCKS blocks grow instead
#: (they are sorted with spill and streamed).  The driver sees about IDS_PER_BLOCK ids for each block.
BLOCK_BYTES = 8 << 20
MAX_BLOCKS = 1 << 14
IDS_PER_BLOCK = 20
#: Texts, and shingles of them, that are compared in one block; larger groups are compared block by block.
PAIRED = 4096
BLOCK_SHINGLES = 1 << 19
#: Links that a task gathers before it sends them on.
HELD_LINKS = 1 << 16
#: Texts that a task remembers in order not to send their bands again.
KNOWN_TEXTS = 1 << 18
#: Texts whose numbers are broadcast to find them (8 bytes each); more are joined by a shuffle.
BROADCAST_TEXTS = 1 << 20

_RNG = np.random.default_rng(977)
_A = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of each document, and the documents' firsts among them."""
    sizes = np.diff(firsts)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    ends = np.cumsum(counts)
    at = np.repeat(firsts[:-1] - (ends - counts), counts) + np.arange(int(counts.sum()))
    last = np.repeat(firsts[1:], counts)
    h = np.zeros(len(at), np.uint64)
    padded = np.append(words, np.zeros(k, np.uint64))
    for j in range(k):
        h = (h + np.where(at + j < last, padded[at + j], np.uint64(j))) * _STEP
        h ^= h >> np.uint64(29)
    return mix(h), np.concatenate([[0], ends])


def signatures(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(documents, FUNCTIONS) minima; all ones for a document without shingles."""
    n = len(firsts) - 1
    out = np.full((n, FUNCTIONS), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(np.diff(firsts))
    if len(some):
        tops = firsts[:-1][some]
        # parts that stay in the processor's cache
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(tops, tops[at] + 16384)))
            part = hashes[tops[at] : firsts[some[to - 1] + 1]]
            rel = tops[at:to] - tops[at]
            one = np.empty_like(part)
            for f in range(FUNCTIONS):
                np.multiply(part, _A[f], out=one)
                one += _B[f]
                out[some[at:to], f] = np.minimum.reduceat(one, rel)
            at = to
    return out


def reduced(signature: np.ndarray) -> np.ndarray:
    """The kept bits of every minimum, well mixed."""
    return (mix(signature) >> np.uint64(64 - BITS)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of reduced signatures, row by row."""
    same = (a == b).mean(1)
    chance = 2.0**-BITS
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for a, _, buf, offsets in byte_chunks(texts):
        low = LOWER[buf]
        starts, ends, firsts = word_spans(low, offsets)
        yield a, span_hashes(low, starts, ends), firsts


def sign(texts: pa.Array) -> np.ndarray:
    """Reduced signatures of a batch of texts."""
    out = np.zeros((len(texts), FUNCTIONS), ">u2")
    for a, words, firsts in _word_hashes(texts):
        out[a : a + len(firsts) - 1] = reduced(signatures(*shingle_hashes(words, firsts)))
    return out


def _hex(rows: np.ndarray) -> pa.Array:
    width = 4 * FUNCTIONS
    text = np.ascontiguousarray(rows).tobytes().hex()
    return pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string())


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, packed text, head, x, y, class_id, component_id) in blocks by descending id, each block ended by the
    head of the next one -> rows with both fingerprints."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "component_id"]
    held = None  # the last row so far, which lacks its next; and its text and signature

    for batch in _labelled(batches):
        for lo in range(0, batch.num_rows, 512):
            rows = batch.slice(lo, 512)
            texts = [_unpacked(t) for t in rows.column(2).to_pylist()]
            sigs = sign(pa.array(texts, pa.string()))
            if held is not None:
                rows, texts, sigs = pa.concat_batches([held[0], rows]), [held[1], *texts], np.concatenate([held[2], sigs])
            changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
            mine = sign(pa.array(changed, pa.string()))
            olds = rows.slice(0, len(changed))
            out = pa.RecordBatch.from_arrays([olds.column(1), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), _hex(sigs[:-1]), _hex(mine), pa.array(likeness(sigs[:-1], mine)), pa.array(likeness(sigs[:-1], sigs[1:])), olds.column(6), olds.column(7)], names=names)
            keep = pc.invert(olds.column(3))  # a head only serves the document before it
            if pc.any(keep).as_py():
                yield out.filter(keep)
            held = rows.slice(len(texts) - 1), texts[-1], sigs[-1:]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a text; class_id and component_id are those of the row without text just before with the same id and
    hashes, or else the id."""
    label: tuple = ()
    for batch in batches:
        bare = batch.column(2).is_null()
        found: list[tuple] = []
        for at, is_label, *own in zip(*(c.to_pylist() for c in (batch.column(1), bare, *batch.columns[4:]))):
            if is_label:
                label = at, *own
            else:
                found.append(label[3:] if label[:3] == (at, *own[:2]) else (at, at))
        rows = batch.filter(pc.invert(bare))
        labels = [pa.array([f[k] for f in found], batch.schema.field(1).type) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*rows.columns[:6], *labels], names=batch.schema.names)


def _packed(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> str:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True).decode()


class _Cuts:
    """Bounds (id, hash) that cut the descending order of rows into blocks, and pieces for the rows without an id."""

    def __init__(self, ids: list, hashes: list[int], pieces: int):
        self.ids = np.array(ids, object if ids and isinstance(ids[0], str) else np.int64)
        self.backwards = ~np.array(hashes, np.int64)
        self.pieces = pieces

    def block_of(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        """Block 0 holds the largest ids (of equal ones, the smallest hashes); rows without an id come last, by hash."""
        some = ids.is_valid().to_numpy(zero_copy_only=False)
        h = hashes.to_numpy()
        out = len(self.ids) + 1 + ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64) * self.pieces // (1 << 32)
        own = ids.filter(pa.array(some))
        x = own.to_numpy(zero_copy_only=False) if self.ids.dtype == object else own.to_numpy()
        below, upto = (np.searchsorted(self.ids, x, side) for side in ("left", "right"))
        back = ~h[some]
        for cut in np.unique(below[upto > below]).tolist():  # ids that are a bound themselves
            mine = np.flatnonzero((below == cut) & (upto > cut))
            below[mine] += np.searchsorted(self.backwards[cut : upto[mine[0]]], back[mine], "left")
        out[some] = len(self.ids) - below
        return out.astype(np.int32)


def _cuts(rows: DataFrame, block_bytes: int) -> _Cuts:
    """Quantiles of rows chosen by a hash; where the bounds lie changes no result."""
    n, nulls, size = rows.agg(F.count("id"), F.count_if(F.col("id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = min(-(-int(size) // block_bytes), MAX_BLOCKS)
    if blocks < 2:
        return _Cuts([], [], 1)
    pieces = max(blocks * nulls // (n + nulls), 1)
    one_in = max(n // (IDS_PER_BLOCK * blocks), 1)
    chosen = rows.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64(F.lit(2), "id", "x"), F.lit(one_in)) == 0)).select("id", "x").toArrow()
    order = sorted(zip(chosen.column("id").to_pylist(), (~chosen.column("x").to_numpy()).tolist()))
    cuts = sorted({order[len(order) * k // blocks] for k in range(1, blocks)}) if order else []
    return _Cuts([i for i, _ in cuts], [~b for _, b in cuts], pieces)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, x, y): x and y are hashes of the text."""
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    text = F.coalesce(docs[text_col], F.lit(""))
    return text_rows(docs, docs[id_col].cast("long" if whole else "string").alias("id"), text.alias("text"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id,
    component_id (the smallest ids of equal texts and of near-duplicates).

    The order of ids is cut into blocks.  A block is sorted in one task, and gets the first
    document of the block after it, so that no document is without its next.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col)
    carried = rows.schema["id"].dataType.simpleString()
    cuts = _cuts(rows, block_bytes)

    @F.arrow_udf("int")
    def block_of(ids: pa.Array, x: pa.Array) -> pa.Array:
        return pa.array(cuts.block_of(ids, x))

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([_packed(t) for t in texts.to_pylist()], pa.binary())

    rows = rows.withColumn("block", block_of("id", "x"))
    tops = rows.groupBy("block").agg(F.max(F.struct("id", F.bitwise_not("x").alias("back"))).alias("top"))
    # a row for each of at most 2 * MAX_BLOCKS blocks: the block that each head also serves is the one before, cyclically
    span = Window.orderBy(F.col("block"))
    tops = tops.withColumn("serves", F.coalesce(F.lag("block").over(span), F.max("block").over(Window.partitionBy())))
    heads = rows.join(F.broadcast(tops), "block").where(F.col("id").eqNullSafe(F.col("top.id")) & (F.bitwise_not("x") == F.col("top.back")))
    heads = heads.groupBy("serves").agg(F.min_by(F.struct("id", "text", "x", "y"), "y").alias("row")).select(F.col("serves").alias("block"), "row.*", F.lit(True).alias("head"))
    both = rows.select("block", "id", "text", "x", "y", F.lit(False).alias("head")).unionByName(heads)
    none = F.lit(None).cast(carried)
    both = both.select("block", "id", packed("text").alias("text"), "head", "x", "y", none.alias("class_id"), none.alias("component_id"))
    # labels go to the blocks as rows of their own, before those with their id and text
    groups = checkpointed(_text_groups(_rows(docs, id_col, text_col)).where("n > 1 or linked").select("x", "y", "class_id", "component_id"))
    labels = _rows(docs, id_col, text_col).select("id", "x", "y").join(groups, ["x", "y"]).distinct()
    labels = labels.select(block_of("id", "x").alias("block"), "id", F.lit(None).cast("binary").alias("text"), F.lit(False).alias("head"), "x", "y", *(F.coalesce(c, "id").alias(c) for c in ("class_id", "component_id")))
    dealt = both.unionByName(labels).repartition(F.col("block")).sortWithinPartitions(F.col("block"), F.col("head"), F.col("id").desc_nulls_last(), F.col("x"), F.col("y"), F.col("text").isNotNull())
    out = dealt.mapInArrow(_compare, f"id {carried}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id {carried}, component_id {carried}")
    return out.select(F.col("id").cast(id_type).alias(id_col), *(F.col(c).cast(id_type) if c.endswith("_id") else F.col(c) for c in out.columns[1:]))


def _distinct(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The different hashes of each text, counted."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
    return np.bincount(t[new], minlength=len(firsts) - 1)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, text) -> (band, no, node, size): the BANDS bands and the shingles of each text that the task has not seen lately."""
    known = np.zeros(0, np.int64)
    for batch in batches:
        node, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        new = ~np.isin(node, known)
        node, first = node[new], first[new]
        known = np.union1d(known, node) if len(known) < KNOWN_TEXTS else node
        if not len(node):
            continue
        own = batch.column(1).take(pa.array(first))
        sizes = np.concatenate([np.zeros(0, np.int64), *(_distinct(*shingle_hashes(words, firsts)) for _, words, firsts in _word_hashes(own))])
        sigs = sign(own)[:, : BANDS * BAND_ROWS].astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
        h = np.zeros(sigs.shape[:2], np.uint64)
        for j in range(BAND_ROWS):
            h = mix(h * _STEP + sigs[:, :, j])
        no = np.arange(BANDS, dtype=np.uint64)
        band = mix(h ^ mix(no + np.uint64(1)))
        yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), pa.array(np.tile(no.astype(np.int8), len(node))), pa.array(np.repeat(node, BANDS)), pa.array(np.repeat(sizes.astype(np.int32), BANDS))], names=["band", "no", "node", "size"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, no, node, size) sorted by band and by an order of its own in each band -> the same with the group's first
    node and its size as ``pivot`` and ``pivot_size``, repeated nodes once, groups of one node left out."""
    held = None  # the last row: it may be alone in its group

    def out(rows: pa.RecordBatch, more: bool):
        band, node = rows.column(0).to_numpy(), rows.column(2).to_numpy()
        new = np.append(True, (band[1:] != band[:-1]) | (node[1:] != node[:-1]))
        rows, band, node = rows.filter(pa.array(new)), band[new], node[new]
        top = np.append(band[0] != now[0], band[1:] != band[:-1])
        at = np.maximum.accumulate(np.where(top, np.arange(len(band)), -1))
        size = rows.column(3).to_numpy()
        pivot, pivot_size = (np.where(at >= 0, v[np.maximum(at, 0)], w) for v, w in ((node, now[1]), (size, now[2])))
        last = np.append(top[1:], True)
        shared = ~(top & last)
        shared[-1] = shared[-1] and not more  # held back
        return rows, pivot, pivot_size.astype(np.int32), shared

    now: tuple[int | None, int, int] = (None, 0, 0)  # the open group, its pivot and the pivot's size
    for batch in _with_end(batches):
        if batch is not None and not batch.num_rows:
            continue
        rows = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if rows is None:
            return
        rows, pivot, pivot_size, shared = out(rows, batch is not None)
        if shared.any():
            own = pa.array(shared)
            yield pa.RecordBatch.from_arrays([*(c.filter(own) for c in rows.columns), pa.array(pivot[shared]), pa.array(pivot_size[shared])], names=["band", "no", "node", "size", "pivot", "pivot_size"])
        held = rows.slice(len(rows) - 1) if batch is not None else None
        n = len(rows)
        if n > 1 and rows.column(0)[n - 1] == rows.column(0)[n - 2]:
            now = (rows.column(0)[n - 1].as_py(), int(pivot[-1]), int(pivot_size[-1]))
        elif n == 1 and rows.column(0)[0].as_py() == now[0]:
            pass
        else:
            now = (None, 0, 0)


def _with_end(batches):
    yield from batches
    yield None


def set_links(nodes: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of sets with that Jaccard similarity that connect, together with what the parts connect, all that any such
    links would; empty sets are equal to each other.  Walks from the reached to the unreached."""
    sizes = np.array([len(v) for v in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    nodes, sizes = nodes[order], sizes[order]
    part = np.unique(parts[order], return_inverse=True)[1]
    by_part = np.argsort(part, kind="stable")
    firsts = np.searchsorted(part[by_part], np.arange(len(nodes) + 1))
    members = lambda p: by_part[firsts[p] : firsts[p + 1]]
    ids = np.unique(np.concatenate([np.zeros(0, np.int32), *(sets[i] for i in order)]), return_inverse=True)[1].astype(np.int32)
    row = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)
    common = np.bincount(ids)[ids] > 1 if len(ids) else np.zeros(0, bool)  # shingles of one text are in no intersection
    ids, row = ids[common], row[common]
    offsets = np.searchsorted(row, np.arange(len(nodes) + 1))
    mine = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint8)
    rest, front = np.ones(len(nodes), bool), []
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while True:
        if not front:
            while at < len(nodes) and not rest[at]:
                at += 1
            if at == len(nodes):
                break
            front = members(part[at]).tolist()
            rest[front] = False
        one = front.pop()
        size = sizes[one]
        lo, hi = np.searchsorted(sizes, similarity * size - 0.001), np.searchsorted(sizes, size / similarity + 0.001, "right")
        to = lo + np.flatnonzero(rest[lo:hi])
        if not len(to):
            continue
        own = ids[offsets[one] : offsets[one + 1]]
        mine[own] = 1
        if 4 * len(to) < hi - lo:
            n = offsets[to + 1] - offsets[to]
            ends = np.cumsum(n)
            seen = mine[ids[np.repeat(offsets[to] - (ends - n), n) + np.arange(int(ends[-1]))]]
            starts = ends - n
        else:
            seen = mine[ids[offsets[lo] : offsets[hi]]]
            starts, ends = offsets[to] - offsets[lo], offsets[to + 1] - offsets[lo]
        sums = np.zeros(len(seen) + 1, np.int64)
        np.cumsum(seen, out=sums[1:])
        both = sums[ends] - sums[starts]
        mine[own] = 0
        hits = to[both >= similarity * (size + sizes[to] - both)]
        if len(hits):
            left.append(np.full(len(hits), nodes[one]))
            right.append(nodes[hits])
            for p in np.unique(part[hits]).tolist():
                more = members(p)
                rest[more] = False
                front += more.tolist()
    return np.concatenate(left), np.concatenate(right)


def _job_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text, part, jobs) -> (job, node, part, set): 32-bit hashes of the different shingles, for every job; texts
    that the task has not seen lately."""
    known = np.zeros(0, np.int64)
    for batch in batches:
        node, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        new = ~np.isin(node, known)
        node, first = node[new], first[new]
        known = np.union1d(known, node) if len(known) < KNOWN_TEXTS else node
        rows = batch.take(pa.array(first))
        for a, words, firsts in _word_hashes(rows.column(1)):
            h, ends = shingle_hashes(words, firsts)
            each = pa.array([np.unique((h[x:y] >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x, y in zip(ends, ends[1:])], pa.list_(pa.int32()))
            own = rows.slice(a, len(each))
            jobs = own.column(3).to_pylist()
            for k in range(max(map(len, jobs))):
                some = pa.array([i for i, j in enumerate(jobs) if k < len(j)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([j[k] for j in jobs if k < len(j)], pa.int64()), own.column(0).take(some), own.column(2).take(some), each.take(some)], names=["job", "node", "part", "set"])


def _job_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (job, node, part, set) sorted by job and node -> links (a, b) of each job."""
    held: list[pa.RecordBatch] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def settle():
        node, part = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (1, 2))
        sets = [v.values.to_numpy() for b in held for v in b.column(3)]
        once = np.flatnonzero(np.append(True, node[1:] != node[:-1])).tolist()  # copies of a text come from several tasks
        held.clear()
        found.append(set_links(node[once], part[once], [sets[i] for i in once], similarity))

    def out():
        a, b = (np.concatenate(x) for x in zip(*found))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        job = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.append(True, job[1:] != job[:-1])).tolist() if len(job) else []
        for x, y in zip(edges, [*edges[1:], len(job)]):
            if held and held[0].column(0)[0].as_py() != job[x]:
                settle()
            held.append(batch.slice(x, y - x))
        if sum(len(a) for a, _ in found) > HELD_LINKS:
            yield out()
    if held:
        settle()
    if found:
        yield out()


def _settled(jobs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) that connect the nodes of each job, rows (job, node, part), as all links between them would."""
    of_node = checkpointed(jobs.groupBy("node").agg(F.any_value("part").alias("part"), F.collect_set("job").alias("jobs")))
    # all but few texts are in no group, so their list is mostly small: its count tells
    of_node = F.broadcast(of_node) if of_node.count() <= BROADCAST_TEXTS else of_node
    sets = text_rows(texts.join(of_node, "node"), F.col("node"), F.col("text"), F.col("part"), F.col("jobs")).mapInArrow(_job_sets, "job long, node long, part long, set array<int>")
    dealt = sets.repartition("job").sortWithinPartitions("job", "node")
    return checkpointed(dealt.mapInArrow(lambda batches: _job_links(batches, similarity), "a long, b long"))


def group_links(groups: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between nodes that connect all those of one group with that Jaccard similarity.

    ``groups`` has a row (band, node, size, pivot) for every member of a group: its shingles or more, and the smallest
    node of the group.  ``texts`` has the text of every node at least once.
    """
    weight = F.greatest(F.col("size"), F.lit(-(-BLOCK_SHINGLES // PAIRED))).cast("long")
    near = groups.groupBy("node").agg(F.min("pivot").alias("pivot"), F.any_value("size").alias("size"))
    full = near.groupBy("pivot").agg(F.ceil(F.sum(weight) / BLOCK_SHINGLES).alias("blocks"), F.count_if(F.col("node") != F.col("pivot")).alias("others")).where("others > 0")
    dealt = checkpointed(near.join(full, "pivot").select("pivot", "node", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64(F.lit(3), "node"), "blocks")).otherwise(0).alias("block")))
    jobs = dealt.unionByName(dealt.select("pivot", F.col("pivot").alias("node"), "block")).distinct()
    links = _settled(jobs.select(F.xxhash64("pivot", "block").alias("job"), "node", F.col("node").alias("part")), texts, similarity)
    parts = connected_components(links)
    placed = groups.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    mixed = placed.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("band")
    left = checkpointed(placed.join(mixed, "band"))
    if left.isEmpty():
        return links
    reach = connected_components(left.select(F.col("node").alias("a"), F.col("pivot").alias("b"))).withColumnRenamed("component", "reach")
    left = checkpointed(left.join(reach, "node").withColumn("weight", weight))
    whole = left.dropDuplicates(["node"]).groupBy("reach").agg(F.sum("weight").alias("all")).where(F.col("all") <= BLOCK_SHINGLES).select("reach", F.lit(True).alias("whole"))
    unit = F.when(F.col("whole"), F.col("reach")).otherwise(F.col("band")).alias("unit")
    members = checkpointed(left.join(whole, "reach", "left").select(unit, "node", "part", "weight").distinct())
    # bands with the same members need one look
    sums = members.groupBy("unit").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark"), F.sum("weight").alias("all"))
    once = sums.groupBy("n", "mark").agg(F.min_by(F.struct("unit", "all"), "unit").alias("one")).select("one.*")
    members = members.join(once, "unit")
    span = Window.partitionBy("unit").orderBy("part", "node")
    large = members.where(F.col("all") > BLOCK_SHINGLES).withColumn("block", F.floor((F.sum("weight").over(span) - 1) / BLOCK_SHINGLES))
    members = checkpointed(members.where(F.col("all") <= BLOCK_SHINGLES).withColumn("block", F.lit(0).cast("long")).unionByName(large))
    blocks = checkpointed(members.groupBy("unit", "block").agg(F.min("part").alias("p"), F.max("part").alias("q")))
    pairs = blocks.alias("x").join(blocks.alias("y"), F.expr("x.unit = y.unit and x.block <= y.block and not (x.p = x.q and x.p = y.p and y.p = y.q)"))
    pairs = pairs.select("x.unit", F.xxhash64("x.unit", "x.block", "y.block").alias("job"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    jobs = pairs.join(members, ["unit", "block"]).select("job", "node", "part")
    return links.unionByName(_settled(jobs, texts, similarity))


def _text_groups(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(x, y, n, class_id, component_id, linked) of every different text of ``rows`` (id, text, x, y)."""
    texts = rows.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("class_id"))
    banded = text_rows(rows, F.col("x"), F.col("text")).mapInArrow(_banded, "band long, no byte, node long, size int")
    dealt = banded.repartition("band").sortWithinPartitions("band", "node")
    groups = checkpointed(dealt.mapInArrow(_members, "band long, no byte, node long, size int, pivot long, pivot_size int").select("band", "node", "size", "pivot"))
    links = group_links(groups, rows.select(F.col("x").alias("node"), "text"), similarity)
    parts = connected_components(links)
    labelled = texts.join(parts.withColumnRenamed("node", "x"), "x", "left")
    least = labelled.where("component is not null").groupBy("component").agg(F.min("class_id").alias("component_id"))
    return labelled.join(least, "component", "left").select("x", "y", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.col("component").isNotNull().alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, component_id) of every row: class_id is the smallest id of those with the same text, component_id the
    smallest id linked by verified Jaccard similarity between different texts; copies are not expanded."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col)
    out = rows.select("id", "x", "y").join(_text_groups(rows, similarity), ["x", "y"])
    return out.select(*(F.col(c).cast(id_type).alias(n) for c, n in (("id", id_col), ("class_id", "class_id"), ("component_id", "component_id"))))
