"""Near-duplicate embeddings by spherical-cap filters.

A filter direction is the concatenation of two codewords, one for each half of
the rotated space: a random product code.  A vector is list-decoded to all
directions whose inner product with it exceeds a threshold (and to its best
``FLOOR`` where fewer do), by expanding only first codewords that the best second
one can still lift over it.  Vectors that share a filter meet in a join on filters.

The threshold follows the number of vectors, so that an average filter holds
``OCCUPANCY`` of them, and the code's size follows from the threshold, so that two
vectors at the wanted cosine share ``SHARED`` filters in the mean, at any size.

What meets in a filter is compared by 192 random signs.  At cosine 0.9 they differ
in more than 45 places about twice in 10,000 times; members of one cap lean to its
direction, and of 75 million vectors about one pair in 10,000 of an unrelated one's
stays below that, fewer at smaller sizes.  That gives candidate classes, which are
supersets: a filter with more than ``HELD`` members, or with more than
``HOT`` in one Arrow batch, becomes one class without comparison, so hot filters
cost no more than their rows.  Within a class every pair is verified by its
cosine in double precision: classes up to ``HELD`` in one task, larger ones block by
block.  A large class is laid out by the angle from its mean direction.  By the
triangle inequality of angles, blocks that are near enough to it are linked as a
whole and counted, blocks too far apart are left out, and only the rest is
compared.  Tight groups of copies are thus linear in their size; what remains of
a large class costs its pairs of blocks.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite
component links with nothing and is its own component; vectors of different
lengths do not link; equal rows are vectors of their own, linked to each other;
rows that share a vec_id are separate vectors of one id; a null vec_id is never a
smallest id, and its row is not kept; an empty table gives an empty result; labels
and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, degrees
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .textkit import checkpointed, mix

MIN_COSINE = 0.9
#: Independent rotations, each with a code of its own.
CODES = 8
#: Vectors in an average filter; filters that a pair at MIN_COSINE shares in the mean; filters a code gives every vector at least.
OCCUPANCY, SHARED, FLOOR = 16, 8, 3
#: Signs of a vector, and in how many of them two vectors of a candidate pair may differ.
SIGNS, MOST_SIGNS = 192, 45
#: Vectors that a task compares at once; members of a filter in one batch that make it one class.
HELD, HOT = 2048, 256
#: Degrees from a class's mean direction that a bin of a large class spans, and what rounding may take.
BIN, SLACK = 0.5, 1e-6


def pair_rate(threshold: float, cosine: float) -> float:
    """The probability that two standard normal values with that correlation both exceed ``threshold``."""
    normal = NormalDist()
    x = np.linspace(threshold, threshold + 8, 2001)
    beyond = np.array([1 - normal.cdf((threshold - cosine * v) / (1 - cosine * cosine) ** 0.5) for v in x])
    return float(np.trapezoid(np.exp(-x * x / 2) / (2 * np.pi) ** 0.5 * beyond, x))


def code_size(vectors: int, cosine: float) -> tuple[float, int]:
    """The threshold and the codewords of one half, for so many vectors."""
    rate = min(0.25, OCCUPANCY / max(vectors, 1))
    threshold = NormalDist().inv_cdf(1 - rate)
    return threshold, max(2, ceil((SHARED / CODES / pair_rate(threshold, cosine)) ** 0.5))


@lru_cache(8)
def codes(dim: int, words: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """(rotation, first codewords, second codewords) of every code, and the planes of the signs; ``dim`` is even."""
    rng = np.random.default_rng(dim * 1_000_003 + words)

    def book():
        c = rng.normal(size=(words, dim // 2))
        return (c / np.linalg.norm(c, axis=1)[:, None] * (dim // 2) ** 0.5).T

    return [(np.linalg.qr(rng.normal(size=(dim, dim)))[0], book(), book()) for _ in range(CODES)], rng.normal(size=(dim, SIGNS))


def list_decode(x: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter index) for every filter of one code that a row of ``x`` exceeds, or that is among its FLOOR best."""
    turn, first, second = code
    y = x @ turn
    half = y.shape[1] // 2
    a, b = y[:, :half] @ first, y[:, half:] @ second
    top = min(FLOOR, a.shape[1])
    best = np.partition(a, -top, axis=1)[:, -top:, None] + np.partition(b, -top, axis=1)[:, None, -top:]
    least = np.minimum(threshold, np.sort(best.reshape(len(x), -1), axis=1)[:, -min(FLOOR, top * top)])
    row, i = np.nonzero(a >= (least - b.max(axis=1) - 1e-9)[:, None])  # rounding may not cost the best sums
    hit = a[row, i][:, None] + b[row] >= least[row][:, None]
    at, j = np.nonzero(hit)
    return row[at], i[at] * b.shape[1] + j


def unit_rows(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of usable vectors and their directions in double precision."""
    found: dict[int, tuple[list, list]] = {}
    for i, v in enumerate(vectors):
        values = v.values if v.is_valid else None
        if values is None or not len(values) or values.null_count:
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if np.isfinite(top) and top > 0:
            at, rows = found.setdefault(len(x), ([], []))
            at.append(i)
            rows.append(x / top)
    return {n: (np.asarray(at), (m := np.vstack(rows)) / np.linalg.norm(m, axis=1)[:, None]) for n, (at, rows) in found.items()}


def _even(x: np.ndarray) -> np.ndarray:
    """With zeros up to an even length of at least eight."""
    n = max(8, x.shape[1] + x.shape[1] % 2)
    return np.pad(x, ((0, 0), (0, n - x.shape[1])))


def _filters(threshold: float, words: int):
    """Rows (row, vector) to (filter, row, signs): one for every filter of every vector.

    A filter of more than HOT rows of a batch sends its first one, marked by ~row;
    the others are sent as links to it, each under a filter of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for n, (at, x) in unit_rows(batch.column(1)).items():
                x = _even(x)
                family, planes = codes(x.shape[1], words)
                signs = np.packbits(x @ planes > 0, axis=1).view(np.int64)
                found = [list_decode(x, code, threshold) for code in family]
                row = np.concatenate([r for r, _ in found])
                key = np.concatenate([mix((np.uint64(k * 1009 + n) << np.uint64(40)) + f.astype(np.uint64)) >> np.uint64(1) for k, (_, f) in enumerate(found)]).astype(np.int64)
                order = np.argsort(key, kind="stable")
                row, key = row[order], key[order]
                _, first, size = np.unique(key, return_index=True, return_counts=True)
                hot = np.repeat(size > HOT, size)
                lead = np.repeat(row[first], size)
                me, to = ids[at[row]], ids[at[lead]]
                sign = signs[row]
                link = hot & (row != lead)
                key = np.where(link, ~me, key)
                me = np.where(hot & ~link, ~me, me)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(me), pa.array(np.where(link, to, sign[:, 0])), pa.array(sign[:, 1]), pa.array(sign[:, 2])], names=["filter", "row", "s1", "s2", "s3"])

    return run


def walk(near: np.ndarray) -> np.ndarray:
    """By member the smallest member that it reaches over the symmetric matrix ``near``."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            root[i] = i
            new = np.array([i])
            while len(new):
                new = np.flatnonzero(near[new].any(axis=0) & (root < 0))
                root[new] = i
    return root


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the members of each filter whose signs agree; rows come sorted by filter."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[tuple] = []

    def compare() -> None:
        key, row, s1, s2, s3 = (np.concatenate(x) for x in zip(*held))
        held.clear()
        own = int(np.searchsorted(key, 0))  # links under filters of their own stand first
        out.append((row[:own], s1[:own]))
        key, row = key[own:], row[own:]
        signs = [s[own:].view(np.uint64) for s in (s1, s2, s3)]
        _, first, size = np.unique(key, return_index=True, return_counts=True)
        for a, n in zip(first.tolist(), size.tolist()):
            if n == 1:
                continue
            members = row[a : a + n]
            if n > HELD or members.min() < 0:
                members = np.where(members < 0, ~members, members)
                out.append((members[1:], np.full(n - 1, members[0])))
                continue
            apart = sum(np.bitwise_count(s[a : a + n, None] ^ s[None, a : a + n]) for s in signs)
            near = apart <= MOST_SIGNS
            if near.sum() > n:
                root = walk(near)
                far = root != np.arange(n)
                out.append((members[far], members[root[far]]))

    def links() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    lead: tuple[int, int] | None = None  # of a filter that has sent HELD members already: the rest joins its first one
    for batch in batches:
        part = tuple(c.to_numpy() for c in batch.columns)
        if lead is not None:
            rest = int(np.searchsorted(part[0], lead[0], "right"))
            out.append((np.where(part[1][:rest] < 0, ~part[1][:rest], part[1][:rest]), np.full(rest, lead[1])))
            part = tuple(c[rest:] for c in part)
            if not len(part[0]):
                continue
            lead = None
        key = part[0]
        if held and held[-1][0][-1] != key[0]:
            compare()
        held.append(part)
        cut = int(np.searchsorted(key, key[-1]))  # the last filter may go on
        if cut:
            held[-1] = tuple(c[:cut] for c in part)
            compare()
            held.append(tuple(c[cut:] for c in part))
            yield links()
        if key[-1] >= 0 and sum(len(h[0]) for h in held) > HELD:
            first = int(held[0][1][0])
            lead = (int(key[-1]), ~first if first < 0 else first)
            compare()
    if held:
        compare()
    yield links()


def _verified(cosine: float):
    """Rows (pair, side, row, vector), sorted by pair: for each row its links in the pair and a row that it reaches.

    Side 0 alone is compared with itself, else side 0 with side 1.
    """

    def links(rows: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> tuple[np.ndarray, ...]:
        side, ids = np.concatenate([r[0] for r in rows]), np.concatenate([r[2] for r in rows])
        near = np.zeros((len(ids), len(ids)), bool)
        for at, x in unit_rows(pa.concat_arrays([r[1] for r in rows])).values():
            near[np.ix_(at, at)] = x @ x.T >= cosine
        if side.any():
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        return ids, near.sum(axis=1), ids[walk(near)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def made() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "n", "to"])

        for batch in batches:
            key, side, row = (batch.column(i).to_numpy() for i in (0, 1, 2))
            firsts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else [0]
            for a, b in zip(firsts[:-1], firsts[1:]):
                if now != key[a] and held:
                    out.append(links(held))
                    held.clear()
                now = key[a]
                held.append((side[a:b], batch.column(3).slice(a, b - a), row[a:b]))
            yield made()
        if held:
            out.append(links(held))
        yield made()

    return run


def _in_blocks(members: DataFrame, cosine: float, held: int) -> tuple[DataFrame, DataFrame]:
    """For classes of more than ``held``: (what must be compared: pair, side, row, vector; what is sure: row, n, to)."""
    widest = degrees(acos(cosine))
    unit = F.transform("vector", lambda v: v / F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, w: s + w * w)))
    flat = members.select("class", "row", "vector", F.posexplode(unit).alias("place", "value"))
    mean = flat.groupBy("class", "place").agg(F.avg("value").alias("value")).groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot("vector", "mean"), F.sqrt(dot("vector", "vector") * dot("mean", "mean"))), F.lit(0.0))))))
    binned = members.join(mean, "class").select("class", "row", "vector", F.floor(angle / BIN).cast("int").alias("bin"))
    parts = binned.groupBy("class", "bin").agg(F.ceil(F.count("*") / (held // 2)).cast("int").alias("parts"))
    placed = checkpointed(binned.join(parts, ["class", "bin"]).select("class", "row", "vector", "bin", F.expr("int(pmod(xxhash64(row), parts))").alias("part")))
    blocks = checkpointed(placed.groupBy("class", "bin", "part").agg(F.count("*").alias("size"), F.min("row").alias("least")))
    one = blocks.select("class", "bin", "part", "size", F.struct("bin", "part").alias("block"))
    other = blocks.select("class", F.col("bin").alias("bin2"), F.col("part").alias("part2"), F.col("size").alias("size2"), "least", F.struct(F.col("bin").alias("bin"), F.col("part").alias("part")).alias("block2"))
    pairs = one.join(other, "class")
    sure = (F.col("bin") + F.col("bin2") + 2) * BIN <= widest - SLACK
    itself = F.col("block") == F.col("block2")
    counted = pairs.where(sure).groupBy("class", "bin", "part").agg(F.sum(F.col("size2") - itself.cast("int")).alias("n"), F.min(F.struct("block2", "least"))["least"].alias("to"))
    apart = (F.abs(F.col("bin") - F.col("bin2")) - 1) * BIN > widest + SLACK
    low, high = F.least("block", "block2"), F.greatest("block", "block2")
    open_ = pairs.where(~sure & ~apart).select("class", "bin", "part", F.xxhash64("class", low, high).alias("pair"), (F.col("block") > F.col("block2")).cast("int").alias("side"))
    return placed.join(open_, ["class", "bin", "part"]).select("pair", "side", "row", "vector"), placed.join(counted, ["class", "bin", "part"]).select("row", "n", "to")


def candidate_classes(vectors: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """(row, class) for every row of (row, vector) that shares a filter, and most signs, with another one."""
    threshold, words = code_size(vectors.count(), cosine)
    met = vectors.mapInArrow(_filters(threshold, words), "filter long, row long, s1 long, s2 long, s3 long").repartition("filter").sortWithinPartitions("filter").mapInArrow(_classes, "a long, b long")
    return connected_components(met).select(F.col("node").alias("row"), F.col("component").alias("class"))


def verified_links(vectors: DataFrame, classes: DataFrame, cosine: float = MIN_COSINE, held: int = HELD) -> DataFrame:
    """(row, n_links, component) of all rows with a link; component is the smallest row reached."""
    sizes = classes.groupBy("class").agg((F.count("*") > held).alias("large"))
    members = checkpointed(classes.join(sizes, "class").join(vectors, "row").select("class", "row", "vector", "large"))
    small = members.where("not large").select(F.col("class").alias("pair"), F.lit(0).alias("side"), "row", "vector")
    compared, sure = _in_blocks(members.where("large").drop("large"), cosine, held)
    dealt = small.withColumn("blocks", F.lit(False)).unionByName(compared.withColumn("blocks", F.lit(True)))
    dealt = dealt.select(F.when(F.col("blocks"), F.col("pair")).otherwise(F.xxhash64("pair")).alias("pair"), "side", "row", "vector")
    found = dealt.repartition("pair").sortWithinPartitions("pair", "side", "row").mapInArrow(_verified(cosine), "row long, n long, to long")
    found = checkpointed(found.where("n > 0").unionByName(sure.where("n > 0").select("row", F.col("n").cast("long").alias("n"), "to")))
    return found.groupBy("row").agg(F.sum("n").alias("n_links")).join(connected_components(found, "row", "to").select(F.col("node").alias("row"), "component"), "row")


def near_duplicates(embeddings: DataFrame, cosine: float = MIN_COSINE, held: int = HELD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector; see the module's text."""
    numbered = checkpointed(embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).withColumn("row", F.monotonically_increasing_id()))
    usable = numbered.select("row", "vector").where("size(vector) > 0")
    found = checkpointed(verified_links(usable, candidate_classes(usable, cosine), cosine, held))
    named = found.join(numbered.select("row", "vec_id"), "row")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    joined = numbered.select("row", "vec_id").join(found, "row", "left").join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
