"""Suffix-array deduplication: removes every byte that a repeated 200-byte string covers.

Finding where strings can repeat.  Every window of LENGTH bytes is assigned to
the smallest (hashed) GRAM-byte string in it, its anchor; equal windows have
equal anchors at equal places.  Runs of windows with one anchor form a piece.
Only pieces whose anchor occurs again can hold a repeated window, and equal
pieces are repeated as a whole, so a shuffle by anchor leaves few texts to sort.

Sorting them.  The remaining pieces are dealt by their anchor and the bytes that
all their windows share, many groups to a shard.  Their texts, and those that are
left in the end, come from one shuffle of the documents, which both joins read.
Only anchors with more than a shard of pieces (the edges of a passage that very
many texts hold in different surroundings) are taken first: one of their equal
pieces each is cut from the documents where they are read, and groups that are
still larger than a shard are cut into ranges of windows, which share more bytes,
down to single windows, which are equal if their keys are; so no task holds more
than a shard and one group.  A shard's suffix array is built
by induced sorting: suffixes are classified as smaller or larger than their
successor, the leftmost-smaller (LMS) substrings are sorted by one induction and
named, the string of names is sorted, and a second induction, linear in the
shard, yields all suffixes.  Permuted common prefixes between neighbours tell
which windows occur twice.

Defined cases: a null text counts as empty (nothing removed, the hash of no
bytes); equal rows are copies of each other like any two documents; rows that
share a doc_id, or have none, are told apart by a 64-bit hash of their text; texts shorter than LENGTH
lose nothing; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import _BASE, _BASE_INV, _BYTE, byte_chunks, checkpointed, mix, powers, text_rows

LENGTH = 200
GRAM = 32
#: Windows have at least this many bytes on one side of their anchor.
SIDE = (LENGTH - GRAM) // 2
SHARD_BYTES = 3 << 19
#: Repeated pieces that a task remembers; beyond it, it starts anew and sends some of them again.
KNOWN_PIECES = 1 << 20


def _prefix(buf: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(_BASE_INV, len(buf)), out=sums[1:])
    return sums


def _span(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * powers(_BASE, len(sums) + 1)[b] ^ (b - a).astype(np.uint64))


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of a chunk of documents: (document, first window, last window, anchor, anchor's hash, piece's hash); places in ``buf``."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(buf) < LENGTH or int(np.diff(offsets).max(initial=0)) < LENGTH:
        return none
    sums = _prefix(buf)
    grams = len(buf) - GRAM + 1
    g = (sums[GRAM:] - sums[:-GRAM]) * powers(_BASE, len(buf) + 1)[GRAM:]
    g = mix(g)
    least = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    # windows that stay within their document
    lengths = np.diff(offsets) - LENGTH + 1
    lengths = np.maximum(lengths, 0)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.repeat(offsets[:-1] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(doc))
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    top = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    first, last = at[top], at[np.append(top[1:], len(at)) - 1]
    return doc[top], first, last, place[top], g[place[top]].view(np.int64), _span(sums, first, last + LENGTH).view(np.int64)


def _beyond_two(h: np.ndarray, ph: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pieces have two equals before them here, or are among those known to; and the hashes known from now on."""
    both = mix(h.view(np.uint64) ^ mix(ph.view(np.uint64)))
    order = np.argsort(both, kind="stable")
    sorted_ = both[order]
    told = np.zeros(len(both), bool)
    told[order[2:]] = sorted_[2:] == sorted_[:-2]
    told |= known[np.minimum(np.searchsorted(known, both), len(known) - 1)] == both if len(known) else False
    known = np.union1d(known, both[told])
    return told, known if len(known) <= KNOWN_PIECES else np.unique(both[told])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, ph, id, tag, pos, spread): anchor's and piece's hash; pos packs the first window, windows - 1 and the anchor's distance.

    Of equal pieces a task sends about two to meet those of other tasks; the rest are known to be repeated
    already, and have a number in ``spread`` that deals them out evenly.
    """
    known, seen = np.zeros(0, np.uint64), 0
    for batch in batches:
        tags = batch.column(2).to_numpy()
        for a, b, buf, offsets in byte_chunks(batch.column(1)):
            doc, first, last, place, h, ph = anchors(buf, offsets)
            pos = (first - offsets[doc]) << 32 | (last - first) << 24 | (place - first) << 16
            told, known = _beyond_two(h, ph, known)
            spread = pa.array(h + np.arange(seen, seen + len(h)), mask=~told)
            seen += len(h)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ph), batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(tags[a:b][doc]), pa.array(pos), spread], names=["h", "ph", "id", "tag", "pos", "spread"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, ph) -> rows of anchors that occur again, with kind 1: the piece itself occurs again; 0: sorted further;
    2: as 0, but only to be compared with (its own windows are known to be repeated)."""
    carry, before = None, None
    for batch in _with_end(batches):
        if batch is not None and batch.column(5).null_count < batch.num_rows:
            told_already = batch.column(5).is_valid()
            known = batch.filter(told_already)
            yield pa.RecordBatch.from_arrays([known.column(0), known.column(2), known.column(3), known.column(4), pa.array(np.ones(len(known), np.int8))], names=["h", "id", "tag", "pos", "kind"])
            batch = batch.filter(pc.invert(told_already))
            if not batch.num_rows:
                continue
        rows = carry if batch is None else batch if carry is None else pa.concat_batches([carry, batch])
        if rows is None or not rows.num_rows:
            continue
        h, ph = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        n = len(h)
        new = np.append(True, (h[1:] != h[:-1]) | (ph[1:] != ph[:-1]))
        top = np.flatnonzero(new)
        size = np.diff(np.append(top, n))
        done = len(top) if batch is None else len(top) - 1
        if batch is not None and size[-1] > 65536:  # a long run of equal pieces: all but two are told at once
            cut = n - 2
            carry, told = rows.slice(cut), True
        else:
            cut, told = (n if batch is None else int(top[-1])), False
            carry = rows.slice(cut) if cut < n else None
        head = h[top]
        left = np.append(before == int(head[0]) if before is not None else False, head[1:] == head[:-1])
        right = np.append(head[1:] == head[:-1], False)
        kind_rows, kinds = [], []
        many = size > 1
        full = np.repeat(many, size)
        full[cut:] = False
        if not told:
            full[top[done] if done < len(top) else n :] = False
        kind_rows.append(np.flatnonzero(full))
        kinds.append(np.ones(len(kind_rows[0]), np.int8))
        split = (left | right)[:done]
        kind_rows.append(top[:done][split])
        kinds.append(np.where(many[:done][split], 2, 0).astype(np.int8))
        if done:
            before = int(head[done - 1])
        at = np.concatenate(kind_rows)
        if len(at):
            out = rows.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(2), out.column(3), out.column(4), pa.array(np.concatenate(kinds))], names=["h", "id", "tag", "pos", "kind"])


def _with_end(batches):
    yield from batches
    yield None


def _pieces_of(large: np.ndarray):
    """Documents -> their pieces at the anchors in ``large`` (sorted hashes), with their bytes; of equal pieces about two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for batch in batches:
            tags = batch.column(2).to_numpy()
            for a, b, buf, offsets in byte_chunks(batch.column(1)):
                found = anchors(buf, offsets)
                some = np.flatnonzero(large[np.minimum(np.searchsorted(large, found[4]), len(large) - 1)] == found[4])
                told, known = _beyond_two(found[4][some], found[5][some], known)
                some = some[~told]
                if not len(some):
                    continue
                doc, first, last, place, h, ph = (x[some] for x in found)
                pos = (first - offsets[doc]) << 32 | (last - first) << 24 | (place - first) << 16
                texts = [buf[x : y + LENGTH].tobytes() for x, y in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ph), batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(tags[a:b][doc]), pa.array(pos), pa.array(texts, pa.binary())], names=["h", "ph", "id", "tag", "pos", "bytes"])

    return run


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, text, pieces, at) -> two parts of each piece, keyed by anchor and shared side; the text begins at ``at`` of its document."""
    for batch in batches:
        keys, ids, firsts, fars, kinds, texts = [], [], [], [], [], []
        raws, ats = batch.column(2).cast(pa.binary()), batch.column(4).to_pylist()
        for row, at in enumerate(ats):
            raw, pieces = raws[row].as_py() or b"", batch.column(3)[row].values
            hs, poss, kind = (pieces.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            sums = _prefix(np.frombuffer(raw, np.uint8))
            first, windows, far = (poss >> 32) - at, (poss >> 24 & 255) + 1, poss >> 16 & 255
            place = first + far
            # a window with its first byte SIDE or more before the anchor holds those SIDE bytes; else SIDE bytes after it
            n_left = np.clip(far - SIDE + 1, 0, windows)
            for lo, n, x, y, salt in ((first, n_left, place - SIDE, place + GRAM, 1), (first + n_left, windows - n_left, place, place + GRAM + SIDE, 2)):
                some = np.flatnonzero(n > 0)
                if not len(some):
                    continue
                keys.append((_span(sums, x[some], y[some]) ^ (hs[some].view(np.uint64) * np.uint64(2 * salt + 1))).view(np.int64))
                firsts.append(lo[some] + at)
                fars.append((place - lo)[some])
                ids.append(np.full(len(some), row))
                kinds.append(kind[some])
                texts += [raw[a : a + c + LENGTH - 1] for a, c in zip(lo[some].tolist(), n[some].tolist())]
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(ids))), batch.column(1).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(kinds).astype(np.int8)), pa.array(texts, pa.binary()), pa.array(np.concatenate(fars).astype(np.int32))], names=["key", "id", "tag", "first", "kind", "bytes", "far"])


def _ranges(width: int):
    """Parts of groups -> their windows in ranges of so many places, each keyed by the bytes that all windows of the range share.

    Equal windows lie at equal distances from their anchor, so ranges are counted from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, steps, fars, texts = [], [], [], [], []
            key, far = batch.column(0).to_numpy(), batch.column(6).to_numpy().astype(np.int64)
            for row, raw in enumerate(batch.column(5).to_pylist()):
                sums = _prefix(np.frombuffer(raw, np.uint8))
                number = (far[row] - np.arange(len(raw) - LENGTH + 1)) // width
                top = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                last = np.append(top[1:], len(number)) - 1
                near = number[top] * width
                shared = _span(sums, far[row] - near, far[row] - near - width + 1 + LENGTH)
                keys.append(mix(shared ^ mix(near.astype(np.uint64) ^ key[row : row + 1].view(np.uint64))).view(np.int64))
                rows.append(np.full(len(top), row))
                steps.append(top)
                fars.append(far[row] - top)
                texts += [raw[x : y + LENGTH] for x, y in zip(top.tolist(), last.tolist())]
            if texts:
                at, step = pa.array(np.concatenate(rows)), np.concatenate(steps)
                first = batch.column(3).to_numpy()[np.concatenate(rows)] + step
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(1).take(at), batch.column(2).take(at), pa.array(first), batch.column(4).take(at), pa.array(texts, pa.binary()), pa.array(np.concatenate(fars).astype(np.int32))], names=["key", "id", "tag", "first", "kind", "bytes", "far"])

    return run


# --- suffix arrays -------------------------------------------------------------------------------


def _classified(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S); the last counts as S."""
    n = len(t)
    at = np.where(np.append(t[:-1] != t[1:], True), np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    less = np.append(t[:-1] < t[1:], True)
    return less[at]


def _induced(t: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes in the order induced by ``lms`` (sorted at least by first symbol).

    A bucket's entries are taken in waves: those present push their predecessors, which may join the same bucket.
    """
    n, width = len(t), len(counts)
    tails = np.cumsum(counts)
    heads = tails - counts
    out = np.full(n, -1, np.int32)
    first = np.searchsorted(t[lms], np.arange(width + 1))
    ptr = heads.copy()

    def push(batch: np.ndarray, want_small: bool) -> None:
        q = batch[batch > 0] - 1
        q = q[small[q] == want_small]
        if not len(q):
            return
        d = t[q]
        order = np.argsort(d, kind="stable")
        d, q = d[order], q[order]
        each = np.bincount(d, minlength=width)
        rank = np.arange(len(q)) - (np.cumsum(each) - each)[d]
        if want_small:
            out[ptr[d] - 1 - rank] = q
            ptr[:] -= each
        else:
            out[ptr[d] + rank] = q
            ptr[:] += each

    used = np.flatnonzero(counts)
    for c in used:
        at = int(heads[c])
        while at < ptr[c]:
            to = int(ptr[c])
            push(out[at:to], False)
            at = to
        push(lms[first[c] : first[c + 1]], False)
    ends = ptr.copy()
    ptr[:] = tails
    for c in used[::-1]:
        if c == 0:
            break
        at = int(tails[c])
        while ptr[c] < at:
            to = int(ptr[c])
            push(out[to:at][::-1], True)
            at = to
        push(out[heads[c] : ends[c]][::-1], True)
    out[: counts[0]] = lms[: counts[0]]
    return out


def _ranked(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling; ends are unique names."""
    m = len(names)
    order = np.argsort(names, kind="stable")
    rank = names.astype(np.int64)
    k = 1
    while True:
        # ranks are places of a group's first member; only members of larger groups are looked at again
        sorted_rank = rank[order]
        start = np.append(True, sorted_rank[1:] != sorted_rank[:-1])
        group = np.maximum.accumulate(np.where(start, np.arange(m), 0))
        rank = np.empty(m, np.int64)
        rank[order] = group
        open_ = ~(start & np.append(start[1:], True))
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        members = order[at]
        nxt = members + k
        key = np.where(nxt < m, rank[np.minimum(nxt, m - 1)] + 1, 0)
        fresh = np.lexsort((key, group[at]))
        order[at] = members[fresh]
        combined = group[at][fresh] * (m + 1) + key[fresh]
        new_rank = rank.astype(np.int64) * (m + 1)
        new_rank[order[at]] = combined
        rank = new_rank
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols 0..256 in which 0 ends every piece; the zeros count as different, smaller to the left."""
    t = np.asarray(t, np.uint16)
    n = len(t)
    small = _classified(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    is_lms |= t == 0
    lms = np.flatnonzero(is_lms).astype(np.int32)
    counts = np.bincount(t, minlength=257)
    rough = _induced(t, small, lms[np.argsort(t[lms], kind="stable")], counts)
    rough = rough[is_lms[rough]]
    # names: equal for equal LMS substrings (up to and with the next LMS symbol), unique for zeros
    following = np.append(lms[1:], n - 1)
    ends = np.empty(n, np.int32)
    ends[lms] = np.minimum(following + 1, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(t.astype(np.uint64) + np.uint64(77)) * powers(_BASE_INV, n), out=sums[1:])
    digest = _span(sums, rough, ends[rough])
    new = np.append(True, digest[1:] != digest[:-1]) | (t[rough] == 0)
    place = np.empty(n, np.int32)
    place[rough] = np.cumsum(new) - 1
    names = place[lms]
    order = rough if new.all() else lms[_ranked(names)]
    return _induced(t, small, order, counts)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): common prefix of each suffix with its predecessor phi in the suffix array, not beyond the pieces' ends.

    Where the symbols before two neighbours agree, the value is one less than the position before; only the others are compared.
    """
    n = len(t)
    phi = np.empty(n, np.int32)
    phi[sa[1:]], phi[sa[0]] = sa[:-1], -1
    at = np.arange(n)
    chained = np.zeros(n, bool)
    ok = phi[1:] > 0
    chained[1:][ok] = (t[:-1][ok] == t[phi[1:][ok] - 1]) & (t[:-1][ok] != 0)
    # a chain only holds where the position before has that very predecessor
    chained[1:] &= phi[:-1] == phi[1:] - 1
    at = np.flatnonzero(~chained & (phi >= 0))
    padded = np.append(t, np.zeros(8, t.dtype)).astype(np.uint64)
    eight = padded[:n].copy()
    for k in range(1, 7):
        eight = (eight << np.uint64(9)) | padded[k : n + k]
    value = np.zeros(n, np.int64)
    most = np.minimum(rest[at], rest[phi[at]])
    live, done = np.arange(len(at)), np.zeros(len(at), np.int64)
    while len(live):
        i, j = at[live] + done[live], phi[at[live]] + done[live]
        more = done[live] < most[live]
        i, j, live = i[more], j[more], live[more]
        differ = eight[i] ^ eight[j]
        same = differ == 0
        done[live[same]] += 7
        odd = ~same
        # leading equal symbols of nine bits each
        bits = 62 - np.floor(np.log2(differ[odd].astype(np.float64) + 0.5)).astype(np.int64)
        done[live[odd]] += np.clip(bits, 0, 62) // 9
        live = live[same]
    value[at] = np.minimum(done, most)
    known = np.maximum.accumulate(np.where(chained, 0, np.arange(n)))
    return np.maximum(value[known] - (np.arange(n) - known), 0), phi


def repeated_starts(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, where LENGTH bytes begin that occur at another place of the texts too."""
    sizes = np.array([len(x) + 1 for x in texts])
    firsts = np.cumsum(sizes) - sizes
    t = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    t[firsts + sizes - 1] = 0
    sa = suffix_array(t)
    rest = np.repeat(firsts + sizes - 1, sizes) - np.arange(len(t))
    plcp, phi = permuted_prefixes(t, sa, rest)
    hit = plcp >= LENGTH
    twice = hit.copy()
    twice[phi[hit]] = True
    at = np.flatnonzero(twice)
    cut = np.searchsorted(at, np.append(firsts, len(t)))
    return [at[x:y] - f for x, y, f in zip(cut, cut[1:], firsts.tolist())]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> covered byte ranges (id, tag, start, stop)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def sort(rows: pa.RecordBatch):
        key = rows.column(0).to_numpy()
        kind = rows.column(4).to_numpy()
        top = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(top, len(key)))
        keep = np.repeat((n > 1) & (np.minimum.reduceat(kind, top) == 0), n)
        if not keep.any():
            return
        rows = rows.filter(pa.array(keep))
        kind, first = rows.column(4).to_numpy(), rows.column(3).to_numpy()
        at, start, stop = [], [], []
        for i, s in enumerate(repeated_starts(rows.column(5).to_pylist())):
            if len(s) and kind[i] == 0:
                x = np.flatnonzero(np.append(True, s[1:] - s[:-1] > 1))
                y = np.append(x[1:], len(s)) - 1
                at.append(np.full(len(x), i))
                start.append(s[x] + first[i])
                stop.append(s[y] + first[i] + LENGTH)
        if at:
            take = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([rows.column(1).take(take), rows.column(2).take(take), pa.array(np.concatenate(start)), pa.array(np.concatenate(stop))], names=["id", "tag", "start", "stop"])

    for batch in _with_end(batches):
        if batch is not None:
            held.append(batch)
            size += batch.column(5).nbytes
            if size < SHARD_BYTES:
                continue
        if not held:
            continue
        rows = pa.concat_batches(held)
        key = rows.column(0).to_numpy()
        lengths = np.diff(np.frombuffer(rows.column(5).buffers()[1], np.int32)[rows.column(5).offset :][: len(key) + 1])
        last = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
        at = 0
        while at < last:
            to = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:last]), SHARD_BYTES)))
            to = last if to >= last else int(np.searchsorted(key, key[to - 1], "right"))
            to = min(to, last)
            yield from sort(rows.slice(at, to - at))
            at = to
        held = [rows.slice(last)] if last < len(key) else []
        size = 0  # an open group grows by a whole shard before it is looked at again


def _merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    top = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return list(zip(start[top].tolist(), reach[np.append(top[1:], len(start)) - 1].tolist()))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = batch.column(1).cast(pa.binary())
        n_bytes, n_removed, n_spans, sha = [], [], [], []
        for raw, spans in zip(raws, batch.column(2)):
            raw = raw.as_py() or b""
            merged = _merged(spans.values.field("start").to_numpy(), spans.values.field("stop").to_numpy()) if spans.is_valid else []
            digest, at = hashlib.sha256(), 0
            for a, b in merged:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(sum(b - a for a, b in merged))
            n_spans.append(len(merged))
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _split_groups(parts: DataFrame, schema: str, largest: int) -> tuple[DataFrame, DataFrame | None]:
    """(parts in groups of at most ``largest`` bytes, spans found on the way).

    In every round the parts of larger groups are cut into ranges of windows; ranges that are equal as a whole are
    repeated, and one of them goes on to be compared with.  After the last round a range is one window, and windows
    that differ have keys that differ.
    """
    small, spans = None, None
    for width in (11, 2, 1):
        sizes = parts.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size"))
        large = checkpointed(sizes.where(F.col("size") > largest).select("key"))
        if large.isEmpty():
            break
        rest = parts.join(large, "key", "left_anti")
        small = rest if small is None else small.unionByName(rest)
        cut = parts.join(large, "key").select(*parts.columns).mapInArrow(_ranges(width), schema)
        cut = checkpointed(cut.withColumn("same", F.xxhash64("bytes")))
        equal = cut.groupBy("key", "same").agg(F.count("*").alias("n")).where("n > 1").select("key", "same")
        told = cut.where("kind = 0").join(equal, ["key", "same"]).select("id", "tag", F.col("first").alias("start"), (F.col("first") + F.octet_length("bytes")).alias("stop"))
        spans = told if spans is None else spans.unionByName(told)
        one = cut.join(equal, ["key", "same"]).groupBy("key", "same").agg(F.any_value(F.struct("id", "tag", "first", "bytes", "far")).alias("r"))
        one = one.select("key", "r.id", "r.tag", "r.first", F.lit(2).cast("byte").alias("kind"), "r.bytes", "r.far")
        parts = checkpointed(cut.join(equal, ["key", "same"], "left_anti").select(*parts.columns).unionByName(one))
    else:
        return small, spans  # what is left are single windows that occur once, and those told already
    return (parts if small is None else small.unionByName(parts)), spans


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tag, start, stop): byte ranges, possibly overlapping, that repeated strings cover; tag tells rows of one id apart."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col)
    pieces = rows.mapInArrow(_pieces, f"h long, ph long, id {id_type}, tag long, pos long, spread long")
    again = checkpointed(pieces.repartition(F.coalesce("spread", "h")).sortWithinPartitions("h", "ph").mapInArrow(_repeats, f"h long, id {id_type}, tag long, pos long, kind byte"))
    first = F.shiftrightunsigned("pos", 32)
    whole = again.where("kind = 1").select("id", "tag", first.alias("start"), (first + F.shiftright("pos", 24).bitwiseAND(255) + LENGTH).alias("stop"))
    schema = f"key long, id {id_type}, tag long, first long, kind byte, bytes binary, far int"
    several = again.where("kind <> 1")
    # no key has more bytes than its anchor; there are fewer large anchors than shards
    windows = F.shiftright("pos", 24).bitwiseAND(255) + 1
    large = checkpointed(several.groupBy("h").agg(F.sum(windows + LENGTH - 1).alias("size")).where(F.col("size") > SHARD_BYTES).select("h"))
    hashes = [r.h for r in large.collect()]
    if hashes:
        several = several.join(F.broadcast(large), "h", "left_anti")
    wanted = several.groupBy("id", "tag").agg(F.collect_list(F.struct("h", "pos", "kind")).alias("pieces"))
    texts = rows.alias("d").join(wanted.alias("w"), F.expr("d.id <=> w.id and d.tag = w.tag")).select(F.col("d.id").alias("id"), F.col("d.tag").alias("tag"), F.col("d.text").alias("text"), "pieces", F.lit(0).cast("long").alias("at"))
    parts, spans = texts.mapInArrow(_cut_texts, schema), None
    if hashes:
        one = rows.mapInArrow(_pieces_of(np.array(sorted(hashes), np.int64)), f"h long, ph long, id {id_type}, tag long, pos long, bytes binary")
        one = one.groupBy("h", "ph").agg(F.count("*").alias("n"), F.any_value(F.struct("id", "tag", "pos", "bytes")).alias("r"))
        piece = F.struct("h", F.col("r.pos").alias("pos"), F.when(F.col("n") > 1, 2).otherwise(0).cast("byte").alias("kind"))
        one = one.select("r.id", "r.tag", F.col("r.bytes").alias("text"), F.array(piece).alias("pieces"), F.shiftrightunsigned("r.pos", 32).alias("at"))
        split, spans = _split_groups(checkpointed(one.mapInArrow(_cut_texts, schema)), schema, SHARD_BYTES)
        parts = parts.unionByName(split)
    found = parts.drop("far").repartition("key").sortWithinPartitions("key").mapInArrow(_shards, f"id {id_type}, tag long, start long, stop long")
    found = found if spans is None else found.unionByName(spans)
    return whole.unionByName(found)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return text_rows(docs, docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    id_type = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, id_col, text_col).groupBy("id", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    both = _rows(docs, id_col, text_col).alias("d").join(spans.alias("s"), F.expr("d.id <=> s.id and d.tag = s.tag"), "left")
    out = both.select(F.col("d.id").alias("id"), F.col("d.text").alias("text"), "spans").mapInArrow(_kept, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
