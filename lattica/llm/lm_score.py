"""Language-model scoring with Elias-Fano n-gram tries of order three.

Training tokens give counts of words, pairs and triples; a token w after u v has probability
    p(w | u v) = c(u v w) / (c(u v) + MU3)  +  MU3 / (c(u v) + MU3) * p(w | v),
    p(w | v)   = c(v w) / (c(v) + MU)       +  MU / (c(v) + MU) * p(w),
    p(w)       = (c(w) + 0.1) / (N + 0.1 (V + 1)),
so every context's distribution sums to that of the words at most, and unseen words keep a share.  A document
begins behind an end of text, and this behind a start that nothing else follows.

How it runs.  Documents are packed into chunks of word numbers; the chunks' words are counted in shards by word,
which also number them (frequent words get small numbers); counts and numbers return to the chunks, which then deal
their distinct triples, each with its training count in the chunk, to shards by first word (first words that hold a
large share of the tokens are split further by the second).  Each shard adds up the counts, builds a trie of them and
returns its quantised share for each pair and triple of a chunk; the chunks turn these into probabilities and sum them
over their documents.  Only binary blobs are shuffled, nothing passes through the driver but N and V.  Word shards and
trie shards grow in number with the tokens, so that neither outgrows a task; one triple, however common, takes one
entry in its shard for each chunk.  A chunk sends no more blobs than it has different words.

A trie's levels are flat buffers: first words, their pointers into the second words, those words (as numbers within
the trie's vocabulary, made monotone by their context's number), pointers into the third words and these, all
Elias-Fano coded; probabilities are quantised to 16 bits.  It is mapped from memory or from a file without decoding,
and each level is searched for the successor within the range of its context.  ``tries`` gives them as a table to
store; the scores use them where they are built.

Defined cases: a null text counts as empty: one token, the end; a null doc_id is
learnt from; rows with equal doc_id are scored separately; without training
rows all probabilities of the base are (0.1) / (0.1); an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, byte_chunks, checkpointed, crc_mod, mix, span_hashes, text_rows, word_spans

MU = 30.0
MU3 = 8.0
CHUNK_TOKENS = 3 << 19
SHARD_TOKENS = 3 << 19
#: Tokens for each shard of words: a chunk sends a shard only its different words in the shard's range.
WORD_SHARD_TOKENS = 8 << 20
END = np.uint64(0x2545F4914F6CDD1D)
#: Numbers that no word has: what stands behind a document's end, and before the end of text that it begins behind.
AFTER, START = 1 << 40, (1 << 40) + 1
_STEPS = 65535
_LOWEST = -16.0
_CODEC = pa.Codec("zstd", compression_level=6)


# --- Elias-Fano ----------------------------------------------------------------------------------


def _select(words: np.ndarray, cum: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Bit positions of the i-th set bits; ``cum`` are the set bits up to and with each word."""
    w = np.searchsorted(cum, i, "right")
    r = i - np.where(w > 0, cum[np.maximum(w - 1, 0)], 0)
    word, at = words[np.minimum(w, len(words) - 1)].copy(), np.zeros(len(i), np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(word & np.uint64((1 << shift) - 1)).astype(np.int64)
        up = r >= c
        r -= np.where(up, c, 0)
        at += np.where(up, shift, 0)
        word >>= np.where(up, np.uint64(shift), np.uint64(0))
    return w * 64 + at


class EliasFano:
    """A sorted sequence of unsigned integers below ``universe`` in flat buffers."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        self.ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        self.zeros = np.cumsum(64 - np.bitwise_count(high).astype(np.int64))
        self._lows = np.ndarray((max(len(low) - 7, 1),), "<u8", buffer=low, strides=(1,))

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = min(max((int(universe) // max(n, 1)).bit_length() - 1, 0), 56)
        values = values.astype(np.uint64)
        low = values & np.uint64((1 << width) - 1)
        bits = np.zeros((n, width), np.uint8)
        for k in range(width):
            bits[:, k] = (low >> np.uint64(k)) & np.uint64(1)
        packed = np.packbits(bits.ravel(), bitorder="little")
        packed = np.append(packed, np.zeros(16, np.uint8))
        high = (values >> np.uint64(width)).astype(np.int64)
        size = n + ((int(universe) - 1) >> width) + 2 if universe else n + 2
        # only the used part of the universe is written
        size = min(size, n + (int(high[-1]) if n else 0) + 2)
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[high + np.arange(n)] = 1
        return cls(n, width, packed, np.packbits(flags, bitorder="little").view("<u8"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i * self.width
        return (self._lows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.high, self.ones, i) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element >= each value (n if there is none)."""
        return self.seek(values)[0]

    def seek(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= each value (n if there is none), and whether it is equal to it."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        low = values & np.uint64((1 << self.width) - 1)
        flipped, last = ~self.high, int(self.zeros[-1]) if len(self.zeros) else 0
        known = high < last
        h = np.where(known, high, 0)
        start = np.where(h > 0, _select(flipped, self.zeros, np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)
        stop = _select(flipped, self.zeros, h) - h
        lo, hi = np.where(known, start, self.n), np.where(known, stop, self.n)
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        end = hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        equal = lo < end  # the elements before ``end`` have the value's high bits
        equal[equal] = self._low(lo[equal]) == low[equal]
        return lo, equal

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        i, equal = self.seek(values)
        return np.where(equal, i, -1)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width, len(self.low), len(self.high)], "<i8").view(np.uint8), np.append(self.low, np.zeros(-len(self.low) % 8, np.uint8)), self.high.view(np.uint8)]

    @classmethod
    def mapped(cls, buf: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, width, n_low, n_high = buf[at : at + 32].view("<i8").tolist()
        a = at + 32
        b = a + n_low + -n_low % 8
        return cls(n, width, buf[a : a + n_low], buf[b : b + 8 * n_high].view("<u8")), b + 8 * n_high


class Trie:
    """The triples of one shard over a flat byte buffer (an array, or np.memmap of a file)."""

    def __init__(self, buf: np.ndarray):
        at = 0
        for level in ("contexts", "vocabulary", "second_of", "second", "third_of", "third"):
            value, at = EliasFano.mapped(buf, at)
            setattr(self, level, value)
        self.second_codes = buf[at : at + 2 * self.second.n].view("<u2")
        at += -(-2 * self.second.n // 8) * 8
        self.third_codes = buf[at : at + 2 * self.third.n].view("<u2")

    @staticmethod
    def build(contexts: np.ndarray, vocabulary: np.ndarray, context: np.ndarray, second: np.ndarray, second_log: np.ndarray, pair: np.ndarray, third: np.ndarray, third_log: np.ndarray) -> np.ndarray:
        """The buffer for ``contexts`` and ``vocabulary`` (ascending word numbers), pairs (number of the context, place in the
        vocabulary) and triples (number of the pair, place in the vocabulary), both ascending, with their log10 shares."""
        width = max(len(vocabulary), 1)
        levels = [
            EliasFano.encode(contexts, int(contexts[-1]) + 1 if len(contexts) else 1), EliasFano.encode(vocabulary, int(vocabulary[-1]) + 1 if len(vocabulary) else 1),
            EliasFano.encode(np.searchsorted(context, np.arange(len(contexts) + 1)), len(context) + 1), EliasFano.encode(context.astype(np.uint64) * np.uint64(width) + second.astype(np.uint64), max(len(contexts) * width, 1)),
            EliasFano.encode(np.searchsorted(pair, np.arange(len(context) + 1)), len(pair) + 1), EliasFano.encode(pair.astype(np.uint64) * np.uint64(width) + third.astype(np.uint64), max(len(context) * width, 1)),
        ]
        codes = quantised(second_log).view(np.uint8)
        return np.concatenate([p for level in levels for p in level.parts()] + [codes, np.zeros(-len(codes) % 8, np.uint8), quantised(third_log).view(np.uint8)])

    def _within(self, level: EliasFano, pointers: EliasFano, number: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index in a level of each word within the range of its context's number; -1 where either is unknown."""
        out = np.full(len(number), -1)
        some = np.flatnonzero((number >= 0) & (word >= 0))
        if len(some) and level.n:
            k, w = number[some], word[some]
            tops = _tops(k)
            times = np.diff(np.append(tops, len(k)))
            first, last = (np.repeat(pointers.access(k[tops] + j).astype(np.int64), times) for j in (0, 1))
            at, equal = level.seek(k.astype(np.uint64) * np.uint64(self.vocabulary.n) + w.astype(np.uint64))
            inside = equal & (at >= first) & (at < last)
            out[some[inside]] = at[inside]
        return out

    def pairs(self, context: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of each pair of word numbers, or -1."""
        return self._within(self.second, self.second_of, self.contexts.find(context), self.vocabulary.find(second))

    def shares(self, pair: np.ndarray, third: np.ndarray | None = None) -> np.ndarray:
        """Quantised log10 shares of pairs by index, or of the triples that end in ``third``; the lowest for unknown ones."""
        return self._codes(pair, None if third is None else self.vocabulary.find(third))

    def all_shares(self, contexts: np.ndarray, vocabulary: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of pairs (place in ``contexts`` << 32 | place in ``vocabulary``) and of triples (place in ``pairs`` << 32 |
        place in ``vocabulary``); each context and word is looked up once."""
        context, word = self.contexts.find(contexts), self.vocabulary.find(vocabulary)
        at = self._within(self.second, self.second_of, context[pairs >> 32], word[pairs & 0xFFFFFFFF])
        return self._codes(at, None), self._codes(at[triples >> 32], word[triples & 0xFFFFFFFF])

    def _codes(self, pair: np.ndarray, third: np.ndarray | None) -> np.ndarray:
        at = pair if third is None else self._within(self.third, self.third_of, pair, third)
        codes = self.second_codes if third is None else self.third_codes
        return np.where(at >= 0, codes[np.maximum(at, 0)] if len(codes) else _STEPS, _STEPS).astype("<u2")

    @classmethod
    def open(cls, path: str) -> Trie:
        return cls(np.memmap(path, np.uint8, "r"))


def quantised(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logs / _LOWEST * _STEPS), 0, _STEPS).astype("<u2")


def restored(codes: np.ndarray) -> np.ndarray:
    return codes * (_LOWEST / _STEPS)


# --- blobs ---------------------------------------------------------------------------------------


def _pack(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, its bytes grouped by significance; with its length in front."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def _unpack(blob: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    raw = np.frombuffer(_CODEC.decompress(blob[8:], size, asbytes=True), np.uint8)
    item = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(item, -1).T).view(dtype).ravel()


def _steps_of(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending hashes, which take fewer bytes."""
    return np.diff(ascending, prepend=np.uint64(0))


def _pack_tokens(numbers: np.ndarray, n_words: int) -> bytes:
    """A stream of word numbers as the words' ranks by frequency, which take fewer bytes, behind the frequencies."""
    uses = np.bincount(numbers, minlength=n_words)
    rank = np.empty(n_words, "<u4")
    rank[np.argsort(-uses, kind="stable")] = np.arange(n_words)
    return _pack(np.concatenate([uses.astype("<u4"), rank[numbers]]))


def _unpack_tokens(blob: bytes, n_words: int) -> np.ndarray:
    both = _unpack(blob, "<u4").astype(np.int64)
    return np.argsort(-both[:n_words], kind="stable")[both[n_words:]]


def _range_of(h: np.ndarray, n: int) -> np.ndarray:
    """Number of the range of hashes (0..n-1) that each falls in; grows with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


_CHUNK = "chunk long, part int, n_docs int, n_tokens long, sizes binary, train binary, words binary, tokens binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, held) -> chunks: ids, tokens per document, flags, sorted word hashes, word numbers of the token stream."""
    context = TaskContext.get()
    no = (context.partitionId() if context else 0) << 32
    ids, train, hashes, sizes, held = [], [], [], [], 0

    def flush():
        nonlocal no
        stream = np.concatenate(hashes)
        words, numbers = np.unique(stream, return_inverse=True)
        id_list = pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids))
        row = [pa.array([no]), pa.array([-1], pa.int32()), pa.array([len(id_list.values)], pa.int32()), pa.array([len(stream)]), *(pa.array([_pack(x)], pa.binary()) for x in (np.concatenate(sizes).astype("<u4"), np.concatenate(train).astype(np.uint8), words)), pa.array([_pack_tokens(numbers, len(words))], pa.binary()), id_list]
        no += 1
        return pa.RecordBatch.from_arrays(row, names=["chunk", "part", "n_docs", "n_tokens", "sizes", "train", "words", "tokens", "ids"])

    for batch in batches:
        flags = batch.column(2).to_numpy(zero_copy_only=False)
        for a, b, buf, offsets in byte_chunks(batch.column(1)):
            low = LOWER[buf]
            starts, ends, firsts = word_spans(low, offsets)
            n = np.diff(firsts)
            stream = np.insert(span_hashes(low, starts, ends), firsts[1:], END)
            ids.append(batch.column(0).slice(a, b - a))
            train.append(~flags[a:b])
            hashes.append(stream)
            sizes.append(n + 1)
            held += len(stream)
            if held >= CHUNK_TOKENS:
                yield flush()
                ids, train, hashes, sizes, held = [], [], [], [], 0
    if held:
        yield flush()


def _word_parts(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, _, _, _, sizes, train, words, tokens = (batch.column(i)[row].as_py() for i in range(8))
                words = _unpack(words, "<u8")
                tokens = _unpack_tokens(tokens, len(words))
                learnt = np.repeat(_unpack(train, "u1"), _unpack(sizes, "<u4"))
                counts = np.bincount(tokens, weights=learnt, minlength=len(words)).astype("<u4")
                cut = np.searchsorted(_range_of(words, shards), np.arange(shards + 1))
                parts = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(np.full(len(parts), chunk)), pa.array([_pack(_steps_of(words[cut[p] : cut[p + 1]])) for p in parts], pa.binary()), pa.array([_pack(counts[cut[p] : cut[p + 1]]) for p in parts], pa.binary())], names=["part", "chunk", "words", "counts"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[dict]]:
    """Rows of each run of equal keys, of batches sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = row[batch.schema.names[key]]
            if rows and k != now:
                yield rows
                rows = []
            now = k
            rows.append(row)
    if rows:
        yield rows


def _count_words(shards: int):
    """Parts of one range of words, from all chunks -> the total counts and numbers of each part's words, and the range's N and V."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 0):
            words = [np.cumsum(_unpack(r["words"], "<u8"), dtype=np.uint64) for r in rows]
            every, at = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([_unpack(r["counts"], "<u4") for r in rows]), minlength=len(every)).astype("<u8")
            number = np.empty(len(every), "<u8")
            number[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(every), dtype="<u8") * np.uint64(shards) + np.uint64(rows[0]["part"])
            ends = np.cumsum([0, *map(len, words)])
            n = len(rows)
            first = np.arange(n) == 0
            each = [at[x:y] for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int32()), pa.array([_pack(total[x]) for x in each], pa.binary()), pa.array([_pack(number[x] // np.uint64(shards)) for x in each], pa.binary()), pa.array(np.where(first, int(total.sum()), 0)), pa.array(np.where(first, int((total > 0).sum()), 0))], names=["chunk", "part", "counts", "numbers", "n", "v"])

    return run


class _Grams:
    """A chunk's words by ascending number (AFTER and START behind them), and its distinct pairs and triples in ascending order."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, end: int, train: np.ndarray):
        """``numbers`` are the words' numbers, ``tokens`` places among them, ``end`` the place of the end of text."""
        order = np.argsort(numbers)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = len(order)
        self.order, self.numbers = order, np.append(numbers[order], np.array([AFTER, START], np.uint64))
        self.tokens = tokens = place[tokens]
        self.end = end = int(place[end])
        firsts = np.cumsum(sizes) - sizes
        one = np.empty_like(tokens)
        one[1:] = tokens[:-1]
        one[firsts] = end
        two = np.empty_like(tokens)
        two[1:] = one[:-1]
        two[firsts] = m + 1
        # a triple behind each document's end stands for its last pair; its third word is AFTER
        last = firsts + sizes - 1
        pair, at = np.unique(np.concatenate([two << 32 | one, one[last] << 32 | end]), return_inverse=True)
        third = np.concatenate([tokens, np.full(len(last), m)])
        triple, self.at = np.unique(at << 32 | third, return_inverse=True)
        self.pair, self.of, self.third = pair, triple >> 32, triple & 0xFFFFFFFF
        self.learnt = np.bincount(self.at, weights=np.concatenate([np.repeat(train, sizes), train]), minlength=len(triple)).astype("<u4")
        self.at = self.at[: len(tokens)]

    def counts(self, counts: np.ndarray) -> np.ndarray:
        """The words' counts (in their order) as those of contexts; START comes once for each document, as an end does."""
        return np.append(counts, [0, counts[self.end]])

    def shard(self, counts: np.ndarray, shards: int, n: int) -> np.ndarray:
        """The shard of each pair; first words with a large share of all tokens are split by the second."""
        split = np.maximum(counts * (4 * shards) // max(n, 1), 1)
        one, two = self.pair >> 32, self.pair & 0xFFFFFFFF
        part = np.where(split[one] > 1, mix(self.numbers[two] + np.uint64(7)) % split[one].astype(np.uint64), np.uint64(0))
        return _range_of(mix(mix(self.numbers[one] + np.uint64(3)) + part * np.uint64(0x9E3779B97F4A7C15)), shards)


def _chunk_of(rows: list[dict], shards: int):
    """(sizes, train, tokens, words' counts, grams) of a chunk and its words' counts and numbers; counts as the words are in grams."""
    head = rows[0]
    words = _unpack(head["words"], "<u8")
    sizes, train = _unpack(head["sizes"], "<u4").astype(np.int64), _unpack(head["train"], "u1")
    counts = np.concatenate([_unpack(r["counts"], "<u8") for r in rows[1:]])
    numbers = np.concatenate([_unpack(r["numbers"], "<u8") * np.uint64(shards) + np.uint64(r["part"]) for r in rows[1:]])
    grams = _Grams(_unpack_tokens(head["tokens"], len(words)), sizes, numbers, int(np.searchsorted(words, END)), train)
    return sizes, train, grams.counts(counts[grams.order].astype(np.int64)), grams


def _by_shard(shard: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(int(s), order[cut[s] : cut[s + 1]]) for s in np.flatnonzero(np.diff(cut))]


def _spread(first: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """All indices first[i] .. first[i] + uses[i] - 1, one range after another."""
    return np.repeat(first - (np.cumsum(uses) - uses), uses) + np.arange(int(uses.sum()))


def _tops(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _relative(values: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Ascending values of each run as differences; the first of a run as it is."""
    out = np.diff(values, prepend=values[:1])
    out[tops] = values[tops]
    return out


def _absolute(steps: np.ndarray, tops: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps)
    return total - np.repeat(total[tops] - steps[tops], np.diff(np.append(tops, len(steps))))


def _deal(word_shards: int, shards: int, n: int, v: int):
    """Chunks with their words' counts and numbers -> blobs of triples for the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 0):
            chunk = rows[0]["chunk"]
            _, _, counts, grams = _chunk_of(rows, word_shards)
            numbers = grams.numbers.astype(np.int64)
            first = np.searchsorted(grams.of, np.arange(len(grams.pair) + 1))
            uses = np.diff(first)
            for s, own in _by_shard(grams.shard(counts, shards, n), shards):
                one, two = grams.pair[own] >> 32, grams.pair[own] & 0xFFFFFFFF
                tops = _tops(one)
                below = uses[own]
                entry = _spread(first[own], below)
                heads = np.column_stack([np.diff(numbers[one[tops]], prepend=0), counts[one[tops]], np.diff(np.append(tops, len(one)))]).T.ravel()
                seconds = np.concatenate([_relative(numbers[two], tops), below])
                thirds = _relative(numbers[grams.third[entry]], np.cumsum(below) - below)
                blobs = [_pack(x.astype("<u8")) for x in (heads, seconds, thirds)] + [_pack(grams.learnt[entry])]
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([chunk]), *(pa.array([b], pa.binary()) for b in blobs)], names=_DEALT)

    return run


#: Columns of what is dealt.
_DEALT = ["shard", "chunk", "firsts", "seconds", "thirds", "learnt"]


class _Shard:
    """The blobs of one shard put together: its trie, and the pairs and triples that each chunk asks for."""

    def __init__(self, rows: list[dict]):
        heads = [_unpack(r["firsts"], "<u8").reshape(3, -1).astype(np.int64) for r in rows]
        seconds = [_unpack(r["seconds"], "<u8").reshape(2, -1).astype(np.int64) for r in rows]
        thirds = [_unpack(r["thirds"], "<u8").astype(np.int64) for r in rows]
        one = np.concatenate([np.repeat(np.cumsum(h[0]), h[2]) for h in heads])
        two = np.concatenate([_absolute(x[0], np.cumsum(h[2]) - h[2]) for h, x in zip(heads, seconds)])
        three = np.concatenate([_absolute(t, np.cumsum(x[1]) - x[1]) for x, t in zip(seconds, thirds)])
        below = np.concatenate([x[1] for x in seconds])
        self.pair_ends = np.cumsum([0, *(x.shape[1] for x in seconds)])
        self.triple_ends = np.cumsum([0, *map(len, thirds)])
        contexts, c = np.unique(one, return_inverse=True)
        context_count = np.zeros(len(contexts), np.int64)
        context_count[np.searchsorted(contexts, np.concatenate([np.cumsum(h[0]) for h in heads]))] = np.concatenate([h[1] for h in heads])
        vocabulary, word = np.unique(np.concatenate([two, three]), return_inverse=True)
        pairs, self.pair_at = np.unique(c << 32 | word[: len(two)], return_inverse=True)
        triples, self.triple_at = np.unique(np.repeat(self.pair_at, below) << 32 | word[len(two) :], return_inverse=True)
        count = np.bincount(self.triple_at, weights=np.concatenate([_unpack(r["learnt"], "<u4") for r in rows]), minlength=len(triples))
        of = triples >> 32
        pair_count = np.bincount(of, weights=count, minlength=len(pairs))
        seen, kept = np.flatnonzero(pair_count > 0), np.flatnonzero(count > 0)
        used = np.unique(pairs[seen] >> 32)
        log2 = np.log10(pair_count[seen] / (context_count[pairs[seen] >> 32] + MU))
        log3 = np.log10(count[kept] / (pair_count[of[kept]] + MU3))
        self.trie = Trie.build(contexts[used], vocabulary, np.searchsorted(used, pairs[seen] >> 32), pairs[seen] & 0xFFFFFFFF, log2, np.searchsorted(seen, of[kept]), triples[kept] & 0xFFFFFFFF, log3)
        self.asked = contexts, vocabulary, pairs, triples

    def answers(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk the codes of its pairs and of its triples, looked up in the trie."""
        two, three = Trie(self.trie).all_shares(*self.asked)
        for a, b, x, y in zip(self.pair_ends, self.pair_ends[1:], self.triple_ends, self.triple_ends[1:]):
            yield two[self.pair_at[a:b]], three[self.triple_at[x:y]]


def _score_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All triples of one shard -> for each chunk the shares of its pairs and triples."""
    for rows in _grouped(batches, 0):
        blobs = [[_pack(x), _pack(y)] for x, y in _Shard(rows).answers()]
        yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([rows[0]["shard"]] * len(rows), pa.int64()), *(pa.array([b[k] for b in blobs], pa.binary()) for k in range(2))], names=["chunk", "shard", "pairs", "triples"])


def _shard_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, 0):
        yield pa.RecordBatch.from_arrays([pa.array([rows[0]["shard"]]), pa.array([_Shard(rows).trie.tobytes()], pa.binary())], names=["shard", "trie"])


def _documents(word_shards: int, shards: int, n: int, v: int, id_type: pa.DataType):
    """A chunk with its words' counts and numbers, and the shares of its pairs and triples -> its documents."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        own = sorted(chunk.to_pylist(), key=lambda r: r["part"])
        sizes, train, counts, grams = _chunk_of(own, word_shards)
        docs, m, starts = len(sizes), len(grams.order), np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))[grams.tokens], starts)
        known = np.add.reduceat((counts[grams.tokens] > 0).astype(np.int64), starts)
        first = np.searchsorted(grams.of, np.arange(len(grams.pair) + 1))
        two, three = np.empty(len(grams.pair), "<u2"), np.empty(len(grams.of), "<u2")
        for (_, at), r in zip(_by_shard(grams.shard(counts, shards, n), shards), sorted(answers.to_pylist(), key=lambda r: r["shard"])):
            two[at] = _unpack(r["pairs"], "<u2")
            three[_spread(first[at], np.diff(first)[at])] = _unpack(r["triples"], "<u2")
        p_word = (counts + 0.1) / (n + 0.1 * (v + 1))
        one, word = grams.pair >> 32, grams.pair & 0xFFFFFFFF
        share = np.where(two < _STEPS, 10.0 ** restored(two), 0)
        p_pair = share + MU / (counts[one] + MU) * p_word[word]
        pair_count = share * (counts[one] + MU)
        real = np.flatnonzero(grams.third < m)
        of, third = grams.of[real], grams.third[real]
        backed = p_pair[np.searchsorted(grams.pair, word[of] << 32 | third)]
        logs = np.zeros(len(grams.of))
        logs[real] = np.log10(np.where(three[real] < _STEPS, 10.0 ** restored(three[real]), 0) + MU3 / (pair_count[of] + MU3) * backed)
        score = np.bincount(np.repeat(np.arange(docs), sizes), weights=logs[grams.at], minlength=docs)
        return pa.Table.from_arrays([pa.array(own[0]["ids"], id_type), pa.array(train == 0), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(np.full(docs, n)), pa.array(base), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, int, int, int, str]:
    """(chunks with their words, dealt triples, shards of words and of triples, N, V, type of the ids as carried)."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    carried = "string" if id_type == "string" else "bigint"
    held = F.coalesce(crc_mod(docs[id_col], 10) == 0, F.lit(False))
    rows = text_rows(docs, docs[id_col].cast(carried).alias("id"), docs[text_col].alias("text"), held.alias("held"))
    chunks = checkpointed(rows.mapInArrow(_chunks, f"{_CHUNK}, ids array<{carried}>"))
    tokens = chunks.agg(F.coalesce(F.sum("n_tokens") + F.sum("n_docs"), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words, shards = max(least, -(-tokens // WORD_SHARD_TOKENS)), max(least, -(-tokens // SHARD_TOKENS))
    parts = chunks.mapInArrow(_word_parts(words), "part int, chunk long, words binary, counts binary")
    counted = checkpointed(parts.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(_count_words(words), "chunk long, part int, counts binary, numbers binary, n long, v long"))
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    # dealt by chunk once: the shuffle is read for the triples and again for the documents
    both = chunks.unionByName(counted.drop("n", "v"), allowMissingColumns=True).repartition("chunk")
    dealt = both.sortWithinPartitions("chunk", "part").mapInArrow(_deal(words, shards, n, v), "shard long, chunk long, firsts binary, seconds binary, thirds binary, learnt binary")
    return both, dealt.repartition("shard").sortWithinPartitions("shard", "chunk"), words, shards, n, v, carried


def tries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, trie): the tries of the training rows as buffers, to be stored and mapped by ``Trie``."""
    return _dealt(docs, id_col, text_col)[1].mapInArrow(_shard_tries, "shard long, trie binary")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    both, dealt, words, shards, n, v, carried = _dealt(docs, id_col, text_col)
    scored = dealt.mapInArrow(_score_shards, "chunk long, shard long, pairs binary, triples binary")
    arrow_id = pa.string() if carried == "string" else pa.int64()
    out = both.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(_documents(words, shards, n, v, arrow_id), f"id {carried}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("id").cast(id_type).alias(id_col), *out.columns[1:])
