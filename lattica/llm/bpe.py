"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the GPT-2 style pattern (vectorised over code
points); each distinct piece is merged by a priority queue of merge ranks over a
doubly linked symbol list, where entries made stale by an earlier merge are
skipped; decoding concatenates the vocabulary's byte strings.

Defined cases: a null text counts as empty (no ids, empty decoded text); the
text of a special token inside a document becomes that token, as in the
tokenizers library; repeated rows give equal results; an empty table gives an
empty result; texts are never cut; a text of one very long piece takes
O(n log n).  The tokenizer file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import as_strings, text_rows

#: Distinct pieces whose ids a worker keeps; beyond it the memory starts anew.
CACHE_PIECES = 150_000

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_CONTRACTIONS = {"s": 1, "t": 1, "m": 1, "d": 1, "re": 2, "ve": 2, "ll": 2}


def default_tokenizer() -> str:
    """The public byte-level vocabulary of this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            if a < 0xD800 <= b:
                table[a:0xD800] = kind
                a = 0xE000
            table[a : b + 1] = kind
    return table


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bounds(text: str) -> list[int]:
    """Where the pieces of the pre-tokeniser begin, and the end of the text; the pieces tile it."""
    n = len(text)
    if not n:
        return [0]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    space = kind == _SPACE
    # The last space of a run stands alone before a word, and a blank joins the word after it.
    last = np.flatnonzero(space[:-1] & ~space[1:])
    cut[last] = True
    cut[last[points[last] == 32] + 1] = False
    quotes = np.flatnonzero(points[:-1] == 39)
    if len(quotes):
        alone = quotes[cut[quotes] & cut[quotes + 1] & (kind[quotes + 1] == _LETTER)]
        for q in alone.tolist():
            size = _CONTRACTIONS.get(text[q + 1]) or _CONTRACTIONS.get(text[q + 1 : q + 3])
            if size:
                cut[q + 1] = False
                cut[q + 1 + size] = True
    return np.flatnonzero(cut).tolist()


class BytePairCoder:
    """Vocabulary and merge ranks of one tokenizer file, with a bounded memory of encoded pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(map(alphabet.__getitem__, token))
        ids = spec["model"]["vocab"]
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.vocab: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.vocab[i] = to_bytes(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.vocab[i] = token.encode("utf-8")
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte_id = [0] * 256
        for token, b in alphabet.items():
            self.byte_id[b] = ids[token]
        #: Rank of every mergeable pair, keyed by left * width + right; and the id that each rank makes.
        self.width = size
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[left] * size + ids[right], rank)
            self.made.append(ids[left + right])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece: the lowest-ranked adjacent pair is merged first, the leftmost among equals."""
        ids = list(map(self.byte_id.__getitem__, raw))
        n = len(ids)
        if n < 2:
            return ids
        rank_of, width, made = self.ranks.get, self.width, self.made
        queue = []  # rank * n + position of the pair's left symbol
        for i in range(n - 1):
            rank = rank_of(ids[i] * width + ids[i + 1])
            if rank is not None:
                queue.append(rank * n + i)
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = after[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] * width + ids[j]) != rank:
                continue  # stale: one of its symbols has been merged since
            new = ids[i] = made[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(new * width + ids[k])
                if rank is not None:
                    heappush(queue, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = rank_of(ids[h] * width + new)
                if rank is not None:
                    heappush(queue, rank * n + h)
        return [x for x in ids if x >= 0]

    def _learn(self, piece: str) -> bytes:
        """Encodes a piece that the younger memory lacks; a full memory becomes the older one."""
        ids = self.older.get(piece)
        if ids is None:
            merged = self.merge(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(piece) <= 64:
            if len(self.known) >= CACHE_PIECES:
                self.older, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def _plain(self, text: str, out: list[bytes]) -> None:
        bounds = piece_bounds(text)
        pieces = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        learn = self._learn
        out += [ids if ids is not None else learn(p) for p, ids in zip(pieces, map(self.known.get, pieces))]

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        if self.split and any(special in text for special in self.special):
            for m in self.split.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(struct.pack("<I", self.special[m[0]]))
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def coder(path: str) -> BytePairCoder:
    return BytePairCoder(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 (digests of the packed ids and of the decoded text)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in as_strings(batch.column(1)):
                ids = c.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = text_rows(docs, docs[id_col].alias("id"), docs[text_col].alias("text"))
    return out.mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``ids``, an array of its token ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            packed = [np.frombuffer(c.encode(t.as_py()), "<u4").astype(np.int32) for t in as_strings(batch.column(1))]
            ends = np.cumsum([0, *map(len, packed)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *packed]))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    out = text_rows(docs, docs[id_col].alias("id"), docs[text_col].alias("text"))
    return out.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and ``text``; a null list of ids counts as empty."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        for batch in batches:
            texts = [c.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    out = text_rows(encoded, encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return out.mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)
