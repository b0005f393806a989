"""Secret scans: a decoding worklist over URL, Unicode, base64 and compressed layers.

``scan_text`` searches the text itself (the base), then unwraps every nested
layer it finds until nothing new appears, scans each layer and maps its spans
back to code points of the outermost text.

Defined cases: a null text counts as empty (no spans); repeated rows give results; an empty table gives an empty result; texts are never cut; other
columns of the input are not looked at; a span found twice is listed once.
Bytes that are no text do not hide what stands among them: they are kept as
marks, in layers of every size alike.  Content that unpacks to more than PIECE
bytes without a line that holds a blank is cut at PIECE with an overlap: secrets
are still found, an encoded run longer than the overlap may be lost there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from html.entities import html5
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textkit import as_strings, text_rows

KINDS = ("assign", "access", "hex")
_RULES = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: RE2 forms that every text with a finding or a layer matches; they spare the rest the Python scan.
_GATE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\[uU]\{?[0-9A-Fa-f]|&#[xX]?[0-9A-Fa-f]|&[A-Za-z]|[A-Za-z0-9+/_-]{16}"

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|&([A-Za-z][A-Za-z0-9]{1,31};)")
#: The gate in Python: what it does not match holds neither a secret nor an encoded layer.
_WORTH = re.compile(_GATE.encode())
_WORTH_TEXT = re.compile(_GATE)
#: ASCII in two-byte units, of either order.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){6,}|(?:\x00[\t\n\r\x20-\x7e]){6,}")
#: Escapes that stand for one byte, those of byte literals included.
_BYTE_ESCAPE = re.compile(_ESCAPE.pattern + r"""|\\([nrtabfv0'"\\])""")
_BYTE_OF = dict(zip("nrtabfv0'\"\\", b"\n\r\t\a\b\f\v\0'\"\\"))
_ONE_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of base64 under each other; possessive and from a run's first symbol on, so that the search stays linear.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_SEPARATOR = re.compile(r"[/_+-]")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")
_PLAIN_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9a-f]+|[0-9]+")
#: Before such a line nothing that is sought goes on.
_PLAIN_LINE = re.compile(rb"\n(?=[^\n]* [^\n]*\n)")
#: An unpacked layer is looked at in pieces of about this size, so that no bomb fills the memory.
PIECE = 16 << 20


def find(text: str) -> list[tuple[str, int, int]]:
    """Base rules: leftmost non-overlapping matches of each kind, too short ones dropped."""
    out = []
    for kind, rule, group, least in _RULES:
        for m in rule.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                out.append((kind, *m.span()))
    return out


def _text_of(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray] | None:
    """A byte layer that as a whole is text: UTF-8 (or UTF-16, with a mark or by its zero bytes) that is mostly printable."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") or (len(raw) >= 8 and not len(raw) % 2 and (not any(raw[1:8:2]) or not any(raw[0:8:2]))):
        wide = "utf-16-be" if raw[:2] == b"\xfe\xff" or (raw[:1] <= b"\xf0" and not raw[0]) else "utf-16-le"
        skip = 2 * (raw[:2] in (b"\xff\xfe", b"\xfe\xff"))
        try:
            text = raw[skip : len(raw) - len(raw) % 2].decode(wide)
        except UnicodeDecodeError:
            return None
        units = 1 + (np.frombuffer(text.encode("utf-32-le"), "<u4") > 0xFFFF).astype(np.int64)
        last = skip + 2 * np.cumsum(units)
        return (text, starts[last - 2 * units], ends[last - 1]) if _printable(text) else None
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not _printable(text):
        return None
    first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    last = np.append(first[1:], len(raw)) - 1
    return text, starts[first], ends[last]


def _among(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Layers of bytes that are not text as a whole: whatever stands among them that may hold a secret, ASCII in two-byte
    units and compressed streams."""
    if _WORTH.search(raw):
        yield raw.decode("latin-1"), starts, ends
    if b"\0" in raw:
        for m in _WIDE.finditer(raw):
            text = m[0].replace(b"\0", b"").decode("ascii")
            if _WORTH_TEXT.search(text):
                yield text, starts[m.start() : m.end() : 2], ends[m.start() + 1 : m.end() : 2]
    if _MAGIC.search(raw, 1):
        yield from _streams(raw, starts, ends, at=1)


def _printable(text: str) -> bool:
    return bool(text) and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text)


class _Packed:
    """A compressed byte string, told by its magic number: its content in pieces, all members of it one after another.

    ``used`` are the bytes taken so far and ``whole`` tells whether the last member has ended.  Whatever a cut-off
    or damaged member still gives is its content.
    """

    def __init__(self, raw: bytes | memoryview):
        self.raw, self.used, self.whole = memoryview(raw), 0, False

    @staticmethod
    def _member(head: bytes):
        if head[:3] == b"\x1f\x8b\x08":
            return zlib.decompressobj(31)
        if head[:1] == b"\x78" and len(head) > 1 and (head[0] * 256 + head[1]) % 31 == 0:
            return zlib.decompressobj()
        if head[:3] == b"BZh":
            return bz2.BZ2Decompressor()
        return lzma.LZMADecompressor(lzma.FORMAT_XZ) if head[:6] == b"\xfd7zXZ\x00" else None

    def pieces(self) -> Iterator[bytes]:
        kind = None
        while self.used < len(self.raw):
            head = bytes(self.raw[self.used : self.used + 6])
            member = self._member(head)
            if member is None or (kind is not None and head[:2] != kind):  # what follows is something else
                return
            kind, self.whole = head[:2], False
            data = self.raw[self.used :]
            zip_like = hasattr(member, "unconsumed_tail")
            try:
                while not member.eof:
                    out = member.decompress(data, PIECE)
                    data = member.unconsumed_tail if zip_like else b""
                    if out:
                        yield out
                    if not member.eof and not out and not (zip_like and data):
                        self.used = len(self.raw)  # cut off
                        return
            except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
                return
            self.used, self.whole = len(self.raw) - len(member.unused_data), True


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of compressed bytes that come in pieces, itself in pieces; never more than about one of each is held."""
    data, member, kind = b"", None, None
    for chunk in chunks:
        data += chunk
        while data:
            if member is None:
                member = _Packed._member(data[:6])
                if member is None or (kind is not None and data[:2] != kind):
                    return
                kind = data[:2]
            try:
                zip_like = hasattr(member, "unconsumed_tail")
                while True:
                    out = member.decompress(data, PIECE)
                    data = member.unconsumed_tail if zip_like else b""
                    if out:
                        yield out
                    if member.eof or (not data and len(out) < PIECE if zip_like else member.needs_input):
                        break
            except (OSError, EOFError, zlib.error, lzma.LZMAError, ValueError):
                return
            if not member.eof:
                break
            data, member = member.unused_data, None


def _unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces unpacked for as long as they are compressed themselves; a stream that holds itself ends."""
    heads = set()
    while (first := next(pieces, None)) is not None:
        head = hashlib.sha1(first).digest()
        pieces = chain([first], pieces)
        if not _MAGIC.match(first):
            yield from pieces
        elif head not in heads:
            heads.add(head)
            pieces = _members(pieces)
            continue
        return


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """Bytes that come in pieces as texts, cut where no secret and no encoded run can go on: before a line that holds a
    blank.  Where there is none, each text repeats the end of the one before."""
    rest = b""
    for piece in pieces:
        rest += piece
        if len(rest) < PIECE:
            continue
        cut = max((m.start() + 1 for m in _PLAIN_LINE.finditer(rest, max(len(rest) - (1 << 20), 0))), default=0)
        yield from _decoded_text(rest[:cut] if cut else rest)
        rest = rest[cut or -(PIECE // 16) :]
    if rest:
        yield from _decoded_text(rest)


def _decoded_text(raw: bytes) -> Iterator[str]:
    """Text as UTF-8 or, as all that is sought is ASCII, character by byte; ASCII in two-byte units besides."""
    try:
        yield raw.decode("utf-8")
    except UnicodeDecodeError:
        yield raw.decode("latin-1")
    if b"\0" in raw:
        yield from (m[0].replace(b"\0", b"").decode("ascii") for m in _WIDE.finditer(raw))


def _content(raw: bytes | memoryview, start: int, end_of) -> tuple[list, int] | None:
    """Layers of a compressed byte string, all of whose content maps to the whole packed span, and the bytes it takes.

    Nested streams are unpacked in turn, piece by piece; of equal texts one is kept, and none that cannot hold a secret.
    ``end_of(n)`` is the outer end of the first n bytes.
    """
    packed = _Packed(raw)
    first = next(pieces := packed.pieces(), None)
    if first is None:
        return None
    layers = dict.fromkeys(t for t in _texts(_unpacked(chain([first], pieces))) if _WORTH_TEXT.search(t))
    for _ in pieces:  # where the stream ends, even if its content was left early
        pass
    end = end_of(packed.used)
    return [(t, np.broadcast_to(np.int64(start), len(t)), np.broadcast_to(np.int64(end), len(t))) for t in layers], packed.used


def _streams(raw: bytes, starts: np.ndarray, ends: np.ndarray, plus: bool = False, at: int = 0):
    """A layer for every compressed stream inside a byte string, prose around it or not; ``plus`` also tries + as a space."""
    while m := _MAGIC.search(raw, at):
        a = m.start()
        got = _content(memoryview(raw)[a:], int(starts[a]), lambda n, a=a: int(ends[a + n - 1]))
        if not (got and got[0]) and plus and b"+" in raw[a:]:
            got = _content(raw[a:].replace(b"+", b" "), int(starts[a]), lambda n, a=a: int(ends[a + n - 1]))
        if not (got and got[0]):
            at = a + 1
            continue
        yield from got[0]
        at = a + got[1]


def _as_bytes(text: str, tokens: list[tuple[int, int, int]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text's UTF-8 with each token (start, end, byte) as one byte; the first and last character of each byte."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    last, parts, at = np.arange(len(text)), [], 0
    for a, b, byte in tokens:
        width[a], width[a + 1 : b], last[a] = 1, 0, b - 1
        parts += [text[at:a].encode("utf-8", "surrogatepass"), bytes((byte,))]
        at = b
    parts.append(text[at:].encode("utf-8", "surrogatepass"))
    return b"".join(parts), np.repeat(np.arange(len(text)), width), np.repeat(last, width)


def _packed(text: str, starts: np.ndarray, ends: np.ndarray):
    r"""A layer for every compressed stream whose bytes are percent-encoded or escaped (\xXX and the like)."""
    if "%" in text and _MAGIC.search(unquote_to_bytes(text.encode("utf-8", "surrogatepass"))):
        raw, first, last = _as_bytes(text, [(*m.span(), int(m[1], 16)) for m in _ONE_PERCENT.finditer(text)])
        yield from _streams(raw, starts[first], ends[last], True)
    if _ESCAPE.search(text):
        tokens = []
        for m in _BYTE_ESCAPE.finditer(text):
            if m[7]:
                continue
            byte = _BYTE_OF[m[8]] if m[8] else int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
            if byte < 256:
                tokens.append((*m.span(), byte))
        raw, first, last = _as_bytes(text, tokens)
        if _MAGIC.search(raw):
            yield from _streams(raw, starts[first], ends[last])


def _percent(text: str, starts: np.ndarray, ends: np.ndarray):
    """The text with its percent escapes decoded run by run, those that are not UTF-8 kept as they are; None without any other."""
    parts, s, e, at = [], [], [], 0
    for m in _PERCENT.finditer(text):
        a, b = m.span()
        run = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "surrogateescape")
        own = np.arange(a, b, 3)
        last = own + 2
        if not run.isascii():
            codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4")
            bad = (codes >= 0xDC80) & (codes <= 0xDCFF)
            if bad.all():
                continue
            width = np.where(bad, 1, 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))
            own, last = a + 3 * (np.cumsum(width) - width), a + 3 * np.cumsum(width) - 1
            if bad.any():
                run = "".join(text[i : i + 3] if x else c for c, i, x in zip(run, own.tolist(), bad.tolist()))
                times = np.where(bad, 3, 1)
                inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                own, last = np.repeat(own, times) + inside, np.repeat(np.where(bad, own, last), times) + inside
        parts += [text[at:a], run]
        s += [starts[at:a], starts[own]]
        e += [ends[at:a], ends[last]]
        at = b
    if not parts:
        return None
    return "".join([*parts, text[at:]]), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]])


def _escapes(text: str, starts: np.ndarray, ends: np.ndarray):
    r"""The text with \uXXXX, \xXX and character references decoded; None without any."""
    parts, s, e, at = [], [], [], 0
    for m in _ESCAPE.finditer(text):
        if m[7]:
            char = html5.get(m[7], "")
            if len(char) != 1:
                continue
        else:
            code = int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
            if code > 0x10FFFF:
                continue
            char = chr(code)
        a, b = m.span()
        parts += [text[at:a], char]
        s += [starts[at:a], starts[a : a + 1]]
        e += [ends[at:a], ends[b - 1 : b]]
        at = b
    if not parts:
        return None
    return "".join([*parts, text[at:]]), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]])


def _bytes_of(run: str) -> bytes | None:
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None


def _decoded(raw: bytes, places: np.ndarray, starts: np.ndarray, ends: np.ndarray, loose: bool = False) -> list:
    """The layers of bytes whose base64 symbols stand at ``places``: their text, or the content of what is compressed;
    ``loose`` also takes what stands among other bytes."""
    i = np.arange(len(raw))
    s, e = starts[places[i * 8 // 6]], ends[places[((i + 1) * 8 + 5) // 6 - 1]]
    if _MAGIC.match(raw) and (got := _content(raw, int(s[0]), lambda n: int(e[n - 1]))) and (got[0] or got[1] == len(raw)):
        return got[0]
    layer = _text_of(raw, s, e)
    return [layer] if layer else list(_among(raw, s, e)) if loose else []


def _loose(run: str, at: int, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """What stands among the bytes of a run that is neither text nor compressed as a whole, from each of its four alignments."""
    for first in range(4):
        part = run[first : len(run) - ((len(run) - first) % 4 == 1)]
        raw = _bytes_of(part)
        if raw and (_WORTH.search(raw) or b"\0" in raw or _MAGIC.search(raw)):
            yield from _decoded(raw, np.arange(at + first, at + first + len(part)), starts, ends, True)


def _likely(raw: bytes | None) -> bool:
    """Whether bytes begin a compressed layer or a text."""
    if raw is None or _MAGIC.match(raw):
        return raw is not None
    try:
        return raw.decode("utf-8").isprintable()
    except UnicodeDecodeError as x:
        return x.start >= len(raw) - 3 and x.reason == "unexpected end of data"


def _realigned(run: str, at: int, starts: np.ndarray, ends: np.ndarray):
    """Layers of the parts of a run that begin at its start or after a separator, and end at its end or before one."""
    cuts = [m.start() for m in _SEPARATOR.finditer(run)]
    done = 0
    for first in [0, *(c + 1 for c in cuts)]:
        if first < done or len(run) - first < 16 or not _likely(_bytes_of(run[first : first + 16])):
            continue
        stop = len(run)
        while stop - first >= 16:
            part, limit = run[first:stop], stop
            if (raw := _bytes_of(part)) is not None and not _PLAIN_WORD.fullmatch(part):
                if layers := _decoded(raw, np.arange(at + first, at + stop), starts, ends):
                    yield from layers
                    done = stop
                    break
                try:
                    raw.decode("utf-8")
                except UnicodeDecodeError as x:
                    limit = min(stop, first + x.start * 8 // 6 + 2)
            k = bisect_left(cuts, limit) - 1
            if k < 0 or cuts[k] <= first:
                break
            stop = cuts[k]


def _blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines of base64 that were wrapped: of one width, but for a shorter last one."""
    for m in _WRAPPED.finditer(text):
        block: list[tuple[int, int]] = []
        for line in (*_LINE.finditer(m[0]), None):
            a, b = (line.start() + m.start(), line.end() + m.start()) if line else (0, 0)
            width = block[0][1] - block[0][0] if block else 0
            if line and (not block or b - a <= width):
                block.append((a, b))
                if b - a == width or len(block) == 1:
                    continue
                a = b = 0
            if len(block) > 1 and width >= 16:
                yield block
            block = [(a, b)] if b > a else []


def _base64s(text: str, starts: np.ndarray, ends: np.ndarray):
    """A layer for every base64 run that decodes to text or to a compressed layer; wrapped lines are one run."""
    joined_up: list[tuple[int, int]] = []
    for block in _blocks(text):
        for lines, loose in ((block, False), (block[:-1], False), (block, True)):  # the last line may be a word below the block
            run = "".join(text[a:b] for a, b in lines)
            raw = _bytes_of(run[: len(run) - (loose and len(run) % 4 == 1)]) if len(lines) > 1 else None
            layers = raw and _decoded(raw, np.concatenate([np.arange(a, b) for a, b in lines]), starts, ends, loose)
            if layers:
                yield from layers
                joined_up.append((lines[0][0], lines[-1][1]))
                break
    k = 0
    for m in _BASE64.finditer(text):
        while k < len(joined_up) and joined_up[k][1] <= m.start():
            k += 1
        if k < len(joined_up) and joined_up[k][0] <= m.start():
            continue
        run = m[0].rstrip("=")
        if _PLAIN_WORD.fullmatch(run):
            continue
        raw, a = _bytes_of(run), m.start()
        if raw is not None and (layers := _decoded(raw, np.arange(a, a + len(run)), starts, ends)):
            yield from layers
        else:
            yield from _realigned(run, a, starts, ends)
            yield from _loose(run, a, starts, ends)


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each sorted by start and kind; code points, end exclusive."""
    base = find(text)
    found = set(base)
    n = len(text)
    work = deque([(text, np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32))])
    seen = {hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest() + b"0"}
    while work:
        layer, starts, ends = work.popleft()
        inner = [x for x in (_percent(layer, starts, ends), _escapes(layer, starts, ends)) if x]
        inner += _base64s(layer, starts, ends)
        inner += _packed(layer, starts, ends)
        for t, s, e in inner:
            key = hashlib.sha1(t.encode("utf-8", "surrogatepass")).digest() + f"{s[:1]}:{e[-1:]}".encode()
            if not t or key in seen:
                continue
            seen.add(key)
            for kind, a, b in find(t):
                found.add((kind, int(s[a:b].min()), int(e[a:b].max())))
            work.append((t, s, e))
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted(found, key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex (of the base), base_spans, spans."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(1))
            n = len(texts)
            counts = np.zeros((3, n), np.int64)
            base_out, all_out = [""] * n, [""] * n
            for i in np.flatnonzero(pc.match_substring_regex(texts, _GATE).to_numpy(zero_copy_only=False)):
                base, every = scan_text(texts[int(i)].as_py())
                for kind, _, _ in base:
                    counts[KINDS.index(kind), i] += 1
                base_out[i], all_out[i] = joined(base), joined(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(base_out, pa.string()), pa.array(all_out, pa.string())], names=["id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    out = text_rows(docs, docs[id_col].alias("id"), docs[text_col].alias("text"))
    return out.mapInArrow(scan, f"id {id_type}, n_assign long, n_access long, n_hex long, base_spans string, spans string").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]``; all columns and rows stay, texts without a secret unchanged."""
    names = docs.columns
    at = names.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(at))
            new = None
            for i in np.flatnonzero(pc.match_substring_regex(texts, _GATE).to_numpy(zero_copy_only=False)):
                text = texts[int(i)].as_py()
                spans = scan_text(text)[1]
                if spans:
                    new = batch.column(at).to_pylist() if new is None else new
                    new[i] = replaced(text, spans)
            if new is not None:
                columns = list(batch.columns)
                columns[at] = pa.array(new, batch.column(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return text_rows(docs).mapInArrow(clean, docs.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans are merged and named by their first kind."""
    out, at, merged = [], 0, []
    for kind, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])
