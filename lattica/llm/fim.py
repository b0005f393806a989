"""Fill-in-the-middle rewriting by a two-pass streaming matcher.

The first pass counts a text's units; two ranks are drawn from the count; the
second pass advances one lazy match iterator to the smaller and then the larger
rank and takes the offsets that it stands at.  No unit is ever stored: beside the
text and its output a task holds one match.

Defined cases: a null text counts as empty, and an empty one stays plain; a text
that contains a sentinel stays plain, so that every output can be taken apart
again; a null id draws like an empty one; rows that share an id draw alike; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import as_strings, text_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Of 100 texts so many are rewritten, and of 100 rewritten ones so many give the suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20


def count_units(text: str) -> int:
    """The first pass."""
    last = deque(enumerate(_UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def offsets_at(text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: where the first ``low`` and the first ``high`` units end."""
    units = _UNIT.finditer(text)

    def advance(n: int, stand: int) -> int:
        last = deque(islice(units, n), maxlen=1)
        return last[0].end() if last else stand

    a = advance(low, 0)
    return a, advance(high - low, a)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit values from the id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def rewrite(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= REWRITTEN:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = offsets_at(text, low, high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text again.  A sentinel cannot begin inside a part and end outside, so the first one found is the one set."""
    if form == "plain":
        return output
    opened, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output[len(opened) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        made = [rewrite(ids[i].as_py(), t.as_py()) for i, t in enumerate(as_strings(batch.column(1)))]
        columns = list(zip(*made)) if made else [()] * 5
        again = [restore(form, output) for _, form, _, _, output in made]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))), pa.array(again, pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, restored) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    out = text_rows(docs, docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_rewrite, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
    return out.withColumnRenamed("id", id_col)


def digests(rewritten: DataFrame) -> DataFrame:
    """Output and restored text as SHA-256 digests."""
    plain = [c for c in rewritten.columns if c not in ("output", "restored")]
    return rewritten.select(*plain, F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))
