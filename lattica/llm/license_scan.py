"""License scans: ordered signature rules behind a keyword prefilter.

A rule is (priority, label, keyword, regex).  One pass finds all keywords; a rule
runs only around its own.  Detections are resolved by priority: one that lies
inside an accepted detection of the same or a higher priority is suppressed.

Defined cases: a null text counts as empty (no words, no labels, score 0);
repeated rows give equal results; an empty table gives an empty result; texts
are never cut; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import REACH, rules
from .textkit import LOWER, as_strings, byte_chunks, text_rows, word_spans

#: Everything but digits, lower-case letters and non-ASCII bytes separates words (after lower-casing).
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[97:123] = SEPARATOR[128:] = False

_IN, _GAP = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_PHRASES = [(label, phrase.split()[-1].encode(), re.compile(rb"(?<!" + _IN + rb")" + _GAP.join(w.encode() for w in phrase.split()) + rb"(?!" + _IN + rb")")) for phrase, label in PHRASES]

def _begins_with(pattern: str, keyword: str) -> bool:
    """Whether every match of the pattern starts with the keyword."""
    bare = pattern
    while (inner := re.sub(r"\([^()]*\)", "", bare)) != bare:
        bare = inner
    return pattern.removeprefix(r"\b").replace("\\", "").startswith(keyword) and "|" not in bare


RULES = [(priority, label, keyword, re.compile(pattern)) for priority, label, keyword, pattern in rules()]
_SPACES = re.compile(r"\s+")


def _automaton() -> ahocorasick.Automaton:
    """The prefilter: finds every keyword in one pass, with the numbers of its rules."""
    out, by_keyword = ahocorasick.Automaton(), {}
    for i, (_, _, keyword, _) in enumerate(RULES):
        by_keyword.setdefault(keyword, []).append(i)
    for keyword, numbers in by_keyword.items():
        out.add_word(keyword, (keyword, numbers))
    out.make_automaton()
    return out


_KEYWORDS = _automaton()


def _flat(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with each run of white space as one blank; where runs end there, and the characters lost up to each."""
    runs = [(m.start(), m.end()) for m in _SPACES.finditer(text) if m.end() - m.start() > 1]
    lost = np.cumsum([0, *(b - a - 1 for a, b in runs)])
    ends = np.array([b for _, b in runs], np.int64) - lost[1:]
    return _SPACES.sub(" ", text), ends, lost


def _outermost(start: np.ndarray, end: np.ndarray, rank: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Numbers of the detections that lie inside no other one of equal or higher rank, by a sweep for each rank.

    Of equal detections of one rank the first label stays.  A suppressed detection's container, or the container
    of that, is kept, so each is held against the kept ones only: the furthest end among those that start no later.
    """
    kept = np.zeros(0, np.int64)
    for r in np.unique(rank)[::-1]:
        own = np.flatnonzero(rank == r)
        own = own[np.lexsort((label[own], -end[own], start[own]))]
        reach = np.maximum.accumulate(end[own])
        free = np.append(True, reach[:-1] < end[own][1:])
        if len(kept):
            by_start = kept[np.argsort(start[kept], kind="stable")]
            furthest = np.maximum.accumulate(end[by_start])
            at = np.searchsorted(start[by_start], start[own], "right") - 1
            free &= (at < 0) | (furthest[np.maximum(at, 0)] < end[own])
        kept = np.concatenate([kept, own[free]])
    return kept[np.lexsort((label[kept], rank[kept], end[kept], start[kept]))]


def detections(lowered: str) -> list[tuple[int, int, int, str]]:
    """Kept detections as (start, end, priority, label) of a lower-cased text; code points, end exclusive.

    Rules run only at or within REACH of their keyword; containment is resolved in n log n.
    """
    flat, run_ends, lost = _flat(lowered)
    at: dict[str, list[int]] = {}
    numbers: dict[str, list[int]] = {}
    for last, (keyword, own) in _KEYWORDS.iter(flat):
        at.setdefault(keyword, []).append(last + 1 - len(keyword))
        numbers[keyword] = own
    found = []
    for keyword, places in at.items():
        near: list[list[int]] = []
        for number in numbers[keyword]:
            rule = RULES[number][3]
            if number in _ANCHORED:
                stop = 0
                for place in places:
                    if place >= stop and (m := rule.match(flat, place)):
                        stop = m.end()
                        found.append((place, stop, number))
                continue
            if not near:
                for place in places:
                    if near and place - REACH <= near[-1][1]:
                        near[-1][1] = place + REACH
                    else:
                        near.append([max(place - REACH, 0), place + REACH])
            found += [(*m.span(), number) for lo, hi in near for m in rule.finditer(flat, lo, hi)]
    if not found:
        return []
    start, end, number = np.array(found, np.int64).T
    start, end = start + lost[np.searchsorted(run_ends, start, "right")], end + lost[np.searchsorted(run_ends, end - 1, "right")]
    kept = _outermost(start, end, _PRIORITIES[number], _LABEL_ORDER[number])
    return [(int(start[i]), int(end[i]), RULES[number[i]][0], RULES[number[i]][1]) for i in kept]


_ANCHORED = {i for i, (_, _, keyword, rule) in enumerate(RULES) if _begins_with(rule.pattern, keyword)}
_PRIORITIES = np.array([priority for priority, *_ in RULES])
_LABEL_ORDER = np.unique([label for _, label, *_ in RULES], return_inverse=True)[1]


def _certainty(priority: int) -> float:
    return min(1.0, priority / 90)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (kept ones, as label:start:end)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(1))
            n = len(texts)
            words, base_n, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last, base_labels, labels, where = [None] * n, [None] * n, [""] * n, [""] * n, [""] * n
            for a, b, buf, offsets in byte_chunks(texts):
                low = LOWER[buf]
                starts, _, firsts = word_spans(low, offsets, SEPARATOR)
                words[a:b] = np.diff(firsts)
                for i in range(b - a):
                    x, y = int(offsets[i]), int(offsets[i + 1])
                    raw = low[x:y].tobytes()
                    own = starts[firsts[i] : firsts[i + 1]] - x
                    places, names = [], set()
                    for label, last_word, phrase in _PHRASES:
                        at = [m.start() for m in phrase.finditer(raw)] if last_word in raw else []
                        if at:
                            places += np.searchsorted(own, at).tolist()
                            names.add(label)
                    kept = detections(raw.decode("utf-8"))
                    if not kept and not names:
                        continue
                    row = a + i
                    base_n[row] = len(places)
                    if places:
                        first[row], last[row] = min(places), max(places)
                    base_labels[row] = ",".join(sorted(names))
                    labels[row] = ",".join(sorted(names | {d[3] for d in kept}))
                    where[row] = ",".join(f"{d[3]}:{d[0]}:{d[1]}" for d in kept)
                    score[row] = max([0.5 * bool(names), *(_certainty(d[2]) for d in kept)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(base_n), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score), pa.array(where, pa.string())], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    out = text_rows(docs, docs[id_col].alias("id"), docs[text_col].alias("text"))
    return out.mapInArrow(run, f"id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string").withColumnRenamed("id", id_col)
