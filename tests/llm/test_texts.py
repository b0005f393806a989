"""Operators that look at one text at a time."""

import base64
import bz2
import gzip
import hashlib
import lzma
import re
import struct
import urllib.parse
import zlib

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from lattica.llm import bpe, decontaminate, html_text, license_scan, secret_scan
from lattica.llm.license_scan import detections

from .rows import documents, empty, prose, texts


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


_HIDDEN = "password=Sup3rS3cretValue"
_B64 = base64.b64encode(_HIDDEN.encode()).decode()
_GZIP = gzip.compress(_HIDDEN.encode(), mtime=0)
_WRAPPED_B64 = base64.encodebytes(("some words before it, then " * 2 + _HIDDEN + " and words behind it " * 4).encode()).decode().strip()
_HEX = "".join(f"%{b:02X}" for b in _HIDDEN.encode())


@pytest.mark.parametrize(
    ("layer", "inside"),
    [
        (f"caf%E9 at 50%de, {_HEX} end", _HEX),
        (f"see %E9{_HEX}%ff end", _HEX),
        ("x " + "".join(f"\\u{{{ord(c):x}}}" for c in _HIDDEN), None),
        ("x " + "".join(f"\\U{ord(c):08x}" for c in _HIDDEN), None),
        ("look: " + urllib.parse.quote(_GZIP, safe="") + " end.", urllib.parse.quote(_GZIP, safe="")),
        ("look: " + urllib.parse.quote_plus(_GZIP) + " end.", urllib.parse.quote_plus(_GZIP)),
        ("look: " + repr(_GZIP)[2:-1] + " end.", repr(_GZIP)[2:-1]),
        ("look: " + "".join(f"\\x{b:02x}" for b in zlib.compress(_HIDDEN.encode())) + " end.", "".join(f"\\x{b:02x}" for b in zlib.compress(_HIDDEN.encode()))),
        (f"at path/to/{_B64.rstrip('=')} end", _B64.rstrip("=")),
        (f"key_{_B64.rstrip('=')}/more/of-it end", _B64.rstrip("=")),
        ("id-" + base64.b64encode(_GZIP).decode().rstrip("=") + " end", base64.b64encode(_GZIP).decode().rstrip("=")),
    ],
)
def test_layers_beside_other_text(layer, inside):
    base, every = secret_scan.scan_text(layer)
    at = layer.index(inside) if inside else 2
    stop = at + len(inside or layer[2:])
    assert base == [] and ("assign", at, stop) in every
    assert pc.match_substring_regex(pa.array([layer]), secret_scan._GATE)[0].as_py()
    assert secret_scan.replaced(layer, every) == layer[:at] + "[assign]" + layer[stop:]


@pytest.mark.parametrize("text", [f"mail:\n{_WRAPPED_B64}\nRegards", "mail:\r\n  " + _WRAPPED_B64.replace("\n", "\r\n  ")])
def test_wrapped_base64(text):
    """The secret crosses a line end; it is found whole, and no part of it besides."""
    plain = base64.b64decode(_WRAPPED_B64).decode()
    a = plain.index(_HIDDEN)
    body = [i for i, c in enumerate(text) if i >= 5 and not c.isspace()]
    assert secret_scan.scan_text(text)[1] == [("assign", body[a * 8 // 6], body[((a + len(_HIDDEN)) * 8 + 5) // 6 - 1] + 1)]


_ESCAPED = {
    "u4": "".join(f"\\u{ord(c):04x}" for c in _HIDDEN), "u8": "".join(f"\\U{ord(c):08X}" for c in _HIDDEN), "braces": "".join(f"\\u{{{ord(c):x}}}" for c in _HIDDEN), "x": "".join(f"\\x{ord(c):02x}" for c in _HIDDEN),
    "decimal": "".join(f"&#{ord(c)};" for c in _HIDDEN), "hex": "".join(f"&#X{ord(c):x};" for c in _HIDDEN), "percent": _HEX, "base64": _B64, "gzip": base64.b64encode(_GZIP).decode(),
    "utf16": base64.b64encode(_HIDDEN.encode("utf-16-le")).decode(), "utf16mark": base64.b64encode(_HIDDEN.encode("utf-16")).decode(), "head": base64.b64encode(b"\x00\xfe\x81\x07" + _HIDDEN.encode()).decode(),
    "wrapped gzip": "\n".join(re.findall(".{1,40}", base64.b64encode(gzip.compress((prose(30, 7) + _HIDDEN).encode())).decode())),
}


def test_every_form_reaches_the_table_queries(spark):
    """No form is lost to the gate of find_secrets and redact."""
    rows = [(name, f"see: {text}\nend of it") for name, text in _ESCAPED.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for r in secret_scan.find_secrets(df).collect():
        text = dict(rows)[r.doc_id]
        assert r.spans == secret_scan.joined(secret_scan.scan_text(text)[1]) and "assign" in r.spans, r.doc_id
    assert all("[assign]" in r.text for r in secret_scan.redact(df).collect())


@pytest.mark.parametrize("pad", [10, 300_000])
def test_compressed_layers_of_any_size(pad):
    """Cut-off streams, several members and content beyond one piece are searched alike."""
    import random

    noise = "\n".join(prose(12, i) for i in range(pad // 60)) + "\n"
    r = random.Random(1)
    rough = "\n".join(f"{r.getrandbits(64):x} {r.getrandbits(64):x}" for i in range(pad // 33)) + "\n"
    raws = {
        "cut gzip": gzip.compress((_HIDDEN + "\n" + rough * 2).encode())[:-12], "cut zlib": zlib.compress((_HIDDEN + "\n" + rough * 2).encode())[:-6],
        "members": gzip.compress(noise.encode()) + gzip.compress(_HIDDEN.encode()), "bz2": bz2.compress(noise.encode()) + bz2.compress(_HIDDEN.encode()), "xz": lzma.compress((noise + _HIDDEN).encode()), "twice": gzip.compress(zlib.compress((noise + _HIDDEN).encode())),
    }
    for name, raw in raws.items():
        b64 = base64.b64encode(raw).decode()
        spans = secret_scan.scan_text(f"see {b64} end")[1]
        assert any(k == "assign" and 4 <= a < b <= 4 + len(b64) for k, a, b in spans), name


def test_layers_larger_than_a_piece(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 16)
    lines = [prose(12, i) for i in range(4000)]
    lines[2000] += " " + _HIDDEN
    lines[3000] += " " + _B64
    b64 = base64.b64encode(gzip.compress("\n".join(lines).encode())).decode()
    assert len(set(secret_scan.scan_text(b64)[1])) == 1
    got = list(secret_scan._texts(iter([x.encode() for x in re.findall("(?s).{1,50000}", "\n".join(lines))])))
    assert "".join(got) == "\n".join(lines) and len(got) >= 3 and sum(_HIDDEN in t for t in got) == 1


def test_secret_base(spark):
    got = secret_scan.find_secrets(documents(spark)).collect()
    assert len(got) == documents(spark).count()
    by_id = {r.doc_id: r for r in got if r.doc_id != 70}
    for i, t in enumerate(texts()):
        want = brute_secrets(t or "")
        if i != 10:
            r = by_id[i * 7]
            assert r.base_spans == secret_scan.joined(want) and r.n_assign == sum(k == "assign" for k, _, _ in want)
    assert secret_scan.find_secrets(empty(spark)).count() == 0


def test_short_matches_consume_their_text():
    assert secret_scan.find('token: "token = abcdefgh"') == []
    assert secret_scan.find("to\u212aen=abcdef") == []  # only ASCII letters fold


def test_nested_layers_map_to_the_outer_text():
    secret = "password=Sup3rS3cretValue"
    b64 = lambda b: base64.b64encode(b).decode()
    percent = "".join(f"%{b:02x}" for b in secret.encode())
    unicode_ = "".join(f"\\u{ord(c):04x}" for c in secret)
    for layer in (b64(secret.encode()), percent, unicode_, b64(gzip.compress(secret.encode())), b64(b64(secret.encode()).encode()), b64(percent.encode()), "".join(f"&#{ord(c)};" for c in secret)):
        text = f"é before {layer} after"
        base, every = secret_scan.scan_text(text)
        found = [s for s in every if s not in base and s[0] == "assign"]
        assert found, layer
        _, a, b = found[0]
        assert 9 <= a < b <= 9 + len(layer)
    assert secret_scan.scan_text("%25" * 50 + "41")[1] == []  # decodes layer by layer and ends


def test_redaction_keeps_all_else(spark):
    df = documents(spark)
    out = secret_scan.redact(df)
    assert out.schema == df.schema and out.count() == df.count()
    by_id = {r.doc_id: r.text for r in out.collect()}
    assert by_id[19 * 7] == "[assign] and [assign]'" and by_id[20 * 7] == "key [access] end" and by_id[0] is None and by_id[18 * 7] == texts()[18]


def test_bpe_equals_the_library(spark):
    path = bpe.default_tokenizer()
    reference = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_decode(documents(spark), path).collect() if r.doc_id != 70}
    for i, t in enumerate(texts()):
        if i == 10:
            continue
        ids = reference.encode(t or "", add_special_tokens=False).ids
        r = got[i * 7]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty(spark), path).count() == 0


def test_bpe_round_trip(spark):
    path = bpe.default_tokenizer()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(documents(spark), path), path).collect() if r.doc_id != 70}
    assert all(back[i * 7] == (t or "") for i, t in enumerate(texts()) if i != 10)


def test_bpe_fuzz():
    path = bpe.default_tokenizer()
    reference, mine = Tokenizer.from_file(path), bpe.coder(path)
    import random

    r = random.Random(4)
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", " ", " ", "\x1c", "é", "1", "²", "!!", "<|endoftext|>", "<|", "😀", "́", "中", "ab", "The"]
    for _ in range(1500):
        text = "".join(r.choices(parts, k=r.randint(0, 12)))
        ids = reference.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def brute_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    found = [(i, label) for phrase, label in license_scan.PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def test_license_base(spark):
    got = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark)).collect() if r.doc_id != 70}
    for i, t in enumerate(texts()):
        if i == 10:
            continue
        n, found = brute_phrases(t)
        r = got[i * 7]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({k for _, k in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_license_rules_suppress_what_they_contain():
    labels = lambda t: [d[3] for d in detections(low(t))]
    assert labels("GNU General  Public\nLicense, version 3 or any later version") == ["gpl-3.0-or-later"]
    assert labels("CC BY-SA 4.0") == ["cc-by-sa-4.0"]
    assert labels("the Apache License, Version 2.0 and the MIT License") == ["apache-2.0", "mit"]
    assert labels("nothing here") == [] and len(license_scan.RULES) > 300
    text = "x  the  MIT   license"
    (d,) = detections(low(text))
    assert text[d[0] : d[1]] == "MIT   license"
    assert all(re._parser.parse(rule.pattern).getwidth()[1] < license_scan.REACH for _, _, _, rule in license_scan.RULES)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software", "mit"),
        ("zero-clause BSD", "0bsd"),
        ("mit licence", "mit"),
        ("under the Unicode License", "unicode"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0-or-later"),
        ("under the same terms as Perl 5 itself", "perl"),
        ("Licence Ouverte / Open Licence", "etalab-2.0"),
        ("GNU Lesser General Public License v2.1 only", "lgpl-2.1-only"),
        ("End-User Licence Agreement", "eula"),
        ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa-4.0"),
    ],
)
def test_license_texts(text, label):
    assert label in {d[3] for d in detections(low(text))}


def test_containment_equals_comparing_all():
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        found = [(a, a + r.randint(1, 20), r.randint(1, 4), r.choice("abc")) for a in (r.randint(0, 50) for _ in range(r.randint(1, 40)))]
        kept = []
        for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        start, end, rank, label = (np.array(x) for x in zip(*found))
        assert [found[i] for i in license_scan._outermost(start, end, rank, np.unique(label, return_inverse=True)[1])] == sorted(kept)


def test_a_long_text_of_license_lines():
    import time

    lines = ["gnu general public license, version 3 or any later version", "cc by-sa 4.0", "the apache license, version 2.0", "all rights reserved. copyright (c) 2019 x", "mit  licence"]
    text = "\n".join(lines[i % 5] for i in range(140_000))
    began = time.time()
    assert len(text) > 4 << 20 and len(detections(text)) == 140_000
    assert time.time() - began < 60  # comparing all detections takes hours


def test_decontamination(spark):
    items = [(i, prose(30, 100 + i)) for i in range(4)] + [(9, "too short"), (10, None), (None, prose(20, 200))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[0][1].split()
    w[4], w[20] = "other", "words"
    docs = [(1, f"{prose(40, 1)} {items[1][1]} {prose(40, 2)}"), (2, prose(30, 3) + " " + ", ".join(w).upper()), (3, prose(400, 5)), (4, None), (5, ""), (6, "too short"), (1, items[2][1]), (None, items[3][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
    want = {(d, i) for d, t in docs for i, x in items if t and x and brute_overlap(t, x)}
    assert got == want and {(1, 1), (2, 0), (1, 2), (None, 3)} <= got
    kept = decontaminate.remove_contaminated(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == df.columns
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0 and decontaminate.remove_contaminated(df, bench.limit(0)).count() == 8


def brute_overlap(text, item):
    """Most words that agree in a window of 13 words (or the item) of some alignment, if four fifths do; knows no masks."""
    a, b = (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) for t in (text, item))
    size, most = min(decontaminate.WINDOW, len(b)), 0
    if len(b) < decontaminate.MIN_WORDS:
        return 0
    for start in range(-len(b) + 1, len(a)):
        lo, hi = max(start, 0), min(start + len(b), len(a))
        same = [a[k] == b[k - start] for k in range(lo, hi)]
        most = max([most, *(sum(same[k : k + size]) for k in range(len(same) - size + 1))])
    return most if most >= decontaminate.SHARE * size else 0


def test_every_allowed_substitution_is_found(spark):
    """Items of 5 to 20 words, each with all places of as many substitutions as fit; and with one more, which do not."""
    from itertools import combinations

    rows, items = [], []
    for n in range(5, 21):
        words = prose(n, 700 + n).split()
        items.append((f"item{n}", " ".join(words)))
        for k in (0, 1, 2, 3):
            for at in combinations(range(n), k):
                changed = " ".join("zzz" if i in at else w for i, w in enumerate(words))
                rows.append((len(rows), f"before it {changed} behind it", n))
    df = spark.createDataFrame(rows, "doc_id int, text string, item int")
    got = {(r.doc_id, r.item_id): r.n_same for r in decontaminate.overlaps(df, spark.createDataFrame(items, "item_id string, text string")).collect()}
    by_name = dict(items)
    for d, text, n in rows:
        assert got.get((d, f"item{n}"), 0) == brute_overlap(text, by_name[f"item{n}"]), (n, text)


def test_ids_of_ints_and_hot_passages(spark):
    """A passage and a run of one word that many documents share; int ids."""
    item, dull = prose(30, 950), " ".join(["the"] * 300)
    docs = [(i, f"{prose(20, i)} {item if i % 3 == 0 else ''} {dull if i % 2 else ''}") for i in range(300)]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(1, item), (2, " ".join(["the"] * 20)), (2, " ".join(["the"] * 20))], "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, 1) for i in range(0, 300, 3)} | {(i, 2) for i in range(1, 300, 2)}
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "int"] and got.count() == 250


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("a <b> b </b>c<br>d", "a b c\nd"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
        ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name   N\nalpha  1\nb      22"),
        ("<pre>\n a\n\n  b</pre>", " a\n\n  b"),
        ("<head><title>t</title></head>x<script>y</script><style>z</style><i hidden>h</i><div style='display: none'>d</div>", "x"),
        ("&lt;&amp;&nbsp;é", "<& é"),
        ("</p></div>tail", "tail"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span>c</div>d", "b\nd"),
        ("<p style='visibility: visible; visibility: collapse'>a<p>b", "b"),
        ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>", "- b"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
        ("<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>中文<td>b<tr><td>abc<td>d</table>", "中文  b\nabc   d"),
        ("seen <!-- never closed <p>hidden", "seen"),
        ("seen <!-- closed --> too<a href='x", "seen too"),
        ("1 < 2 <!-> and", "1 < 2 and"),
        ("", ""),
    ],
)
def test_rendering(html, text):
    assert html_text.render(html) == text


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "<p>x", "u"), (2, None, "u"), (2, "", None), (None, "<div>" * 5000 + "deep", "u")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(df).collect()) == [(0, "deep"), (1, "x"), (2, ""), (2, "")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_all_visible_text_is_kept():
    import random

    r = random.Random(8)
    for _ in range(100):
        words, parts = [], []
        for i in range(30):
            parts.append(r.choice(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<b>", "</b>", "<br>", "<div>", "</div>", "<h1>", "</h1>", "<pre>", "</pre>"]))
            parts.append(f"w{i} ")
            words.append(f"w{i}")
        assert sorted(html_text.render("".join(parts)).split()) == sorted(w for w in words) or set(html_text.render("".join(parts)).replace(".", " ").split()) >= set(words)


_SECRET_BYTES = _HIDDEN.encode()
_ROUGH_LAYERS = {
    "latin-1 in gzip": gzip.compress(b"caf\xe9 notes " + _SECRET_BYTES, mtime=0),
    "latin-1 after": _SECRET_BYTES + b" caf\xe9",
    "latin-1 before": b"caf\xe9 notes " + _SECRET_BYTES,
    "binary tail": _SECRET_BYTES + bytes(range(128, 256)),
    "binary head of 60 bytes": bytes(range(190, 250)) + _SECRET_BYTES,
    "control characters": _SECRET_BYTES + b"\x01\x02\x03\x04\x05\x06",
    "utf-16 beyond two bytes": ("notes \U0001f600 " + _HIDDEN).encode("utf-16-le"),
    "utf-16 with a mark": ("notes \U0001f600 " + _HIDDEN).encode("utf-16"),
    "utf-16 in binary": bytes(range(190, 250)) + _HIDDEN.encode("utf-16-be") + b"\xff\xfe\xfd",
    "utf-16 in gzip": gzip.compress(_HIDDEN.encode("utf-16-le"), mtime=0),
    "gzip in binary": bytes(range(190, 250)) + _GZIP,
    "gzip thrice": gzip.compress(bz2.compress(lzma.compress(_SECRET_BYTES)), mtime=0),
}


@pytest.mark.parametrize("name", _ROUGH_LAYERS)
def test_bytes_that_are_no_text_hide_nothing(name):
    b64 = base64.b64encode(_ROUGH_LAYERS[name]).decode()
    for before in ("see ", "see x/"):
        text = f"{before}{b64} end of it"
        spans = secret_scan.scan_text(text)[1]
        assert any(k == "assign" and 4 <= a < b <= len(before) + len(b64) for k, a, b in spans), (before, spans)
        assert _HIDDEN not in secret_scan.replaced(text, spans) and pc.match_substring_regex(pa.array([text]), secret_scan._GATE)[0].as_py()


def test_span_of_a_secret_among_bytes():
    """The span is that of the base64 symbols that hold the secret's bytes."""
    raw = bytes(range(190, 220)) + _SECRET_BYTES + b"\xff\xfe\xfd"
    text = "see " + base64.b64encode(raw).decode()
    assert secret_scan.scan_text(text)[1] == [("assign", 4 + 30 * 8 // 6, 4 + ((30 + len(_HIDDEN)) * 8 + 5) // 6)]


def test_named_references():
    text = "password&equals;Sup3rS3cretValue and &nothing; &amp; &lt;"
    assert secret_scan.scan_text(text)[1] == [("assign", 0, text.index(" "))]


def test_unpacking_is_bounded(monkeypatch):
    """Content without a line end is cut with an overlap, nested streams are unpacked piece by piece, equal pieces are kept once."""
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 16)
    body = b"x" * 3_000_000 + b" " + _SECRET_BYTES
    pieces = list(secret_scan._unpacked(iter([gzip.compress(lzma.compress(bz2.compress(body)))])))
    assert b"".join(pieces) == body and max(map(len, pieces)) <= 1 << 16
    assert max(len(t) for t in secret_scan._texts(iter(pieces))) <= 2 << 16
    for raw in (gzip.compress(body), gzip.compress(gzip.compress(body))):
        assert {k for k, _, _ in secret_scan.scan_text("see " + base64.b64encode(raw).decode())[1]} == {"assign"}
    layers, _ = secret_scan._content(gzip.compress(b"token=abcdef12" * 1_000_000), 0, lambda n: n)
    assert len(layers) <= 32 and sum(len(t) for t, _, _ in layers) <= 32 << 16
