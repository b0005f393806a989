"""Operators that compare texts with each other or learn from them."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from lattica.llm import lm_score, minhash, quality, simhash, suffix_dedup
from lattica.operators.components import connected_components

from .rows import documents, empty, prose, texts


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def collected(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# --- SimHash


def brute_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    got = simhash.fingerprint_batch(pa.array(texts(), pa.string()))
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in texts()]


def test_simhash_components(spark):
    df = documents(spark)
    rows = collected(df)
    fps = [brute_fingerprint(t) for _, t in rows]
    reach = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 4:
                    reach[i] = reach[j] = min(reach[i], reach[j])
    smallest = collections.defaultdict(list)
    for (d, _), c in zip(rows, reach):
        smallest[c].append(d)
    want = sorted((d or -1, fp, min(x for x in smallest[c] if x is not None) if any(x is not None for x in smallest[c]) else None) for (d, _), fp, c in zip(rows, fps, reach))
    got = sorted((r.doc_id or -1, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert repr(got) == repr(want)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_no_link_within_four_bits_is_lost():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (ka, ia), (kb, ib) = simhash.keys(a), simhash.keys(b)
    first = set(zip(ia.tolist(), ka.tolist()))
    assert len({i for i, k in zip(ib.tolist(), kb.tolist()) if (i, k) in first}) == len(a)


def test_large_groups_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    values = sorted({sum(1 << b for b in bits) for i in range(12) for bits in [(i, (i * 5) % 64, 40), (i, 41)]} | {(1 << 30) + sum(1 << b for b in (i, i + 1)) for i in range(12)})
    rows = [pa.RecordBatch.from_arrays([pa.array([5] * 40), pa.array(np.arange(40) * 3)], names=["key", "fp"])] * 3
    out = list(simhash._links(iter(rows)))
    assert sum(x is not None for b in out for x in b.column(4).to_pylist()) >= 2
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    links = [(r.a, r.b) for r in simhash.link_fingerprints(df).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in links) or links
    joined = {v: v for v in values}

    def root(v):
        while joined[v] != v:
            v = joined[v]
        return v

    for a, b in links:
        joined[max(root(a), root(b))] = min(root(a), root(b))
    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= 4:
                assert root(a) == root(b)


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(rows, similarity=0.8):
    """The smallest index that links of Jaccard similarity reach, for each text."""
    sets, reach = [shingle_set(t) for t in rows], list(range(len(rows)))
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x & y) >= similarity * len(x | y)]
    for _ in rows:
        for i, j in links:
            reach[i] = reach[j] = min(reach[i], reach[j])
    return reach


def edited_copies(n, seed, most=4, size=150):
    """A text and copies of it with up to ``most`` other words each."""
    import random

    r, out = random.Random(seed), []
    base = [f"w{r.randint(0, 999)}" for _ in range(size)]
    for _ in range(n):
        one = base[:]
        for _ in range(r.randint(0, most) if out else 0):
            one[r.randrange(size)] = f"new{r.randint(0, 999)}"
        out.append(" ".join(one))
    return out


def test_one_of_each_group_stays(spark):
    """Repeated ids with one text or several, null ids, repeated rows, null and empty texts."""
    copies = edited_copies(25, 5, 2)
    rows = [(i + 10, t) for i, t in enumerate(copies)] + [(5, copies[0]), (5, prose(80, 61)), (9, prose(80, 62)), (9, prose(80, 62)), (None, prose(80, 63)), (None, prose(80, 63)), (None, prose(80, 64)), (None, copies[3]), (7, None), (8, ""), (None, ""), (3, "word"), (3, "word")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id int, text string, x int, node int").repartition(3)
    kept = simhash.keep_first(df)
    reach = brute_groups([t for _, t in rows])
    want = collections.Counter()
    for c in set(reach):
        group = [(d is None, d or 0, t or "") for (d, t), r in zip(rows, reach) if r == c]
        want[min(group)[:2]] += 1
    got = collections.Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == want and kept.columns == df.columns
    assert {r.text for r in kept.where("doc_id = 5").collect()} >= {prose(80, 61)} and kept.where("doc_id = 9").count() == 1
    assert simhash.keep_first(df.limit(0)).count() == 0


def test_near_copies_are_found_by_word_fingerprints(spark):
    """Of 400 texts with up to four of 150 words changed, all links of 0.8 are kept, and no other texts are joined."""
    texts_ = [t for k in range(40) for t in edited_copies(10, k)]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.keep_first(df).collect()}
    want = set(brute_groups(texts_))
    assert len(got - want) <= 0.02 * len(texts_) and want <= got


def test_links_between_many_texts_of_one_fingerprint(spark, monkeypatch):
    """Pairs whose fingerprints are those of many other texts too are all verified."""
    texts_ = [t for k in range(60) for t in edited_copies(3, 300 + k, 2)]
    monkeypatch.setattr(simhash, "_text_fingerprints", _one_fingerprint)
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect()}
    assert got == set(brute_groups(texts_))


def _one_fingerprint(batches):
    for rows in simhash._text_fingerprints(batches):
        yield rows.set_column(3, "fps", pa.array([[5] * simhash.WORD_FINGERPRINTS] * rows.num_rows, pa.list_(pa.int64())))


# --- suffix arrays


def brute_dedup(raws, length):
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = 1
        keep = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone[:-1].sum()) if len(r) else 0, int((np.diff(np.append(0, gone)) == 1).sum()), hashlib.sha256(keep).hexdigest()))
    return out


def test_suffix_dedup(spark):
    df = documents(spark)
    rows = collected(df)
    want = sorted((d or -1, *x) for (d, _), x in zip(rows, brute_dedup([(t or "").encode() for _, t in rows], 200)))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect())
    assert got == want
    assert suffix_dedup.deduplicate(empty(spark)).count() == 0


def test_suffix_dedup_of_shared_passages(spark):
    passage = prose(60, 77)
    odd = [prose(30, i) + passage[i % 50 : 300 + i] + prose(20, i + 500) for i in range(30)] + [passage, "é" * 150 + passage[:199], "a" * 450, "ab" * 300]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_dedup([t.encode() for t in odd], 200))]


def test_passages_in_many_surroundings(spark, monkeypatch):
    """Groups beyond the limit are split down to single windows: a line shorter than the length sought, and longer passages
    with parts of them, each in 120 different surroundings; rows without an id among them."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    line, passage = prose(40, 81)[:150], prose(90, 82)
    odd = [f"{prose(15, 1000 + i)} {line} {prose(15, 2000 + i)} {passage[i % 9 * 10 : 420 - i % 7 * 15]} {prose(15, 3000 + i)}" for i in range(120)]
    df = spark.createDataFrame([(None if i % 3 == 0 else i, t) for i, t in enumerate(odd)], "doc_id long, text string").repartition(5)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect())
    assert got == sorted(brute_dedup([t.encode() for t in odd], 200)) and sum(x[1] for x in got) > 10_000


def test_large_anchors_with_copies(spark, monkeypatch):
    """Anchors beyond the limit, with whole copies of texts and passages, null texts and rows without an id."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    passage = prose(90, 83)
    odd = [f"{prose(15, 4000 + i)} {passage[i % 5 * 20 : 420]} {prose(15, 5000 + i)}" for i in range(60)]
    odd = odd + odd[:20] + [passage, passage, "é" * 150 + passage[:250], "", None, "ab" * 3000]
    df = spark.createDataFrame([(None if i % 4 == 0 else i // 2, t) for i, t in enumerate(odd)], "doc_id long, text string").repartition(5)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect())
    assert got == sorted(brute_dedup([(t or "").encode() for t in odd], 200)) and sum(x[1] for x in got) > 10_000


def test_long_runs_at_large_anchors(spark, monkeypatch):
    """A run of one character, long in one text and short in many surroundings, is cut out about twice, not at every place."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    odd = [f"{prose(20, 6000 + i)} {'a' * (150 + i)} {prose(20, 7000 + i)}" for i in range(60)] + [prose(5, 1) + "a" * 30_000 + prose(5, 2)]
    text = pa.array(odd[-1:])
    h = np.unique(suffix_dedup.anchors(np.frombuffer(odd[-1].encode(), np.uint8), np.array([0, len(odd[-1])]))[4])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), text, pa.array([2])], names=["id", "text", "tag"])
    cut = list(suffix_dedup._pieces_of(h)([batch, batch]))
    assert 0 < sum(x.num_rows for x in cut) < 1000
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").repartition(5)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect())
    assert got == sorted(brute_dedup([t.encode() for t in odd], 200))


def test_texts_are_shuffled_once(spark, tmp_path):
    """Of texts that do not compress, half of them with a part of a passage, one copy and the hashes of the pieces are shuffled."""
    r = random.Random(6)
    noise = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    passage = noise(260)
    odd = [noise(6000) + (passage[i % 50 : 230 + i % 30] if i % 2 else "") + noise(6000) for i in range(400)]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        got = suffix_dedup.deduplicate(spark.read.parquet(f"{tmp_path}/t")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(x.n_removed for x in got) > 20_000
    assert shuffled() - before < 2 * sum(map(len, odd))


def test_rows_without_ids_keep_their_own_spans(spark):
    odd = [prose(60, i) + (" " + prose(60, 0) if i % 4 == 0 else "") for i in range(600)]
    df = spark.createDataFrame([(None, t) for t in odd], "doc_id long, text string").repartition(5)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect())
    assert got == sorted(brute_dedup([t.encode() for t in odd], 200))


def test_suffix_array_and_prefixes():
    import random

    r = random.Random(3)
    for k in range(60):
        parts = [bytes(r.choices(b"ab" if k % 2 else b"abcd", k=r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        sizes = np.array([len(x) + 1 for x in parts])
        t = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + 1
        ends = np.cumsum(sizes) - 1
        t[ends] = 0
        sa = suffix_dedup.suffix_array(t)
        symbols = [(int(c), i if c == 0 else 0) for i, c in enumerate(t)]
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: symbols[i:])
        rest = np.repeat(ends, sizes) - np.arange(len(t))
        plcp, _ = suffix_dedup.permuted_prefixes(t, sa, rest)
        for a, b in zip(sa.tolist(), sa[1:].tolist()):
            n = 0
            while n < min(rest[a], rest[b]) and t[a + n] == t[b + n]:
                n += 1
            assert plcp[b] == n


# --- quality


def junk(i):
    w = prose(40, i).split()
    return [" ".join([w[0]] * 60), " ".join(x.upper() + "!!" for x in w), " ".join(x + "&&&" for x in w), " | ".join(w)][i % 4]


def test_classifier_on_held_out_rows(spark):
    rows = [(i, junk(i) if i % 3 == 0 else prose(60 + i % 50, i).capitalize() + ".", int(i % 3 != 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.with_scores(docs, model).collect()}
    held = [(got[i] >= quality.THRESHOLD) == bool(q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum(held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 602
    again = {r.doc_id: r.score for r in quality.with_scores(docs.repartition(7), quality.fit(docs.repartition(5), labels)).collect()}
    assert all(abs(again[k] - got[k]) < 1e-4 for k in got)  # float32 sums
    assert quality.fit(docs, labels.limit(0)).score(np.zeros((1, 18), np.float32), np.zeros(0, np.int32), np.zeros(0, np.float32), np.array([0, 0]))[0] == 0.5
    assert quality.with_scores(docs.limit(0), model).count() == 0
    odd = docs.limit(50).selectExpr("text", "doc_id as `a``b`", "1 as score", "cast(null as int) as n_chars", "2 as _chars2")
    scored = quality.with_scores(odd, model)
    assert scored.columns == ["text", "a`b", "n_chars", "_chars2", "score"] and {r["a`b"]: r.score for r in scored.collect()} == {r["a`b"]: got[r["a`b"]] for r in odd.collect()}
    assert quality.keep_good(docs, labels.limit(0)).count() == 602


def test_scores_equal_a_plain_computation():
    """The machine over the features of a table, one document at a time and term by term."""
    m = quality.FactorisationMachine()
    r = np.random.default_rng(5)
    m.w[:], m.w0 = r.normal(size=len(m.w)), np.float32(0.3)
    column = pa.array(texts(), pa.string())
    for a, stats, bucket, share, entries in quality.features(column, pa.array([len(t or "") for t in texts()])):
        got = m.score(stats, bucket, share, entries)
        for k in range(len(stats)):
            x = {i: float(v) for i, v in enumerate(np.clip((stats[k] - m.mean) * m.scale, -6, 6))}
            own = slice(entries[k], entries[k + 1])
            terms = [*x.items(), *((18 + int(b), float(s)) for b, s in zip(bucket[own], share[own]))]
            if len(terms) > 150:
                continue
            margin = float(m.w0) + sum(float(m.w[i]) * v for i, v in terms) + sum(float(m.v[i] @ m.v[j]) * v * u for n, (i, v) in enumerate(terms) for j, u in terms[n + 1 :])
            assert abs(got[k] - 1 / (1 + math.exp(-max(min(margin, 40), -40)))) < 1e-4
            assert len(words(texts()[a + k])) == 0 or abs(sum(float(s) ** 2 for s in share[own]) - 1) < 1e-3


def test_interactions_equal_the_pairwise_sum():
    m = quality.FactorisationMachine()
    m.w[:] = np.random.default_rng(1).normal(size=len(m.w))
    stats, bucket, share = np.random.default_rng(2).normal(size=(1, 18)).astype(np.float32), np.array([3, 9, 20], np.int32), np.array([0.5, 0.2, 0.8], np.float32)
    x = np.zeros(len(m.w))
    x[:18] = np.clip((stats - m.mean) * m.scale, -6, 6)
    x[18 + bucket] = share
    at = np.flatnonzero(x)
    pairs = sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert abs(m._margin(stats, bucket, share, np.array([0, 3]))[0][0] - (m.w0 + m.w @ x + pairs)) < 1e-4


# --- MinHash


def test_fingerprints_with_next(spark):
    df = documents(spark)
    rows = sorted(((d, t or "") for d, t in collected(df)), key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r.doc_id: r for r in minhash.fingerprint_with_next(df, block_bytes=9000).collect()}
    assert minhash.fingerprint_with_next(df, block_bytes=9000).count() == len(rows)
    shingles = lambda t: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)} or ({tuple(words(t))} if words(t) else set())
    by_text = {}
    for k, (d, t) in enumerate(rows):
        if d == 70 or (k + 1 < len(rows) and rows[k + 1][0] == 70):
            continue  # rows that share an id are ordered by a hash
        new = t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b = shingles(t), shingles(new)
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.25
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert minhash.fingerprint_with_next(empty(spark)).count() == 0


def test_minhash_near_duplicates(spark):
    base = prose(200, 5).split()
    changed = base[:100] + ["other"] + base[101:]
    rows = [(3, " ".join(base)), (1, " ".join(base)), (5, " ".join(changed)), (7, prose(200, 6)), (8, None), (9, "")]
    got = {r.doc_id: (r.class_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 3: (1, 1), 5: (5, 1), 7: (7, 7), 8: (8, 8), 9: (8, 8)}


@pytest.mark.parametrize("cut", [1, 2, 3, 100])
def test_members_of_groups(cut):
    rows = [(1, 5), (1, 5), (2, 7), (3, 4), (3, 4), (3, 9), (3, 1), (4, 4), (4, 4), (5, 1), (5, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in part]), pa.array([0] * len(part), pa.int8()), pa.array([n for _, n in part]), pa.array([10 * n for _, n in part], pa.int32())], names=["band", "no", "node", "size"]) for part in (rows[i : i + cut] for i in range(0, len(rows), cut))]
    got = [tuple(r.values()) for b in minhash._members(iter(batches)) for r in b.to_pylist()]
    assert got == [(3, 0, 4, 40, 4, 40), (3, 0, 9, 90, 4, 40), (3, 0, 1, 10, 4, 40), (5, 0, 1, 10, 1, 10), (5, 0, 2, 20, 1, 10)]
    assert list(minhash._members(iter([]))) == []


def test_links_in_hot_bands(spark, monkeypatch):
    """Texts that share much of their words, in groups beyond the limit for pairing: all links of 0.8 are found."""
    monkeypatch.setattr(minhash, "PAIRED", 4)
    common = prose(150, 77)
    texts_ = [f"{common} {prose(30, k)}" for k in range(30)] + edited_copies(15, 3) + [" ".join([prose(90, 5)] * n) for n in (2, 40, 90)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame([(str(i).zfill(3), t) for i, t in enumerate(texts_)], "doc_id string, text string")).collect()}
    assert got == {str(i).zfill(3): str(c).zfill(3) for i, c in enumerate(brute_groups(texts_))}


def test_one_shared_band_in_large_groups(spark, monkeypatch):
    """Pairs that meet in no more than one band keep their links, however many texts it holds."""
    base = prose(400, 91).split()
    texts_ = {}
    for k in range(100):
        for j in range(2):  # copies of one text at a similarity above 0.8, all others below
            w = list(base)
            w[:150] = prose(150, 1000 + k).split()[:150]
            w[390 - j] = f"other{k}"
            texts_[2 * k + j] = " ".join(w)
    banded = minhash._banded

    def one_band(batches):
        for rows in banded(batches):
            rows = rows.filter(pc.equal(rows.column(1), pa.scalar(0, pa.int8())))
            yield rows.set_column(0, "band", pa.array([1] * rows.num_rows, pa.int64()))

    monkeypatch.setattr(minhash, "_banded", one_band)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(texts_.items()), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in texts_}


@pytest.mark.parametrize("paired", [3, 1000])
def test_group_links_connect_all(spark, monkeypatch, paired):
    """Components by brute force, of one group with near copies, unrelated and empty texts, whole and block by block."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    common = prose(150, 78)
    texts_ = [*edited_copies(12, 4), *edited_copies(12, 9), *(f"{common} {prose(20 + k, k)}" for k in range(20)), "", "  ", prose(90, 3)]
    rows = [(i, t) for i, t in enumerate(texts_)] * 2
    links = minhash.group_links(spark.createDataFrame([(7, i, 200, 0) for i, _ in enumerate(texts_)], "band long, node long, size int, pivot long"), spark.createDataFrame(rows, "node long, text string"))
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert [found.get(i, i) for i in range(len(texts_))] == list(brute_groups(texts_))


# --- language model


def brute_model(rows):
    learnt = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for t in learnt:
        w = [*words(t), None]
        one.update(w)
        two.update(zip([None, *w], w))
        three.update(zip([None, None, *w], [None, *w], w))
    return one, two, three


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "WORD_SHARD_TOKENS", 900)
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 600)  # many shards: the common words' triples are split among them
    df = documents(spark)
    rows = collected(df)
    one, two, three = brute_model(rows)
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    p2 = lambda a, w: (two[a, w] + lm_score.MU * p1(w)) / (one[a] + lm_score.MU)
    context = collections.Counter()
    for (a, b, _), k in three.items():
        context[a, b] += k
    p3 = lambda a, b, w: (three[a, b, w] + lm_score.MU3 * p2(b, w)) / (context[a, b] + lm_score.MU3)
    want = []
    for d, t in rows:
        w = [*words(t), None]
        score = sum(math.log10(p3(*x)) for x in zip([None, None, *w], [None, *w], w))
        want.append((d or -1, d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    got = [(r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.score_documents(df).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and abs(a[6] - b[6]) < 4e-4 * a[2]  # some quantisation steps for each token
    assert len(got) == len(want)
    assert lm_score.score_documents(empty(spark)).count() == 0


def test_lm_triples_go_to_shards_once_a_chunk():
    """500 documents with the same two words send their triples once, not for each document."""
    texts_ = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(["alpha beta"] * 500), pa.array([i % 5 == 0 for i in range(500)])], names=["id", "text", "held"])
    chunk = next(lm_score._chunks(iter([texts_]))).to_pylist()[0]
    rows = [chunk | {"counts": None, "numbers": None}, dict.fromkeys(chunk) | {"chunk": chunk["chunk"], "part": 0, "counts": lm_score._pack(np.full(3, 400, "<u8")), "numbers": lm_score._pack(np.arange(3, dtype="<u8"))}]
    sent = [r for b in lm_score._deal(1, 7, 1200, 3)(iter(pa.Table.from_pylist(rows).to_batches())) for r in b.to_pylist() if r["shard"] >= 0]
    assert np.concatenate([lm_score._unpack(r["learnt"], "<u4") for r in sent]).tolist() == [400] * 4  # three, and one behind the end


def test_tries_are_stored_and_mapped(spark, tmp_path):
    """The stored tries hold the triples of the training rows with their shares."""
    df = documents(spark)
    one, two, three = brute_model(collected(df))
    stored = lm_score.tries(df)
    assert stored.schema.simpleString() == "struct<shard:bigint,trie:binary>"
    n_pairs = n_triples = 0
    for r in stored.collect():
        np.frombuffer(r.trie, np.uint8).tofile(tmp_path / "trie")
        trie = lm_score.Trie.open(str(tmp_path / "trie"))
        n_pairs += trie.second.n
        n_triples += trie.third.n
        at = trie.pairs(trie.contexts.access(np.arange(trie.contexts.n)), np.full(trie.contexts.n, 1 << 50, np.uint64))
        assert (at == -1).all()
    starts = 1  # a start and the end behind it are apart from the pair of two ends, which an empty text has
    assert n_pairs == starts + len({(a, b) for a, b, _ in three} | {(a, b) for a, b in two if b is None})
    assert n_triples == len(three) + len([1 for a, b in two if b is None])


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 5), (1000, 10**6), (500, 500), (700, 1 << 63)):
        v = np.sort(r.integers(0, universe, n, dtype=np.uint64))
        ef = lm_score.EliasFano.encode(v, universe)
        q = np.concatenate([r.integers(0, universe, 300, dtype=np.uint64), v])
        assert (ef.access(np.arange(n)) == v).all() and (ef.successor(q) == np.searchsorted(v, q)).all()


def test_trie_from_a_mapped_file(tmp_path):
    r = np.random.default_rng(1)
    contexts, vocabulary = np.sort(r.choice(1 << 40, 20, replace=False)), np.sort(r.choice(1 << 40, 50, replace=False))
    pairs = np.unique(r.integers(0, 20 * 50, 200))
    triples = np.unique(r.integers(0, len(pairs) * 50, 600))
    log2, log3 = -r.random(len(pairs)) * 10, -r.random(len(triples)) * 10
    lm_score.Trie.build(contexts, vocabulary, pairs // 50, pairs % 50, log2, triples // 50, triples % 50, log3).tofile(tmp_path / "trie")
    trie = lm_score.Trie.open(str(tmp_path / "trie"))
    at = trie.pairs(contexts[pairs // 50], vocabulary[pairs % 50])
    assert (at == np.arange(len(pairs))).all()
    assert np.abs(lm_score.restored(trie.shares(at)) - log2).max() < 1e-3
    assert np.abs(lm_score.restored(trie.shares(triples // 50, vocabulary[triples % 50])) - log3).max() < 1e-3
    every = np.arange(len(pairs) * 50)
    assert (trie.shares(every // 50, vocabulary[every % 50])[~np.isin(every, triples)] == 65535).all()
    assert (trie.pairs(contexts, np.full(20, 1 << 41)) == -1).all() and (trie.pairs(contexts + 1, np.full(20, vocabulary[0])) == -1).all()
    # all at once, every context and word looked up once; unknown ones among them
    more = np.unique(np.concatenate([vocabulary, vocabulary[:3] + 1]))
    asked = np.arange(len(contexts)).repeat(len(more)) << 32 | np.tile(np.arange(len(more)), len(contexts))
    ends = np.arange(len(asked)) << 32 | np.arange(len(asked)) % len(more)
    at = trie.pairs(contexts[asked >> 32], more[asked & 0xFFFFFFFF])
    two, three = trie.all_shares(contexts, more, asked, ends)
    assert (two == trie.shares(at)).all() and (three == trie.shares(at, more[ends & 0xFFFFFFFF])).all() and (two < 65535).any()
