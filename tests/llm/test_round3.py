"""Prefix trie, cap filters and fill-in-middle against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lattica.llm import cap_filters, fim, prefix_trie, queries
from tests.llm.rows import documents, empty

SCHEMA = "conv_id long, turn long, role string, text string, h int, family string"


def brute_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, len(seq)))
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c, n in sorted(m) if n == len(p))
        out.append((min(m)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def made_conversations(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(2 * n), n):
        start = r.choice((0, 0, 1))
        for t in range(r.choice((1, 2, 3, 5, 9, 14))):
            rows.append((c, None if t == 0 and r.random() < 0.2 else t + start, r.choice(("user", "assistant", None)) if t > 4 else "user", r.choice(("a", "é", "bb", None)) if t > 2 else "same", 1, "x"))
    for c in (1000, 1005, 1010, 1015):  # equal long ones that leave the common start late
        rows += [(c, t, "user", "long", 1, "x") for t in range(22)]
    rows += [(1020, t, "user", "long" if t != 19 else "other", 1, "x") for t in range(22)]
    return rows + [(None, 0, "user", "nobody", 1, "x"), rows[0], (2001, 0, "user", "a", 0, ""), (2002, 0, None, None, 0, "")]


@pytest.mark.parametrize(("seed", "held", "steps"), [(1, 1 << 15, 8), (2, 6, 8), (3, 40, 3)])
def test_trie_equals_brute_force(spark, seed, held, steps):
    rows = made_conversations(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, prefix_trie.conversation_trie(df, held, steps).collect())) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(none).collect() == []
    rows = [(c, 0, "user", "a", 0, "") for c in range(1, 5)]  # no head: those with h > 0 become turnless
    assert sorted(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect())) == brute_trie(rows)


def test_refine_retires_single_sequences():
    out = [[] for _ in range(9)]
    prefix_trie.refine([(5, 3, "e", ["k", "l", "m"], [2, 3, 4])], 7, "above", out)
    assert [list(c[0]) for c in out] == [[5] * 3, [7, 8, 9], [None, 5, 5], [3] * 3, [1, 1, 0], [1] * 3, [18, 14, 8], [prefix_trie.EMPTY] * 2 + ["e"], ["above", None, None]]


def unit(x):
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def brute_links(vectors, cosine=0.9):
    n = len(vectors)
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    near = np.zeros((n, n), bool)
    for size in {len(v) for v, u in zip(vectors, usable) if u}:
        at = [i for i in range(n) if usable[i] and len(vectors[i]) == size]
        x = unit(np.array([vectors[i] for i in at], float))
        near[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return near


def expected(ids, vectors, cosine=0.9):
    near = brute_links(vectors, cosine)
    root = cap_filters.walk(near)
    least = {}
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r] = min(ids[i], least.get(r, ids[i]))
    return sorted(((ids[i], int(near[i].sum()), least.get(root[i]), ids[i] is not None and ids[i] == least.get(root[i])) for i in range(len(ids))), key=str)


def found(spark, ids, vectors, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, row int, vector int").repartition(3)
    return sorted(map(tuple, cap_filters.near_duplicates(df, **more).collect()), key=str)


def test_cap_filters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = unit(rng.normal(size=(200, 64)))
    copies = [c + rng.normal(size=64) * 0.02 * (1 + i % 3) for i, c in enumerate(np.repeat(base[:40], 5, axis=0))]
    vectors = [list(map(float, v)) for v in [*base, *copies, base[0], base[0], 3 * base[1]]]
    vectors += [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] * 64, [1.0, 0.0], [0.95, 0.1], [1e300, 1.0], [1e-300, 0.0], [2.0], [-2.0], [1.0]]
    ids = list(range(len(vectors)))
    ids[3], ids[4], ids[5] = None, 9, 9
    assert found(spark, ids, vectors) == expected(ids, vectors)


@pytest.mark.parametrize("spread", [0.01, 0.035, 0.06])
def test_hot_groups_block_by_block(spark, spread, monkeypatch):
    rng = np.random.default_rng(5)
    centre = unit(rng.normal(size=(2, 64)))
    hot = np.vstack([centre[0] + rng.normal(size=(400, 64)) * spread, centre[1] + rng.normal(size=(150, 64)) * 0.01, rng.normal(size=(300, 64))])
    vectors = [list(map(float, v)) for v in [*hot, *[centre[0]] * 100]]
    ids = list(range(0, 3 * len(vectors), 3))
    assert found(spark, ids, vectors, held=64) == expected(ids, vectors)


def test_hot_filters_send_one_row():
    rng = np.random.default_rng(6)
    import pyarrow as pa

    x = unit(rng.normal(size=(1, 64)))[0] + rng.normal(size=(600, 64)) * 0.001
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), pa.array([list(v) for v in x])], names=["row", "vector"])
    sent = pa.Table.from_batches(cap_filters._filters(*cap_filters.code_size(50_000, 0.9))([batch])).to_pandas()
    assert (sent["row"] < 0).sum() > 0 and (sent["filter"] < 0).sum() > 600
    keyed = sent.sort_values("filter", kind="stable")
    links = pa.Table.from_batches(cap_filters._classes(pa.Table.from_pandas(keyed, preserve_index=False).to_batches(max_chunksize=50))).to_pandas()
    assert set(links["a"]) | set(links["b"]) == set(range(600))


def test_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(2000, 64)))
    w = rng.normal(size=(2000, 64))
    w = unit(w - (w * x).sum(axis=1)[:, None] * x)
    y = 0.9 * x + 0.19**0.5 * w
    threshold, words = cap_filters.code_size(51_282, 0.9)
    family, planes = cap_filters.codes(64, words)
    shared = np.zeros(2000, bool)
    for code in family:
        a, b = (np.rec.fromarrays(cap_filters.list_decode(v, code, threshold)) for v in (x, y))
        shared[np.intersect1d(a, b)["f0"]] = True
    near = ((x @ planes > 0) != (y @ planes > 0)).sum(axis=1) <= cap_filters.MOST_SIGNS
    assert (shared & near).mean() > 0.99


def test_list_decoding_is_complete():
    rng = np.random.default_rng(8)
    x = unit(rng.normal(size=(50, 16)))
    turn, first, second = code = cap_filters.codes(16, 20)[0][0]
    y = x @ turn
    all_ = ((y[:, :8] @ first)[:, :, None] + (y[:, 8:] @ second)[:, None, :]).reshape(50, -1)
    for threshold in (1.0, 9.0):
        row, f = cap_filters.list_decode(x, code, threshold)
        least = np.minimum(threshold, np.sort(all_, axis=1)[:, -cap_filters.FLOOR])
        want = np.argwhere(all_ >= least[:, None] - 1e-12)
        assert {(int(a), int(b)) for a, b in zip(row, f)} == {(int(a), int(b)) for a, b in want}


def brute_fim(doc_id, text):
    import re

    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), out, text


def test_fill_in_middle_equals_brute_force(spark):
    docs = documents(spark)
    extra = [(900 + i, t, "en", "s", 0, 1, "h", b"") for i, t in enumerate(["<P>", "a<S>b", "<", "a<S", "P><M", "é𝄞 x\n\n", "<<<S S>P>", "word " * 50_000, "1" * 30_000])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=str)
    want = sorted((brute_fim(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert got == want
    assert fim.fill_in_middle(empty(spark)).collect() == []


def test_restore_survives_partial_sentinels():
    parts = ["", "<", "<S", "S>", ">", "<P", "<M", "M>", "P>", "x"]
    for p in parts:
        for m in parts:
            for s in parts:
                if not any(t in p + m + s for t in ("<P>", "<S>", "<M>")):
                    assert fim.restore("psm", f"<P>{p}<S>{s}<M>{m}") == p + m + s
                    assert fim.restore("spm", f"<S>{s}<P>{p}<M>{m}") == p + m + s


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_cap_filters", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = queries.QUERIES[name](spark, data)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(cur.fetchall(), key=str)
