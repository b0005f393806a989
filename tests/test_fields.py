"""Components by blocks, distances, resampling, ordered edits and data sources against brute force."""

from itertools import product

import numpy as np
import pytest

from lattica.operators import blocks, distance


def grid(seed, shape=(9, 8, 5), labels=3):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, labels, shape)
    return [(int(x) - 3, int(y), int(z) - 1, int(a[x, y, z]), i * 7) for i, (x, y, z) in enumerate(product(*map(range, shape)))]


@pytest.mark.parametrize("neighbours", [4, 6, 8, 18, 26])
def test_block_components_equal_flood_fill(spark, neighbours):
    rows = grid(neighbours)
    most, across = blocks.NEIGHBOURS[neighbours]
    steps = [s for s in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, s)) <= most and (across or not s[2])]
    at = {r[:3]: r for r in rows if r[3]}
    want = {}
    for r in sorted(at.values(), key=lambda r: r[4]):
        if r[4] in want:
            continue
        want[r[4]], stack = r[4], [r]
        while stack:
            p = stack.pop()
            for s in steps:
                n = at.get(tuple(a + b for a, b in zip(p, s)))
                if n and n[3] == r[3] and n[4] not in want:
                    want[n[4]] = r[4]
                    stack.append(n)
    df = spark.createDataFrame([*rows, (99, 0, 0, None, -5)], "x long, y long, z long, label long, node long").repartition(3)
    for block in ((2, 3, 2), (64, 64, 64)):
        got = {r["node"]: r["component"] for r in blocks.voxel_components(df, block, neighbours).collect()}
        assert got == want


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "x long, y long, z long, label long, node long")
    assert blocks.voxel_components(none).collect() == []


def test_smallest_reached_on_a_long_chain():
    n = 20_000
    order = np.random.default_rng(1).permutation(n)
    assert (blocks.smallest_reached(n, order[1:], order[:-1]) == 0).all()


def test_nearest_other_without_a_radius(spark):
    rows = [(x, y, z, v) for x, y, z, v, _ in grid(3, (7, 9, 3), 4)]
    rows = [r for i, r in enumerate(rows) if i % 5] + [(40, 30, 0, 1), (40, 31, 0, None), (0, 0, 9, 2), (1, 0, 9, 2)]
    df = spark.createDataFrame(rows, "x long, y long, z long, label long").repartition(3)
    want = {}
    for x, y, z, v in rows:
        others = [(abs(x - a) + abs(y - b), b, a, w) for a, b, c, w in rows if c == z and v and w and w != v]
        if others:
            want[x, y, z] = (min(others)[3], min(others)[0])
    got = {(r["x"], r["y"], r["z"]): (r["other"], r["distance"]) for r in distance.nearest_other_label(df).collect()}
    assert got == want


def test_poles_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    cells = [(p, int(x), int(y)) for p in range(4) for x in range(14) for y in range(11) if rng.random() < (0.97, 0.9, 0.6, 1.0)[p]] + [(9, 5, 5)]
    df = spark.createDataFrame(cells, "part long, x long, y long").repartition(3)
    want = {}
    for p in {c[0] for c in cells}:
        mine = {c[1:] for c in cells if c[0] == p}
        edge = [c for c in mine if any((c[0] + i, c[1] + j) not in mine for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
        far = {c: min((c[0] - e[0]) ** 2 + (c[1] - e[1]) ** 2 for e in edge) for c in mine}
        best = min(mine, key=lambda c: (-far[c], c))
        want[p] = (*best, far[best] ** 0.5)
    got = {r["part"]: (r["x"], r["y"], r["distance"]) for r in distance.poles(df, ["part"]).collect()}
    assert got == want


def test_envelope_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        at = sorted(rng.choice(60, rng.integers(1, 20), False).tolist())
        height = [int(h) ** 2 if rng.random() < 0.8 else distance._FAR for h in rng.integers(0, 25, len(at))]
        assert distance.envelope(at, height) == [min(min((p - q) ** 2 + h for q, h in zip(at, height) if h < distance._FAR), distance._FAR) if min(height) < distance._FAR else distance._FAR for p in at]


def brute_edits(labels, log):
    root = dict(labels)
    for e in sorted({e[0]: e for e in log}.values(), key=lambda e: (e[3], e[0])):
        _, old, new, _, _, assigned = e
        if len(new) == 1:
            root = {i: new[0] if r in old else r for i, r in root.items()}
        elif len(new) > 1:
            for i, r in assigned or []:
                if root.get(i) in old:
                    root[i] = r
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_and_splits_in_event_order(spark, tmp_path, seed):
    import datetime
    import json
    import random

    from lattica.streaming import ordered

    r = random.Random(seed)
    labels = [(i, i % 6) for i in range(40)]
    log = []
    for k in range(24):
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=r.randrange(12))
        old = r.sample(range(9), r.choice((1, 2)))
        if r.random() < 0.5:
            log.append((f"e{k:02}", old, [r.randrange(9)], ts, "t", None))
        else:
            log.append((f"e{k:02}", old, r.sample(range(9), 2), ts, "t", [(i, r.randrange(9)) for i in r.sample(range(42), 8)]))
    log.append(log[3])
    log.append(("none", [1], [], log[0][3], "t", None))
    r.shuffle(log)  # late events
    ordered.start(spark.createDataFrame(labels, "id long, root long"), str(tmp_path / "state"))
    (tmp_path / "in").mkdir()
    for n in range(3):
        with (tmp_path / "in" / f"{n}.json").open("w") as f:
            for e in log[n::3]:
                f.write(json.dumps({"event_id": e[0], "old_root_ids": e[1], "new_root_ids": e[2], "ts": e[3].isoformat() + "Z", "assigned": [{"id": i, "root": x} for i, x in e[5]] if e[5] else None}) + "\n")
            f.write("not json\n")
    stream = spark.readStream.schema(ordered.ORDERED_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ordered.run_ordered_listener(stream, str(tmp_path / "state"), str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    assert {x["id"]: x["root"] for x in ordered.ordered_labels(spark, str(tmp_path / "state")).collect()} == brute_edits(labels, log)


def contact_rows(n, seed=1):
    rng = np.random.default_rng(seed)
    at = np.round(rng.uniform(-20, 60, (n, 3)), 2).astype(np.float32).astype(float)
    return [(i, i % 5, i % 7 - 3, *map(float, at[i]), [[float(i), 1.0, 2.0, 0.5]] * (i % 3) if i % 4 else None) for i in range(n)]


def test_contact_source_round_trip_and_pruning(spark, tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    from lattica.sources import datasource as ds

    ds.register(spark)
    rows, path = contact_rows(500), str(tmp_path / "layer")
    df = spark.createDataFrame(rows, ds.SCHEMA)
    write = lambda part, mode: ds.dealt(part, (10, 10, 10)).write.format(ds.FORMAT).option("chunk", "10,10,10").mode(mode).save(path)
    write(df.where("id < 300"), "append")
    write(df.where("id >= 300"), "append")
    want = sorted((*r[:6], r[6] or []) for r in rows)
    read = lambda: spark.read.format(ds.FORMAT).load(path)
    assert sorted(map(tuple, read().collect())) == want
    box = "x >= 3.5 AND x < 21 AND y > -10 AND z <= 40"
    inside = [r for r in want if 3.5 <= r[3] < 21 and r[4] > -10 and r[5] <= 40]
    assert inside and sorted(map(tuple, read().where(box).collect())) == inside

    def planned(*filters):
        reader = ds.ContactReader(path)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sum(p.length for p in reader.partitions())

    whole, part = planned(), planned(GreaterThanOrEqual(("x",), 30.0), LessThan(("x",), 40.0), LessThan(("y",), 0.0))
    assert 0 < part < whole / 3
    assert planned(GreaterThanOrEqual(("z",), 1e6)) == 0 and read().where("z > 1e6").count() == 0
    write(df.where("id < 10"), "overwrite")
    assert read().count() == 10
    assert len(list((tmp_path / "layer").glob("*.shard"))) == len(ds.manifest(*ds.opened(path))["shards"])


def test_contact_source_failed_writes_leave_nothing(spark, tmp_path):
    from lattica.sources import datasource as ds

    ds.register(spark)
    path = str(tmp_path / "layer")
    good = spark.createDataFrame(contact_rows(50), ds.SCHEMA)
    put = lambda df, chunk="10,10,10": df.write.format(ds.FORMAT).option("chunk", chunk).mode("append").save(path)
    put(ds.dealt(good, (10, 10, 10)))
    bad = good.unionByName(spark.createDataFrame([(None, 1, 2, 0.0, 0.0, 0.0, None)], ds.SCHEMA))
    for df, chunk in ((bad, "10,10,10"), (good, "5,5,5")):
        with pytest.raises(Exception, match="contact needs|layer has chunks"):
            put(df, chunk)
        assert spark.read.format(ds.FORMAT).load(path).count() == 50
    assert not list((tmp_path / "layer" / "_temporary").glob("*")) or not list((tmp_path / "layer" / "_temporary").rglob("*.shard"))
    assert spark.read.format(ds.FORMAT).load(str(tmp_path / "none")).count() == 0


def test_suppression_equals_a_walk_in_order(spark):
    import random

    from lattica.operators import matching

    for seed in range(3):
        r = random.Random(seed)
        ids = r.sample(range(500), 80)
        pairs = [tuple(r.sample(ids, 2)) for _ in range(110)] + [(ids[0], ids[0])]
        kept = []
        for i in sorted(ids):
            if not any((i, k) in pairs or (k, i) in pairs for k in kept):
                kept.append(i)
        got = matching.suppressed(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(pairs, "a long, b long"))
        assert sorted(x["id"] for x in got.collect()) == kept


def brute_dedup(points, other, hit, radius):
    near = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[1:4], q[1:4])) ** 0.5 < radius
    own = [p for p in sorted(points) if p[4]]
    again = [p for p in own if p[0] not in hit and any(q[0] in hit and q[4] == p[4] and near(p, q) for q in own)]
    kept, dup = [], 0
    for p in own:
        if p[0] in hit or p in again:
            continue
        if any(q[4] == p[4] and near(p, q) for q in kept):
            dup += 1
        else:
            kept.append(p)
    return len(again), dup


def test_deduplicated_scores_equal_brute_force(spark):
    from lattica.operators import matching

    rng = np.random.default_rng(8)
    a, b = ([(k * 100 + i, *map(float, rng.integers(0, 30, 3)), [0, 1, 2, None][int(rng.integers(0, 4))]) for i in range(90)] for k in (1, 2))
    matches = [(100 + i, 200 + i, 0.0) for i in range(0, 90, 4)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, y double, z double, key int")
    got = matching.deduplicated_scores(frame(a), frame(b), spark.createDataFrame(matches, "a long, b long, dist double"), 7.0, ["x", "y", "z"], ["key"]).first()
    tp2, fp2 = brute_dedup(a, b, {m[0] for m in matches}, 7.0)
    fn1, fn2 = brute_dedup(b, a, {m[1] for m in matches}, 7.0)
    assert (got["dup_tp"], got["dup_fp"], got["dup_fn_matched"], got["dup_fn_unmatched"]) == (tp2, fp2, fn1, fn2) and fp2 and fn2
    tp = len(matches)
    assert abs(got["precision"] - tp / (90 - tp2 - fp2)) < 1e-12 and abs(got["recall"] - tp / (90 - fn1 - fn2)) < 1e-12


def test_matching_of_many_components_at_once(spark, monkeypatch):
    from lattica.operators import matching

    rng = np.random.default_rng(9)
    pairs = sorted({(int(a), int(b) + int(a) // 10 * 10) for a, b in zip(rng.integers(0, 300, 900), rng.integers(0, 10, 900))})
    cost = {p: float(c) for p, c in zip(pairs, rng.integers(1, 1000, len(pairs)))}
    rows, cols = (np.unique([p[k] for p in pairs], return_inverse=True)[1] for k in (0, 1))
    best = matching.assignment(rows, cols, np.array(list(cost.values())))
    df = spark.createDataFrame([(a, b, c) for (a, b), c in cost.items()], "a long, b long, dist double").repartition(3)
    got = matching.matched(df).collect()
    assert len(got) == len(best) == len({x["a"] for x in got}) == len({x["b"] for x in got})
    assert abs(sum(x["dist"] for x in got) - np.array(list(cost.values()))[best].sum()) < 1e-6


@pytest.mark.parametrize("size", [1, 7, 100])
def test_batches_of_components_are_whole(size):
    import pyarrow as pa

    from lattica.operators import matching

    rng = np.random.default_rng(10)
    rows = sorted({(int(c), int(c * 5 + a), int(c * 5 + b), float(a + b)) for c, a, b in rng.integers(0, 5, (400, 3)) * [8, 1, 1] + [[int(k), 0, 0] for k in rng.integers(0, 8, 400)]})
    whole = pa.Table.from_arrays([pa.array(x) for x in zip(*rows)], names=["component", "a", "b", "dist"])
    want = pa.Table.from_batches(matching._solved(iter(whole.to_batches()))).num_rows
    matching_held, matching.HELD_PAIRS = matching.HELD_PAIRS, 20
    try:
        got = pa.Table.from_batches(list(matching._solved(iter(whole.to_batches(max_chunksize=size)))))
    finally:
        matching.HELD_PAIRS = matching_held
    assert got.num_rows == want == len(set(got.column(0).to_pylist()))


def test_binary_points_in_hex(spark):
    import struct

    from pyspark.sql import functions as F

    from lattica.functions import scalar

    values = [0.0, -0.0, 1.0, -2.5, 1e308, 5e-324, -1.7e-310, 2.2250738585072014e-308, 123456.789, float("inf"), float("-inf"), 0.1]
    texts = [struct.pack("<BIddd", 1, 0x80000001, v, -v, v / 3).hex() for v in values] + [struct.pack("<BIdd", 1, 1, v, 7.0).hex().upper() for v in values]
    want = [[v, -v, v / 3] for v in values] + [[v, 7.0, 0.0] for v in values]
    rows = [(i, t) for i, t in enumerate([*texts, "1 2 3", "zz", None, "01"])]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i int, t string").select("i", scalar.any_point(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert [got[len(texts) + k] for k in range(4)] == [[1.0, 2.0, 3.0], None, None, None]


@pytest.mark.parametrize(("mode", "corners"), [("linear", False), ("linear", True), ("cubic", False), ("cubic", True), ("area", False), ("nearest", False)])
def test_resampling_keeps_constants_and_lines(spark, mode, corners):
    from lattica.operators import resample

    df = spark.createDataFrame([(x, c, 3.0 if c == 0 else float(x)) for x in range(12) for c in (0, 1)], "x long, c long, v double")
    for wanted in (5, 12, 31):
        got = {(r["c"], r["x"]): r["v"] for r in resample.resampled(df, {"x": 12}, {"x": wanted}, mode, corners).collect()}
        assert len(got) == 2 * wanted and all(abs(got[0, o] - 3.0) < 1e-12 for o in range(wanted))
        if (corners and mode == "linear") or wanted == 12:
            assert all(abs(got[1, o] - o * 11 / (wanted - 1)) < 1e-9 for o in range(3, wanted - 3))


def test_cubic_weights_equal_the_kernel(spark):
    from lattica.operators import resample

    a = resample.CUBIC
    kernel = lambda t: (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a
    want = np.zeros((7, 10))
    for o in range(7):
        at = (o + 0.5) * 10 / 7 - 0.5
        for i in range(int(np.floor(at)) - 1, int(np.floor(at)) + 3):
            want[o, min(max(i, 0), 9)] += kernel(abs(at - i))
    got = np.zeros((7, 10))
    for r in resample.weights(spark, 10, 7, "cubic").collect():
        got[r["o"], r["i"]] += r["w"]
    assert np.allclose(got, want)


def test_nested_documents_of_any_depth(spark):
    import json

    from lattica.operators import docstore

    rows = [(1, "a.b.c.d", "x"), (1, "a.b.e", 'quo"te\n'), (1, "a", "gone"), (1, "z", "1"), (2, "only", None), (2, "[odd].n", "y"), (3, "a.b", "u"), (3, "a.b", "v")]
    docs = docstore.nested(spark.createDataFrame(rows, "id long, path string, value string"), "id")
    got = {r["id"]: json.loads(r["doc"]) for r in docs.collect()}
    assert got == {1: {"a": {"b": {"c": {"d": "x"}, "e": 'quo"te\n'}}, "z": "1"}, 2: {"only": None, "[odd]": {"n": "y"}}, 3: {"a": {"b": "v"}}}
    flat = {(r["id"], r["path"], r["value"]) for r in docstore.leaves(docs, "id").collect()}
    assert flat == {(1, "a.b.c.d", "x"), (1, "a.b.e", 'quo"te\n'), (1, "z", "1"), (2, "only", None), (2, "[odd].n", "y"), (3, "a.b", "v")}
    change = spark.createDataFrame([(1, "a.b", "flat"), (1, "z.deep", "w"), (9, "new", "n")], "id long, path string, value string")
    merged = {(r["id"], r["path"], r["value"]) for r in docstore.merged_leaves(docstore.leaves(docs, "id"), change, "id").collect()}
    assert merged == {(1, "a.b", "flat"), (1, "z.deep", "w"), (2, "only", None), (2, "[odd].n", "y"), (3, "a.b", "v"), (9, "new", "n")}
    assert docstore.nested(spark.createDataFrame([], "id long, path string, value string"), "id").collect() == []


def test_scaled_boxes_and_guards(spark):
    from pyspark.sql import functions as F

    from lattica.functions import boxes, scalar
    from lattica.operators import resample
    from lattica.sources import chunked

    df = spark.createDataFrame([(4, 8), (5, 8)], "a int, b int")
    rounded = boxes.scaled_index([F.col("a")], [F.col("b")], [2.0], allow_rounding=True)[0]
    assert [tuple(r) for r in df.select(*rounded).collect()] == [(2, 4), (2, 4)]
    exact = boxes.scaled_index([F.col("a")], [F.col("b")], [2.0])[0]
    assert tuple(df.where("a = 4").select(*exact).first()) == (2, 4)
    with pytest.raises(Exception, match="not whole"):
        df.select(*exact).collect()
    zeros = spark.createDataFrame([(0, 0.0), (1, 0.0)], "x long, v double")
    assert scalar.skip_empty(zeros, lambda d: d.withColumn("v", F.lit(9.0))).agg(F.max("v")).first()[0] == 0
    assert scalar.skip_empty(zeros.withColumn("v", F.col("x") * 1.0), lambda d: d.withColumn("v", F.lit(9.0))).agg(F.max("v")).first()[0] == 9
    with pytest.raises(ValueError):
        resample.at_resolution(zeros, {"x": 3}, {"x": 4.0}, {"x": 8.0})
    with pytest.raises(ValueError):
        chunked.serialised(zeros, "xml")


def test_text_tables_round_trip(spark, tmp_path):
    from lattica.sources import chunked

    df = spark.createDataFrame([(2**60 + 1, "a,b"), (-5, 'q"uote')], "id long, name string")
    for fmt in ("csv", "json"):
        chunked.write_text_table(df, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, chunked.read_text_table(spark, str(tmp_path / fmt), "id long, name string", fmt).collect())) == sorted(map(tuple, df.collect()))
