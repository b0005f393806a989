"""Operators against hand-made rows and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import boxes, scalar, spatial
from lattica.operators import augment, components, contact_tables, contacts, datasets, docstore, grids, matching, ranking, records, sampling, shapes, taskdb
from lattica.sources import binary, chunked, files, info, shards
from lattica.streaming import edits


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_boxes(spark):
    b = spatial.box((0, 0, 0), (10, 10, 10))
    p = [F.lit(10.0), F.lit(1.0), F.lit(1.0)]
    touching = [(F.lit(10.0), F.lit(12.0))] * 3
    assert one(spark, spatial.contains(p, b), spatial.intersects(touching, b)) == (False, False)
    # a slanted line that touches the far face counts, one parallel to it on the face does not
    slanted = spatial.line_hits([F.lit(x) for x in (10.0, 5.0, 5.0)], [F.lit(x) for x in (20.0, 6.0, 5.0)], b)
    parallel = spatial.line_hits([F.lit(x) for x in (10.0, -5.0, 5.0)], [F.lit(x) for x in (10.0, 15.0, 5.0)], b)
    assert one(spark, slanted, parallel) == (True, False)


def test_morton_is_a_bijection(spark):
    g = spatial.grid(spark, (5, 3, 2)).select(spatial.morton([F.col(c) for c in ("cx", "cy", "cz")], (5, 3, 2)).alias("m"))
    assert g.distinct().count() == 30


def test_scalars(spark):
    r = one(spark, scalar.int_divide(F.lit(-7), 2), scalar.int_divide(F.lit(7), 0), scalar.invert_uint8(F.lit(0)), scalar.invert_uint8(F.lit(1)), scalar.parse_point(F.lit("1, 2 |3")), scalar.parse_point(F.lit("1 2")), scalar.bucket_of(F.lit("https://x/storage/v1/b/pail/o/k")), scalar.config_key(F.lit("pc_r10_p64")))
    assert list(r)[:4] == [-4, None, 1, 0] and r[4] == [1.0, 2.0, 3.0] and r[5] is None and r[6] == "pail" and (r[7].radius, r[7].n) == (10, 64)


def test_components_of_a_path_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7), (None, 3)]
    for few in (0, components.HELD_EDGES):  # by rounds of stars, and by one last task
        got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), few=few).collect()))
        assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_assignment_is_optimal():
    """Sparse pairs against all ways to choose them: most pairs first, then the least total."""
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (2, 4), (4, 4), (5, 3), (4, 5)):
        for _ in range(30):
            at = np.argwhere(rng.random((n, m)) < 0.6)
            if not len(at):
                continue
            cost = rng.integers(0, 20, len(at)).astype(float)
            rows, cols = np.unique(at[:, 0], return_inverse=True)[1], np.unique(at[:, 1], return_inverse=True)[1]
            got = matching.assignment(rows, cols, cost)
            assert len({*rows[got].tolist()}) == len({*cols[got].tolist()}) == len(got)
            best = (0, 0.0)

            def search(k, used_r, used_c, count, total):
                nonlocal best
                best = max(best, (count, -total))
                for i in range(k, len(at)):
                    if rows[i] not in used_r and cols[i] not in used_c:
                        search(i + 1, used_r | {rows[i]}, used_c | {cols[i]}, count + 1, total + cost[i])

            search(0, frozenset(), frozenset(), 0, 0.0)
            assert (len(got), -cost[got].sum()) == best


def test_evaluation_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(y), 0.0, int(a), int(b)) for i, (x, y, a, b) in enumerate(zip(rng.integers(0, 60, 120), rng.integers(0, 60, 120), rng.integers(0, 3, 120), rng.integers(0, 3, 120)))]
    schema = "id long, x double, y double, z double, pre int, post int"
    left, right = rows[:60], rows[60:]
    got = matching.evaluated(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 9.0, ["x", "y", "z"], [(5, 55), (5, 55), (-1, 1)], ("pre", "post")).first()
    good = lambda part: [r for r in part if r[4] != r[5] and 5 <= r[1] < 55 and 5 <= r[2] < 55]
    a, b = good(left), good(right)
    pairs = [(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if p[4:] == q[4:] and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 < 81]
    partner: dict[int, int] = {}

    def grow(i, seen):
        for x, j in pairs:
            if x == i and j not in seen:
                seen.add(j)
                if j not in partner or grow(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    tp = sum(grow(i, set()) for i in range(len(a)))
    assert (got.tp, got.fp, got.fn) == (tp, len(a) - tp, len(b) - tp) and tp > 5


def test_info_grows_but_does_not_change(spark, tmp_path):
    one = {"type": "image", "scales": [info.scale((4, 4, 40), (0, 0, 0), (1024, 1024, 400), (64, 64, 4))]}
    two = {"type": "image", "scales": [info.scale((8, 8, 40), (4, 0, 0), (1025, 1024, 400), (64, 64, 4))]}
    both = info.updated(one, two)
    assert [s["key"] for s in both["scales"]] == ["4_4_40", "8_8_40"] and both["scales"][1]["voxel_offset"][0] == 0 and both["scales"][1]["size"][0] == 128
    changed = {"type": "image", "scales": [{**one["scales"][0], "size": [1, 1, 1]}]}
    for bad in (changed, {"type": "labels"}):
        with pytest.raises(ValueError):
            info.updated(both, bad)
    with pytest.raises(ValueError):
        info.updated(both, two, keep_scales=False)
    assert info.updated(both, changed, overwrite=True)["scales"][0]["size"] == [1, 1, 1]
    with pytest.raises(FileNotFoundError):
        info.read_info(spark, str(tmp_path))
    info.write_info(spark, str(tmp_path), both)
    assert info.read_info(spark, str(tmp_path)) == both
    configs = contact_tables.merged_configs([{"radius_nm": 5, "n_points": 1, "k": 0}, {"radius_nm": 2, "n_points": 1}], [{"radius_nm": 5, "n_points": 1, "k": 9}])
    assert configs == [{"radius_nm": 2, "n_points": 1}, {"radius_nm": 5, "n_points": 1, "k": 9}]


def test_box_requests(spark):
    assert boxes.from_slices([slice(1, 3), slice(0, 2)], (4, 0.5)) == [(4, 12), (0.0, 1.0)]
    for bad in ([slice(0, 4, 2)], [slice(None, 4)]):
        with pytest.raises(ValueError):
            boxes.from_slices(bad, (1,))
    assert boxes.index_of(((4, 4, 40), slice(0, 2), slice(1, 2), slice(0, 1)))["box"] == [(0, 8), (4, 8), (0, 40)]
    with pytest.raises(ValueError):
        boxes.index_of((slice(0, 2),))
    boxes.chunk_aligned([(64, 128), (0, 100)], (0, 0), (64, 64), (256, 100))
    with pytest.raises(ValueError, match="64 to 192"):
        boxes.chunk_aligned([(64, 130)], (0,), (64,))
    boxes.check_levels([{"chunk_size": [64], "grid_shape": [2]}, {"chunk_size": [16], "grid_shape": [7]}])
    for bad in ([{"chunk_size": [64], "grid_shape": [2]}, {"chunk_size": [20], "grid_shape": [7]}], [{"chunk_size": [64], "grid_shape": [2]}, {"chunk_size": [16], "grid_shape": [9]}]):
        with pytest.raises(ValueError):
            boxes.check_levels(bad)
    with pytest.raises(ValueError):
        boxes.child_cells([1], [10], [4])
    assert boxes.strided_exact((5,), (61,), (16,)) == [(2, 16, 11, 13)]
    with pytest.raises(Exception, match="off the grid"):
        spark.range(1).select(boxes.slices([(1.5, 3.0)], [1])[0][0]).collect()


def test_shards_round_trip(spark, tmp_path):
    rows = [(int(i), bytes([i % 251]) * (i % 7)) for i in np.random.default_rng(3).permutation(500)]
    df = spark.createDataFrame(rows, "id long, data binary").repartition(5)
    files = shards.write_shards(df, str(tmp_path / "s"), "id", "data", 1, 3, 2)
    assert files.agg({"n_chunks": "sum"}).first()[0] == 500
    got = shards.read_shards(spark, str(tmp_path / "s"), 3).collect()
    assert sorted((r.id, bytes(r.data)) for r in got) == sorted(rows)
    assert all((r.shard, r.minishard) == (r.id >> 4 & 3, r.id >> 1 & 7) for r in got)


def test_shapes_and_tables_of_nothing(spark):
    empty = spark.createDataFrame([], "x long, y long, v double")
    assert shapes.cropped(empty, {"x": 4}, {"x": 1}).count() == shapes.upsampled_linear(empty, "x", 4, 2).count() == shapes.eroded(empty, ["x", "y"], {"x": 4, "y": 4}, 1).count() == 0
    with pytest.raises(ValueError):
        shapes.cropped_centre(empty, {"x": 4}, {"x": 5})
    with pytest.raises(ValueError):
        shapes.reduced(empty, ["x"], "median")
    with pytest.raises(Exception, match="more than one slice"):
        shapes.squeezed(spark.createDataFrame([(1, 2.0)], "t int, v double"), "t").collect()
    state = spark.createDataFrame([(None,), ("{}",), ("no json",), ('{"layers": [{"type": "annotation", "name": "Seed Location"}]}',)], "s string").select(taskdb.annotations_of(F.col("s")).alias("a"), taskdb.trace_verdict(F.col("s"), F.lit("Merger")).alias("why"))
    assert {(r.a.seed, len(r.a.certain_ends), r.why) for r in state.collect()} == {(None, 0, "not one segment")}
    have = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    out, rejected = taskdb.inserted(have, spark.createDataFrame([("a", 5), ("b", 6), (None, 7), ("c", 8), ("c", 9)], "k string, n int"), ["k"])
    assert sorted(r.n for r in out.collect()) == [1, 2, 6] and {(r.n, r.reason) for r in rejected.collect()} == {(5, "exists already"), (7, "no k"), (8, "asked for twice"), (9, "asked for twice")}


def test_matching(spark):
    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 1.5), (9, 9, 0.5)], "a long, b long, dist double")
    got = {(r.a, r.b) for r in matching.matched(pairs).collect()}
    assert got == {(1, 2), (2, 1), (9, 9)}
    s = matching.scores(spark.range(4), spark.range(6), matching.matched(pairs)).first()
    assert (s.tp, s.fp, s.fn) == (3, 1, 3)


def test_blend_weights_sum_to_one(spark):
    rows = grids.overlapped(spark.range(40).withColumnRenamed("id", "pos"), "pos", 10, 3, 0, 40)
    for kind in ("linear", "quadratic", "bump"):
        assert grids.blend(rows, "pos", F.lit(1.0), kind, 3).where("abs(value - 1) > 1e-9").count() == 0


def test_negative_values_blend_to_zero(spark):
    rows = grids.overlapped(spark.range(4).withColumnRenamed("id", "pos"), "pos", 10, 3, 0, 4)
    assert {r.value for r in grids.blend(rows, "pos", F.lit(-1.0), "max", 3).collect()} == {0.0}


def test_boundary_pairs_lose_all_rows(spark):
    p = spark.createDataFrame([(1, 2, 0.0), (1, 2, 9.0), (1, 3, 0.0)], "a int, b int, x double")
    assert [(r.a, r.b) for r in contacts.drop_groups_touching(p, ["a", "b"], F.col("x") > 5).collect()] == [(1, 3)]


def test_centre_without_weights_is_the_mean(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (1, 2.0, 4.0, 6.0, 0.0)], "k int, x double, y double, z double, w double")
    r = contacts.weighted_centre(p, ["k"], "w").first()
    assert (r.com_x, r.com_y, r.com_z) == (1.0, 2.0, 3.0)


def test_docstore(spark):
    df = spark.createDataFrame([("a", 1, ["x"]), ("b", 5, ["y", "z"]), ("c", None, None)], "k string, n int, t array<string>")
    keys = lambda d: sorted(r.k for r in d.collect())
    assert keys(docstore.matching(df, {">n": [2], "-t": ["x"]}, True)) == ["a", "b"]
    assert keys(docstore.matching(df, {">n": [0], "-t": ["z"]}, False)) == ["b"]
    assert keys(docstore.matching(df, {})) == ["a", "b", "c"]
    assert [(r.k, r.n) for r in docstore.by_keys(df, ["b", "q", "a"], "k").orderBy("ordinal").collect()] == [("b", 5), ("q", None), ("a", 1)]
    child = spark.createDataFrame([("p", "a"), ("q", "b")], "c string, k string")
    left = docstore.cascade_deleted([df.withColumn("g", F.lit("g")), child], spark.createDataFrame([("a",)], "k string"), [("k", "k"), ("c", "k")])
    assert [keys(x) for x in left] == [["b", "c"], ["b"]]
    assert sum(docstore.batch_of(df, "k", 3, i).count() for i in range(3)) == 3
    with pytest.raises(IndexError):
        docstore.batch_of(df, "k", 3, 3)


def test_ambiguous_prices_cost_nothing(spark):
    use = spark.createDataFrame([("w", 1, 2.0), ("w", 2, 3.0), ("v", 3, 1.0)], "worker string, sku int, h double")
    prices = spark.createDataFrame([(1, 10.0), (2, 5.0), (2, 6.0)], "sku int, price double")
    got = {r.worker: (r.hours, r.cost) for r in records.costs(use, prices, ["sku"], F.col("h"), "price", "worker").collect()}
    assert got == {"w": (5.0, 20.0), "v": (1.0, 0.0), None: (6.0, 20.0)}


def test_retries_without_a_limit(spark):
    q = spark.createDataFrame([(1, 9, "processing")], "seed_id long, retry_count int, status string")
    assert records.retried(q, q, "seed_id", 0).first().status == "pending"
    assert records.retried(q, q, "seed_id", 3).first().status == "failed"


def test_fallback_takes_the_first_strategy(spark):
    a, b = spark.createDataFrame([(1, 5)], "u int, t int"), spark.createDataFrame([(1, 1), (2, 2)], "u int, t int")
    assert {(r.u, r.t, r.strategy) for r in ranking.fallback_chain([a, b], ["u"], [F.col("t")]).collect()} == {(1, 5, 1), (2, 2, 2)}


def test_sampling_is_repeatable(spark):
    df = spark.range(1000)
    first = sampling.sampled(df, "id", 0.3, 1).collect()
    assert first == sampling.sampled(df.repartition(7), "id", 0.3, 1).orderBy("id").collect() and 200 < len(first) < 400
    assert sampling.hierarchical(df, "id", 3, 0.5, 1).groupBy("level").count().count() == 3
    assert one(spark, sampling.padded_or_cut(F.array(F.lit(1)), 3, 0), sampling.padded_or_cut(F.array(F.lit(1), F.lit(2)), 1, 0)) == ([1, 0, 0], [1])


def test_binary_layouts(spark, tmp_path):
    rows = [(1, 2, 3, [0.5, 1.5, 2.5], [[1, 2, 3, 0.5]]), (4, 5, 6, [0, 0, 0], [])]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a").write_bytes(binary.contacts_to_bytes(rows))
    (tmp_path / "c" / "b").write_bytes(b"")
    got = {r.id: (r.seg_a, r.seg_b, r.com, r.faces) for r in binary.read_contacts(spark, str(tmp_path / "c")).collect()}
    assert got == {1: (2, 3, [0.5, 1.5, 2.5], [[1, 2, 3, 0.5]]), 4: (5, 6, [0, 0, 0], [])}
    (tmp_path / "p").mkdir()
    ids = np.array([2**64 - 2, 7], np.uint64)
    (tmp_path / "p" / "a").write_bytes(binary.points_to_bytes(ids, np.arange(6).reshape(2, 3)))
    assert {int(r.id): (r.x, r.y, r.z) for r in binary.read_points(spark, str(tmp_path / "p")).collect()} == {2**64 - 2: (0, 1, 2), 7: (3, 4, 5)}


def test_chunked_layer(spark, tmp_path):
    root = str(tmp_path / "layer")
    info = chunked.LayerInfo((4.0, 4.0, 40.0), (0, 0, 0), (8, 8, 8), (4, 4, 4), "id long, x double, y double, z double")
    chunked.write_info(spark, root, info)
    with pytest.raises(RuntimeError):
        chunked.write_info(spark, root, chunked.LayerInfo(**{**info.__dict__, "size": (9, 9, 9)}))
    rows = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 17.0, 1.0, 1.0), (3, 31.0, 31.0, 319.0)], info.schema)
    chunked.write_rows(rows, root, ["x", "y", "z"])
    chunked.write_rows(spark.createDataFrame([(9, 2.0, 2.0, 2.0)], info.schema), root, ["x", "y", "z"])  # replaces its chunk alone
    assert sorted(r.id for r in chunked.read_box(spark, root, ["x", "y", "z"], (0, 0, 0), (32, 32, 320)).collect()) == [2, 3, 9]
    assert [r.id for r in chunked.read_box(spark, root, ["x", "y", "z"], (16, 0, 0), (32, 16, 160)).collect()] == [2]
    assert sorted(r.n for r in chunked.chunk_counts(spark, root).collect()) == [0] * 5 + [1] * 3


def test_text_tables_keep_large_ids(spark, tmp_path):
    (tmp_path / "t.csv").write_text("seg_id,score\n18446744073709551614,0.5\n9007199254740993,1\n")
    got = chunked.read_text_table(spark, str(tmp_path / "t.csv"), "seg_id decimal(20,0), score double", "csv").collect()
    assert [int(r.seg_id) for r in got] == [18446744073709551614, 9007199254740993]


def test_relabelling_follows_chains(spark):
    labels = spark.createDataFrame([(i, i) for i in range(6)], "id long, root long")
    moved = spark.createDataFrame([(0, 1, "2024-01-01", "a"), (1, 2, "2024-01-02", "b"), (2, 3, "2024-01-03", "c"), (5, 4, "2024-01-01", "d"), (5, 3, "2024-01-02", "e")], "old_root long, new_root long, ts string, event_id string").withColumn("ts", F.to_timestamp("ts"))
    assert {r.id: r.root for r in edits.relabelled(labels, moved).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 4, 5: 3}


def test_stream_counts_each_event_once(spark, tmp_path):
    edits.start_labels(spark.createDataFrame([(1, 10), (2, 20)], "id long, root long"), str(tmp_path / "labels"))
    (tmp_path / "in").mkdir()
    line = '{"event_id": "%s", "old_root_ids": [%d], "new_root_ids": [%d], "ts": "2024-01-01T00:00:0%d"}\n'
    (tmp_path / "in" / "a.json").write_text(line % ("e1", 10, 30, 1) + line % ("e1", 10, 30, 1) + "broken\n")
    stream = lambda: edits.events(spark, str(tmp_path / "in"))
    edits.run_listener(stream(), str(tmp_path / "labels"), str(tmp_path / "check")).awaitTermination()
    (tmp_path / "in" / "b.json").write_text(line % ("e2", 30, 40, 2))
    edits.run_listener(stream(), str(tmp_path / "labels"), str(tmp_path / "check")).awaitTermination()
    assert {r.id: r.root for r in edits.current_labels(spark, str(tmp_path / "labels")).collect()} == {1: 40, 2: 20}


def test_files(spark, tmp_path):
    (tmp_path / "list.json").write_text("[[1, 2, 3], [4.5, 5, 6]]")
    (tmp_path / "named.json").write_text('{"segments": {"7": {"centroid": [1, 2, 3]}}}')
    (tmp_path / "bad.json").write_text("[[1, 2]]")
    at = lambda name: [tuple(r) for r in files.read_coordinates(spark, str(tmp_path / name)).collect()]
    assert at("list.json") == [(1, 2, 3), (4.5, 5, 6)] and at("named.json") == [(1, 2, 3)]
    with pytest.raises(Exception, match="not three numbers"):
        at("bad.json")
    (tmp_path / "lines.json").write_text('[{"id": "a", "pointA": [1, 2, 3], "pointB": [4, 5, 6]}]')
    assert [(r.id, r.a, r.b) for r in files.read_lines(spark, str(tmp_path / "lines.json")).collect()] == [("a", [1, 2, 3], [4, 5, 6])]
    (tmp_path / "layer.json").write_text('{"resolution": [4, 4, 40], "annotations": [{"point": [1, 2, 3]}, {"type": "axis_aligned_bounding_box", "pointA": [0, 0, 0], "pointB": [1, 1, 1]}]}')
    assert [(r.kind, r.a, r.b) for r in files.read_annotations(spark, str(tmp_path / "layer.json")).collect()] == [("point", [4, 8, 120], [4, 8, 120]), ("axis_aligned_bounding_box", [0, 0, 0], [4, 4, 40])]
    spark.range(3).write.parquet(str(tmp_path / "p1"))
    spark.range(2).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "p2"))
    both = files.read_tables(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")])
    assert both.count() == 5 and both.columns == ["id", "more"]
    assert files.lines_of(spark.createDataFrame([(1, 2, 3, 4)], "k int, x int, y int, z int"), ["x", "y"], ["y", "z"], "k").first().b == [3, 4]


def test_random_numbers_have_their_distributions(spark):
    got = spark.range(20_000).select(augment.uniform(3, F.col("id")).alias("u"), augment.normal(3, 1.0, 2.0, F.col("id")).alias("n")).agg(F.avg("u"), F.stddev("u"), F.avg("n"), F.stddev("n"), F.min("u"), F.max("u")).first()
    assert abs(got[0] - 0.5) < 0.01 and abs(got[1] - 12**-0.5) < 0.01 and abs(got[2] - 1) < 0.05 and abs(got[3] - 2) < 0.05 and got[4] >= 0 and got[5] < 1
    orders = [[r.id for r in datasets.epoch_order(spark.range(50), "id", 1, e).orderBy("order").collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[2]) == list(range(50))
    noisy = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]])], "k int, p array<array<double>>").select(augment.noisy(F.col("p"), 0.1, 2, F.col("k")).alias("q")).first().q
    assert all(0 < abs(x - y) < 0.6 for a, b in zip(noisy, [[1, 2], [3, 4]]) for x, y in zip(a, b))
    rows = docstore.annotation_rows(spark.createDataFrame([("a", ["t", "t"]), ("a", ["t"]), ("b", [])], "name string, tags array<string>"), F.col("name"))
    assert sorted((r.name, r.tags) for r in rows.collect()) == [("a", ["t"]), ("b", [])]
