"""Copies of points, and layers whose chunks, shards and cells are larger than what a task may hold."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lattica.operators import annotations, matching
from lattica.plans import fields, relational
from lattica.sources import datasource, shards


def line_items(n, copies, seed=3):
    """Line items at few places, some ids at several of them; copies have ids and suppliers of their own."""
    rng = np.random.default_rng(seed)
    one = pd.DataFrame({"l_orderkey": rng.integers(0, n * 2 // 3, n), "l_linenumber": rng.integers(1, 8, n).astype("int32"), "l_suppkey": rng.integers(0, 100, n), "l_partkey": rng.integers(0, 50, n), "l_extendedprice": rng.integers(0, n, n) * 4.0, "l_quantity": rng.integers(1, 4, n) * 1.0, "l_discount": rng.integers(0, 3, n) / 100, "l_tax": rng.integers(0, 9, n) / 100})
    return pd.concat([one.assign(l_orderkey=one.l_orderkey + k * n, l_suppkey=one.l_suppkey + 100 * k) for k in range(copies)])


def test_transported_equals_copies_of_points():
    """Amounts of classes against the assignment of all their members."""
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 2), (4, 4), (6, 5)):
        for _ in range(40):
            at = np.argwhere(rng.random((n, m)) < 0.5)
            if not len(at):
                continue
            rows, cols = (np.unique(at[:, k], return_inverse=True)[1] for k in (0, 1))
            cost, supply, demand = rng.integers(0, 20, len(at)).astype(float), rng.integers(1, 5, n)[rows], rng.integers(1, 5, m)[cols]
            got = matching.transported(rows, cols, cost, supply, demand)
            assert (np.bincount(rows, got) <= np.bincount(rows, supply) / np.bincount(rows)).all() and (np.bincount(cols, got) <= np.bincount(cols, demand) / np.bincount(cols)).all()
            every = [(r * 9 + i, c * 9 + j, x) for r, c, x, s, d in zip(rows, cols, cost, supply, demand) for i in range(s) for j in range(d)]
            a, b = (np.unique([e[k] for e in every], return_inverse=True)[1] for k in (0, 1))
            price = np.array([e[2] for e in every])
            want = matching.assignment(a, b, price)
            assert got.min() >= 0 and (got.sum(), (got * cost).sum()) == (len(want), price[want].sum())


def test_copies_are_matched_as_classes(spark, tmp_path, monkeypatch):
    """Four copies of all points: four times the matches, from as many candidate pairs as of one copy (q48)."""
    pairs, real = [], matching.matched
    monkeypatch.setattr(matching, "matched", lambda df: pairs.append(df.count()) or real(df))
    got = []
    for copies in (1, 4):
        at = tmp_path / str(copies)
        at.mkdir()
        line_items(600, copies).to_parquet(at / "lineitem.parquet")
        got.append(relational.q48_match_scores(spark, str(at)).first())
    a, b = relational._sides(spark, str(tmp_path / "1"))
    plain = relational._pairs(spark, str(tmp_path / "1")).select("id", "id_r", "dist").toPandas()
    rows, cols = (np.unique(plain[c], return_inverse=True)[1] for c in ("id", "id_r"))
    tp = len(matching.assignment(rows, cols, plain["dist"].to_numpy()))
    assert tuple(got[0])[:3] == (tp, a.count() - tp, b.count() - tp) and tp > 50
    assert tuple(got[1])[:3] == tuple(4 * x for x in tuple(got[0])[:3])
    assert pairs[0] == pairs[1] > 50


def test_copies_are_counted_once(spark, tmp_path, monkeypatch):
    """Four copies of all points (q173): each repeated place counts once, as in a walk over all points, from as many pairs as of one copy."""
    pairs, chosen, real = [], [], matching.matched
    monkeypatch.setattr(matching, "matched", lambda df: pairs.append(df.count()) or chosen.append(real(df).toPandas()) or spark.createDataFrame(chosen[-1]))
    got = []
    for copies in (1, 4):
        at = tmp_path / str(copies)
        at.mkdir()
        items = line_items(200, copies, 5)
        items.to_parquet(at / "lineitem.parquet")
        got.append(fields.q173_dedup_scores(spark, str(at)).first().asDict())
    assert pairs[0] == pairs[1] > 20
    assert all(got[1][k] == 4 * got[0][k] for k in ("tp", "fp", "fn")) and got[0]["tp"] > 20
    p = items.assign(id=items.l_orderkey * 8 + items.l_linenumber, x=items.l_extendedprice, y=items.l_quantity * 10, z=items.l_discount * 1000, key=items.l_linenumber % 3, side=items.l_suppkey % 2)
    p = p.sort_values(["id", "x", "y", "z", "key", "side"]).drop_duplicates("id")
    for side, column, names in ((0, "a", ("dup_tp", "dup_fp")), (1, "b", ("dup_fn_matched", "dup_fn_unmatched"))):
        own = p[p.side == side]
        place = {r.id: (r.x, r.y, r.z, r.key) for r in own.itertuples()}
        left, hit = chosen[1].groupby(column)["n"].sum().to_dict(), set()
        left = {place[k]: n for k, n in left.items()}
        for i in reversed(sorted(place)):  # which members are matched makes no difference
            if left.get(place[i], 0):
                left[place[i]] -= 1
                hit.add(i)
        near = lambda i, j: place[i][3] == place[j][3] and sum((u - v) ** 2 for u, v in zip(place[i][:3], place[j][:3])) < 625
        own = [i for i in sorted(place) if place[i][3]]
        again = {i for i in own if i not in hit and any(j in hit and near(i, j) for j in own)}
        kept = []
        for i in own:
            if i not in hit and i not in again and not any(near(i, j) for j in kept):
                kept.append(i)
        assert tuple(got[1][n] for n in names) == (len(again), len(own) - len(hit & set(own)) - len(again) - len(kept))


def test_contact_shards_are_written_and_read_in_pieces(tmp_path, monkeypatch):
    """One chunk of many rows: what a writer or reader holds doesn't grow with it (q171)."""
    monkeypatch.setattr(datasource, "HELD_BYTES", 1 << 17)
    rng, path = np.random.default_rng(6), str(tmp_path / "layer")

    def batches(n):
        for k in range(n):
            faces = [None if i % 5 == 0 else [[float(i), 1.0, 2.0, 0.5]] * (i % 3) for i in range(500)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(500) + 500 * k), pa.array(np.full(500, k)), pa.array(np.full(500, 3)), *(pa.array(rng.uniform(0, 10, 500)) for _ in range(3)), pa.array(faces, datasource._ARROW.field("faces").type)], schema=datasource._ARROW)

    peaks = []
    for n in (30, 240):
        writer = datasource.ContactWriter(path, [10.0, 10.0, 10.0], True)
        tracemalloc.start()
        said = writer.write(batches(n))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        writer.commit([said])
    assert peaks[1] < 1.3 * peaks[0]
    reader = datasource.ContactReader(path)
    parts = reader.partitions()
    got = [b for p in parts for b in reader.read(p)]
    assert len(got) > 20 and max(b.nbytes for b in got) < 1 << 19
    rows = pa.Table.from_batches(got).sort_by("id").to_pylist()
    assert [r["id"] for r in rows] == list(range(120_000)) and all(r["faces"] == ([[float(i % 500), 1.0, 2.0, 0.5]] * (i % 500 % 3) if i % 5 else []) and r["seg_a"] == i // 500 for i, r in enumerate(rows))


def test_large_chunks_are_dealt_to_several_tasks(spark):
    """A chunk with most of the rows doesn't lie in one task."""
    df = spark.range(200_000).selectExpr("id", "id as seg_a", "id as seg_b", "1.0d as x", "2.0d as y", "id % 3 as z", "array(array(1.0, 2.0, 3.0, rand(1))) as faces")
    held = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        sizes = datasource.dealt(df, (10, 10, 10)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", held)
    assert sum(sizes) == 200_000 and max(sizes) < 150_000


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_shard_files_in_parts(spark, tmp_path, monkeypatch, few):
    """The blocks of a shard are the file that one task would encode, and no row holds a whole shard (q135)."""
    monkeypatch.setattr(shards, "FEW_PARTS", few)
    rng = np.random.default_rng(7)
    rows = [(int(i), None if i % 11 == 0 else bytes([i % 251]) * int(i % 9)) for i in rng.permutation(150_000)] + [(2**40 + 16 * i, bytes([i]) * 700_000) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, data binary").repartition(3)
    files = shards.write_shards(df, str(tmp_path / "s"), "id", "data", 1, 2, 1)
    assert files.agg({"n_chunks": "sum"}).first()[0] == len(rows)
    blocks = shards.file_blocks(spark, str(tmp_path / "s")).toPandas()
    assert blocks["bytes"].map(len).max() <= shards.PART_BYTES + 700_000
    for s, own in blocks.sort_values("at").groupby("shard"):
        assert (own["at"] == own["bytes"].map(len).cumsum().shift(fill_value=0)).all()
        mine = sorted((i >> 1 & 3, i, d or b"") for i, d in rows if i >> 3 & 1 == s)
        mini, ids, data = zip(*mine)
        raw = b"".join(own["bytes"])
        assert raw == shards.encoded(np.array(mini), np.array(ids), list(data), 2)
        assert list(shards.decoded(raw, 2)) == mine
    assert sorted((r.id, bytes(r.data)) for r in shards.read_shards(spark, str(tmp_path / "s"), 2).collect()) == sorted((i, d or b"") for i, d in rows)
    assert [f.name for f in tmp_path.iterdir()] == ["s"]
    assert shards.write_shards(df.limit(0), str(tmp_path / "e"), "id", "data", 1, 2, 1).count() == shards.read_shards(spark, str(tmp_path / "e"), 2).count() == 0


def test_runs_do_not_hold_a_shard():
    """What is held while the runs of one minishard are cut doesn't grow with it."""
    peaks = []
    for n in (20, 160):
        tracemalloc.start()
        batches = (pa.RecordBatch.from_arrays([pa.array(np.zeros(5000, np.int64)), pa.array(np.zeros(5000, np.int64)), pa.array(np.arange(5000) + 5000 * k), pa.array([b"abc"] * 5000)], names=["shard", "mini", "id", "data"]) for k in range(n))
        assert sum(sum(b.column("n").to_pylist()) for b in shards._runs(batches)) == 5000 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + (8 << 20)


def test_replaced_cell_checkpoints_little(spark, tmp_path, monkeypatch):
    """Annotations of a cell changed, moved in from elsewhere, added and removed: all readers and cells follow, and no copy of the layer
    is checkpointed (q134)."""
    held, real = [], annotations.checkpointed
    monkeypatch.setattr(annotations, "checkpointed", lambda df: held.append(df.count()) or real(df))
    rng = np.random.default_rng(8)
    bounds, sizes = [("x0", "x1"), ("y0", "y1"), ("z0", "z1")], [(64, 64, 1), (16, 8, 1)]
    model = {i: (float(x), float(x + w), float(y), float(y + h), 0.0, 0.0) for i, (x, y, w, h) in enumerate(zip(rng.integers(0, 120, 900), rng.integers(0, 60, 900), rng.integers(0, 20, 900), rng.integers(0, 9, 900)))}
    model[900] = (130.0, 131.0, 130.0, 131.0, 0.0, 0.0)  # alone in its cells
    schema = "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"
    path = str(tmp_path / "layer")
    annotations.write_layer(spark.createDataFrame([(k, *v) for k, v in model.items()], schema).repartition(3), path, bounds, sizes)
    in_cell = lambda v, c: all(int(v[2 * k] // s) <= i <= int(v[2 * k + 1] // s) for k, (i, s) in enumerate(zip(c, sizes[1])))
    far = [i for i, v in model.items() if v[0] > 100][:3]
    fresh = [(2000, 20.0, 40.0, 3.0, 9.0, 0.0, 0.0), (2001, 500.0, 501.0, 3.0, 4.0, 0.0, 0.0), *((i, 17.0, 18.0, 1.0, 2.0, 0.0, 0.0) for i in far)]
    for cell, added, keep in (((1, 0, 0), fresh, 2), ((8, 16, 0), [], 7), ((3, 2, 0), [], 3)):
        annotations.replace_cell(spark, path, bounds, 1, cell, sizes[1], lambda old: old.where(f"id % {keep} = 0").unionByName(spark.createDataFrame(added, schema)))
        model = {i: v for i, v in model.items() if not in_cell(v, cell) or i % keep == 0}
        model |= {r[0]: r[1:] for r in added if in_cell(r[1:], cell)}
        want = sorted((k, *v) for k, v in model.items())
        for got in (annotations.read_all(spark, path), annotations.read_by_id(spark, path)):
            assert sorted(map(tuple, got.select(*schema.replace(",", "").split()[::2]).collect())) == want
        index = annotations.spatial_index(spark.createDataFrame(want, schema), bounds, sizes).select("level", "cx", "cy", "cz", "id")
        assert sorted(map(tuple, spark.read.parquet(f"{path}/spatial").select(index.columns).collect())) == sorted(map(tuple, index.collect()))
    assert 900 not in model and 2000 in model and not (tmp_path / "layer/spatial/level=1/cx=8/cy=16").joinpath("cz=0").exists()
    assert max(held) < 100 < len(model) and not list((tmp_path / "layer").glob("_aside*"))
