"""Layers with commits: all tables at once, versions, conflicts, failed writes, compaction."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.sources import annotation_layer as al
from lattica.sources import arrays, commits

BOUNDS = [("x0", "x1"), ("y0", "y1"), ("z0", "z1")]
SCHEMA = "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, tags array<long>"


def boxes(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b), 0.0, 0.0, 0.0, 0.0, t) for i, a, b, t in rows], SCHEMA)


def made(spark, tmp_path, rows):
    layer = al.AnnotationLayer(str(tmp_path / "layer"), BOUNDS, [(64, 8, 8), (16, 8, 8)], "tags")
    al.created(layer, boxes(spark, rows))
    return layer


def seen(spark, layer, version=None):
    """What every reader finds; they must agree."""
    reads = [al.read_by_id(spark, layer, None, version), *(al.read_all(spark, layer, k, version) for k in (0, 1)), al.read_box(spark, layer, [(-1000, 1000)] * 3, 1, version)]
    found = [sorted((r["id"], r["x0"], r["x1"]) for r in df.collect()) for df in reads]
    assert all(f == found[0] for f in found)
    return found[0]


FOUR = [(1, 0, 5, [7, 7]), (2, 10, 40, [7, 8]), (3, 100, 110, None), (4, 20, 30, [])]


def test_replaced_cell_changes_every_reader(spark, tmp_path):
    layer = made(spark, tmp_path, [*FOUR, (1, 1, 9, [9]), (None, 0, 1, [3])])
    assert seen(spark, layer) == [(1, 0, 5), (2, 10, 40), (3, 100, 110), (4, 20, 30)]
    assert al.replaced_cell(spark, layer, 1, (1, 0, 0), lambda old: old.where("id <> 2").withColumn("x1", F.lit(70.0))) == 2
    assert seen(spark, layer) == [(1, 0, 5), (3, 100, 110), (4, 20, 70)]
    assert {(r[0], tuple(r[1])) for r in al.read_related(spark, layer).collect()} == {(7, (1,))}
    assert seen(spark, layer, 1) == [(1, 0, 5), (2, 10, 40), (3, 100, 110), (4, 20, 30)]
    al.replaced_cell(spark, layer, 1, (6, 0, 0), None)
    assert seen(spark, layer) == [(1, 0, 5), (4, 20, 70)]
    assert sorted(r["id"] for r in al.read_box(spark, layer, [(64, 80), (0, 0), (0, 0)], 0).collect()) == [4]
    assert {r["level"]: (r["n_cells"], r["most"]) for r in al.limits(spark, layer).collect()} == {0: (2, 2), 1: (5, 1)}


def test_bounds_of_a_cell(spark, tmp_path):
    layer = made(spark, tmp_path, FOUR)
    out = lambda old: old.where("id = 4").withColumns({"x0": F.lit(200.0), "x1": F.lit(210.0)})
    al.replaced_cell(spark, layer, 1, (1, 0, 0), out)
    assert seen(spark, layer) == [(1, 0, 5), (3, 100, 110)]
    al.changed(layer, boxes(spark, FOUR))
    al.replaced_cell(spark, layer, 1, (1, 0, 0), out, filter_bounds=False)
    assert seen(spark, layer) == [(1, 0, 5), (3, 100, 110), (4, 200, 210)]


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng = np.random.default_rng(5)
    layer, held, history = made(spark, tmp_path, FOUR), {i: (i, float(a), float(b)) for i, a, b, _ in FOUR}, {}
    history[1] = sorted(held.values())
    for _ in range(2):
        new = {int(i): (int(i), float(a), float(a + w)) for i, a, w in zip(rng.integers(0, 9, 3), rng.integers(-90, 90, 3), rng.integers(0, 60, 3))}
        gone = [int(i) for i in rng.integers(0, 12, 2) if int(i) not in new]
        version = al.changed(layer, boxes(spark, [(*v, [v[0]]) for v in new.values()]), spark.createDataFrame([(i,) for i in gone], "id long"))
        held = {i: v for i, v in (held | new).items() if i not in gone}
        history[version] = sorted(held.values())
    for version, want in history.items():
        assert seen(spark, layer, version) == want
    last = al.compacted(spark, layer)
    assert seen(spark, layer) == history[last - 1]
    assert commits.expired(spark, layer.path) == 3
    assert seen(spark, layer) == history[last - 1]
    with pytest.raises(ValueError, match="no version 1"):
        al.read_all(spark, layer, 0, 1)


def test_second_writer_and_failed_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    commits.commit(spark, path, {"t": rows}, ["k"], None, 0)
    with pytest.raises(commits.Conflict):
        commits.commit(spark, path, {"t": rows}, ["k"], rows, 0)
    with pytest.raises(ValueError, match="table t"):
        commits.commit(spark, path, {"t": rows.withColumn("w", F.lit(1))}, ["k"], rows, 1)
    broken = rows.withColumn("k", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):  # the rows are written, the touched keys are not
        commits.commit(spark, path, {"t": rows}, ["k"], broken, 1)
    assert commits.latest(spark, path) == 1 and commits.read(spark, path, "t", ["k"]).count() == 3
    with pytest.raises(commits.Conflict):  # both saw version 1, one marker is there first
        commits._marked(spark, path, {"version": 1, "folder": "x", "whole": True})
    assert len([f for f in os.listdir(f"{path}/commits") if not f.startswith((".", "_"))]) == 1
    # a null key is touched like any other
    commits.commit(spark, path, {"t": rows.where("k = 1").withColumn("v", F.lit("z"))}, ["k"], rows.where("k is null or k = 1"), 1)
    assert sorted(tuple(r) for r in commits.read(spark, path, "t", ["k"]).collect()) == [(1, "z"), (2, "b")]
    assert commits.expired(spark, path) == 1  # the folder of the failed commit


def test_empty_layers(spark, tmp_path):
    layer = made(spark, tmp_path, [])
    assert seen(spark, layer) == []
    al.changed(layer, boxes(spark, FOUR[:1]))
    assert seen(spark, layer) == [(1, 0, 5)]
    with pytest.raises(ValueError, match="no commit"):
        commits.read(spark, str(tmp_path / "none"), "t", ["k"])


def test_array_commits(spark, tmp_path):
    path, chunk = str(tmp_path / "a"), (2, 2, 1)
    rows = spark.createDataFrame([(x, y, 0, x * 10 + y + 1) for x in range(4) for y in range(4)], "x long, y long, z long, v long")
    at = lambda version=None: {(r["x"], r["y"]): r["v"] for r in arrays.cutout(arrays.version_chunks(spark, path, version), ((0, 4), (0, 4), (0, 1)), chunk).collect()}
    arrays.commit_chunks(rows, path, chunk)
    arrays.commit_chunks(rows.where("x < 2 and y < 2").withColumn("v", F.lit(0).cast("long")), path, chunk, delete_empty=True)
    assert len(at(1)) == 16 and len(at()) == 12 and min(at()) == (0, 2)
    arrays.delete_chunks(spark, path, spark.createDataFrame([(1, 1, 0), (9, 9, 9)], "cx int, cy int, cz int"))
    assert len(at()) == 8
    arrays.compact_chunks(spark, path)
    assert len(at()) == 8 and len(at(2)) == 12
    assert arrays.version_chunks(spark, path, None, ((0, 2), (0, 4), (0, 1)), chunk).count() == 1
    with pytest.raises(Exception, match="negative value"):
        arrays.commit_chunks(rows.withColumn("v", -F.col("v")), path, chunk, unsigned=True)
    assert commits.latest(spark, path) == 4


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    layer = made(spark, tmp_path, FOUR)
    al.changed(layer, boxes(spark, FOUR[:1]))
    al.read_box(spark, layer, [(0, 10), (0, 1), (0, 1)], 1).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(cx,0)" in plan and "EqualTo(level,1)" in plan
