"""Queries of components by blocks, distances, resampling and ordered edits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import scalar
from ..operators import annotations, blocks, distance, docstore, grids, matching, resample, sampling
from ..session import checkpointed
from ..sources import chunked, datasource
from ..streaming import ordered
from .flows import scratch, stream_of
from .layers import _LINES as LINES
from .layers import _lines as layer_lines
from .layers import _stored as stored
from .volume import VOXELS, voxels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _components_sql(near: str) -> str:
    return f"""WITH RECURSIVE v AS (SELECT * FROM ({VOXELS}) WHERE label <> 0), sym AS (SELECT a.node AS a, b.node AS b FROM v a JOIN v b ON a.label = b.label AND a.node <> b.node AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND {near}),
        r AS (SELECT node, node AS low FROM v UNION SELECT sym.b, r.low FROM r JOIN sym ON sym.a = r.node WHERE r.low < sym.b)
        SELECT v.x, v.y, v.z, v.label, v.node, min(low) AS component FROM r JOIN v USING (node) GROUP BY ALL"""


@query(_components_sql("abs(a.z - b.z) <= 1"))
def q165_components_26(spark, d):
    return blocks.voxel_components(voxels(spark, d), (4, 4, 4), 26)


@query(_components_sql("a.z = b.z"))
def q166_components_8(spark, d):
    """Components of each slice."""
    return blocks.voxel_components(voxels(spark, d), (4, 4, 64), 8)


@query(_components_sql("abs(a.z - b.z) <= 1 AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"))
def q167_components_6(spark, d):
    return blocks.voxel_components(voxels(spark, d), (5, 3, 8), 6)


@query(f"WITH v AS ({VOXELS}) SELECT a.x, a.y, a.z, b.label AS other, abs(a.x - b.x) + abs(a.y - b.y) AS distance FROM v a JOIN v b ON a.z = b.z AND a.label <> b.label WHERE a.label <> 0 AND b.label <> 0 QUALIFY row_number() OVER (PARTITION BY a.x, a.y, a.z ORDER BY distance, b.y, b.x) = 1")
def q168_nearest_other_label(spark, d):
    return distance.nearest_other_label(voxels(spark, d))


_REGIONS = f"SELECT DISTINCT z AS part, x, y FROM ({VOXELS}) WHERE label <> 3"


def _regions(spark, d):
    return voxels(spark, d).where("label <> 3").select(F.col("z").alias("part"), "x", "y")


@query(f"""WITH c AS ({_REGIONS}), e AS (SELECT c.*, (SELECT count(*) FROM c n WHERE n.part = c.part AND abs(n.x - c.x) + abs(n.y - c.y) = 1) < 4 AS edge FROM c),
    f AS (SELECT a.part, a.x, a.y, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d2 FROM e a JOIN e b ON a.part = b.part AND b.edge GROUP BY ALL)
    SELECT part, x, y, sqrt(d2) AS distance FROM f QUALIFY row_number() OVER (PARTITION BY part ORDER BY d2 DESC, x, y) = 1""")
def q169_poles(spark, d):
    """The innermost cell of each slice's foreground."""
    return distance.poles(_regions(spark, d), ["part"])


_EDITS = """e AS (SELECT event_id AS eid, CAST(event_id AS VARCHAR) AS name, ts, user_id AS u FROM events),
    n AS (SELECT CAST(NULL AS BIGINT) AS id, u % 40 AS old, 1000 + eid % 7 AS new, ts, name FROM e WHERE eid % 3 = 0 UNION ALL SELECT NULL, 1000 + eid % 7, 2000 + eid, ts, name FROM e WHERE eid % 3 = 1
        UNION ALL SELECT u + k, 1000 + eid % 7, 5000000 + eid + k, ts, name FROM e, generate_series(0, 2) t(k) WHERE eid % 3 = 2)"""


@query(f"""WITH RECURSIVE {_EDITS}, r AS (SELECT c_custkey AS id, c_custkey % 40 AS root, TIMESTAMP '0001-01-01' AS ts, '' AS name FROM customer
    UNION ALL SELECT id, new, ts, name FROM (SELECT r.id, n.new, n.ts, n.name, row_number() OVER (PARTITION BY r.id ORDER BY n.ts, n.name) AS k FROM r JOIN n ON n.old = r.root AND (n.id IS NULL OR n.id = r.id) AND (n.ts > r.ts OR (n.ts = r.ts AND n.name > r.name))) WHERE k = 1)
    SELECT id, arg_max(root, ts) AS root FROM r GROUP BY id""")
def q170_merges_and_splits(spark, d):
    """A stream of merges and splits applied in the order of their events."""
    e = stream_of(spark, d, "events")
    k, u = F.col("event_id"), F.col("user_id")
    first, second = 1000 + k % 7, k % 3 == 2
    assigned = F.array(*[F.struct((u + i).cast("long").alias("id"), (5000000 + k + i).cast("long").alias("root")) for i in range(3)])
    edits = e.select(k.cast("string").alias("event_id"), F.array(F.when(k % 3 == 0, u % 40).otherwise(first).cast("long")).alias("old_root_ids"), F.when(k % 3 == 0, F.array(first.cast("long"))).when(k % 3 == 1, F.array((2000 + k).cast("long"))).otherwise(F.array((5000000 + k).cast("long"), (5000001 + k).cast("long"))).alias("new_root_ids"), F.col("ts").cast("timestamp").alias("ts"), F.when(second, assigned).alias("assigned"))
    root = scratch(spark)
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_custkey") % 40).cast("long").alias("root"))
    ordered.start(c, f"{root}/state")
    ordered.run_ordered_listener(edits, f"{root}/state", f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return ordered.ordered_labels(spark, f"{root}/state")


@query("""SELECT seg_a, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(x + y + z) AS BIGINT) AS places FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey % 20 AS seg_a, l_quantity AS x, round(l_discount * 100, 0) AS y, round(l_tax * 100, 0) AS z FROM lineitem)
    WHERE x >= 12 AND x < 30 AND y <= 5 AND z > 2 GROUP BY seg_a""")
def q171_contact_shards(spark, d):
    """Contacts written to shard files and read back by box through the data source."""
    datasource.register(spark)
    li = table(spark, d, "lineitem")
    x, y, z = F.col("l_quantity"), F.round(F.col("l_discount") * 100, 0), F.round(F.col("l_tax") * 100, 0)
    rows = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 20).cast("long").alias("seg_a"), (F.col("l_partkey") % 20).cast("long").alias("seg_b"), x.alias("x"), y.alias("y"), z.alias("z"), F.array(F.array(x, y, z, F.col("l_discount"))).alias("faces"))
    at = f"{scratch(spark)}/contacts"
    datasource.dealt(rows, (16, 4, 4)).write.format(datasource.FORMAT).option("chunk", "16,4,4").mode("append").save(at)
    back = spark.read.format(datasource.FORMAT).load(at).where("x >= 12 AND x < 30 AND y <= 5 AND z > 2")
    return back.groupBy("seg_a").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum(F.col("x") + F.col("y") + F.col("z")).cast("long").alias("places"))


_LEFT = f"NOT (floor(x0 / 16) <= 1 AND floor(x1 / 16) >= 1 AND floor(y0 / 4) <= 0 AND floor(y1 / 4) >= 0) OR id % 2 = 0"


@query(f"WITH b AS (SELECT DISTINCT * FROM ({LINES})) SELECT id, x0, reader FROM b, (VALUES ('all'), ('id'), ('level 1')) r(reader) WHERE {_LEFT}")
def q172_annotations_of_all_readers(spark, d):
    """One cell written again with half of its annotations: the others are gone on every level and from the index by id."""
    path = stored(spark, d)
    bounds = [("x0", "x1"), ("y0", "y1"), ("z0", "z1")]
    annotations.replace_cell(spark, path, bounds, 1, (1, 0, 0), (16, 4, 1), lambda old: old.where("id % 2 = 0"))
    deepest = spark.read.parquet(f"{path}/spatial").where("level = 1").dropDuplicates(["id"])
    out = annotations.read_all(spark, path).select("id", "x0", F.lit("all").alias("reader"))
    for df, name in ((annotations.read_by_id(spark, path), "id"), (deepest, "level 1")):
        out = out.unionByName(df.select("id", "x0", F.lit(name).alias("reader")))
    return out


@query()
def q173_dedup_scores(spark, d):
    """Line items of odd and even suppliers matched within a radius and a key, repeats counted once; tests hold it against brute force.

    Of several line items of one id the first in the order of place, key and side counts.
    """
    li, axes = table(spark, d, "lineitem"), ["x", "y", "z"]
    p = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.struct(F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 10).alias("y"), (F.col("l_discount") * 1000).alias("z"), (F.col("l_linenumber") % 3).alias("key"), (F.col("l_suppkey") % 2).alias("side")).alias("p"))
    both = checkpointed(matching.alike(p.groupBy("id").agg(F.min("p").alias("p")).select("id", "p.*").where("side in (0, 1)"), [*axes, "key"], ["side"]))
    a, b = (both.where(F.col("side") == s).drop("side") for s in (0, 1))
    matches = checkpointed(matching.matched(matching.alike_pairs(a, b, 25.0, axes, ["key"])))
    return matching.deduplicated_alike_scores(a, b, matches, 25.0, axes, ["key"])


@query(f"""WITH v AS ({VOXELS}), wx AS (SELECT o, least(floor(pos) + k, 9) AS i, sum(CASE k WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END) AS w FROM (SELECT o, greatest((o + 0.5) * 10 / 7 - 0.5, 0) AS pos FROM range(7) r(o)), (VALUES (0), (1)) t(k) GROUP BY ALL),
    wy AS (SELECT o, i, 1 / (ceil((o + 1) * 10 / 4) - floor(o * 10 / 4)) AS w FROM range(4) r(o), range(10) s(i) WHERE i >= floor(o * 10 / 4) AND i < ceil((o + 1) * 10 / 4))
    SELECT wx.o AS x, wy.o AS y, z, round(sum(v * wx.w * wy.w) + 1e-9, 6) AS v FROM v JOIN wx ON wx.i = x JOIN wy ON wy.i = y GROUP BY ALL""")
def q174_resampled(spark, d):
    """Slices of ten by ten brought to seven by four: linear along x, by area along y."""
    v = voxels(spark, d).select("x", "y", "z", "v")
    both = resample.resampled(resample.resampled(v, {"x": 10}, {"x": 7}), {"y": 10}, {"y": 4}, "area")
    return both.withColumn("v", F.round(F.col("v") + 1e-9, 6))


@query(f"""WITH v AS ({VOXELS}), a AS (SELECT o, o * 9.0 / 22 AS pos FROM range(23) r(o)), t AS (SELECT o, floor(pos) AS low, pos - floor(pos) AS t FROM a),
    w AS (SELECT o, least(greatest(low + k, 0), 9) AS i, sum(CASE WHEN k IN (0, 1) THEN ((1.25 * u - 2.25) * u * u + 1) ELSE ((-0.75 * u + 3.75) * u - 6) * u + 3 END) AS w FROM (SELECT *, abs(t - k) AS u FROM t, (VALUES (-1), (0), (1), (2)) s(k)) GROUP BY ALL)
    SELECT w.o AS y, x, z, round(sum(v * w) + 1e-9, 6) AS v FROM v JOIN w ON w.i = y GROUP BY ALL""")
def q175_resampled_cubic(spark, d):
    """Rows of ten brought to twenty-three with the cubic kernel, corners kept."""
    v = voxels(spark, d).select("x", "y", "z", "v")
    return resample.resampled(v, {"y": 10}, {"y": 23}, "cubic", corners=True).withColumn("v", F.round(F.col("v") + 1e-9, 6))


@query(f"""WITH v AS (SELECT x, y, z, CAST(floor(v) AS BIGINT) % 256 AS v FROM ({VOXELS})), c AS (SELECT z, x // 5 AS tx, y // 5 AS ty, v AS bin, count(*) AS n FROM v GROUP BY ALL), a AS (SELECT z, tx, ty, sum(n) AS area FROM c GROUP BY ALL),
    f AS (SELECT a.*, b.bin, coalesce(n, 0) AS n, greatest(floor(40 * area / 256), 1) AS most FROM a CROSS JOIN range(256) b(bin) LEFT JOIN c USING (z, tx, ty, bin)),
    o AS (SELECT *, greatest(n - most, 0) AS over, sum(greatest(n - most, 0)) OVER (PARTITION BY z, tx, ty) AS spare FROM f),
    l AS (SELECT *, least(round_even(sum(n - over + floor(spare / 256) + CASE WHEN spare % 256 > 0 AND bin % greatest(floor(256 / greatest(spare % 256, 1)), 1) = 0 AND bin / greatest(floor(256 / greatest(spare % 256, 1)), 1) < spare % 256 THEN 1 ELSE 0 END) OVER (PARTITION BY z, tx, ty ORDER BY bin) * 255.0 / area, 0), 255) AS level FROM o),
    s AS (SELECT v.*, least(greatest(floor(x / 5 - 0.5) + i, 0), 1) AS tx, least(greatest(floor(y / 5 - 0.5) + j, 0), 1) AS ty, (CASE i WHEN 1 THEN x / 5 - 0.5 - floor(x / 5 - 0.5) ELSE 1 - (x / 5 - 0.5 - floor(x / 5 - 0.5)) END) * (CASE j WHEN 1 THEN y / 5 - 0.5 - floor(y / 5 - 0.5) ELSE 1 - (y / 5 - 0.5 - floor(y / 5 - 0.5)) END) AS w FROM v, range(2) p(i), range(2) q(j))
    SELECT x, y, s.z, CAST(CASE WHEN v = 0 THEN 0 ELSE round_even(round(sum(level * w), 9), 0) END AS INTEGER) AS v FROM s JOIN l ON l.z = s.z AND l.tx = s.tx AND l.ty = s.ty AND l.bin = s.v GROUP BY x, y, s.z, v""")
def q176_equalised_tiles(spark, d):
    """Adaptive equalisation of every slice, two by two tiles."""
    v = voxels(spark, d).select("x", "y", "z", (F.floor("v") % 256).alias("v"))
    return resample.equalised_tiles(v, ["z"], (10, 10), (2, 2), 40.0)


_T3 = {"x": (4, 1), "y": (5, 2), "z": (3, 1)}


def _blend3_sql() -> str:
    end = {"x": "10", "y": "10", "z": "(SELECT max(z) + 1 FROM v)"}
    chunk = lambda a: f"{a}c AS (SELECT i AS c_{a}, i = 0 AS low_{a}, (i + 1) * {_T3[a][0]} >= {end[a]} AS high_{a} FROM generate_series(0, (SELECT max({a}) FROM v)) t(i) WHERE i * {_T3[a][0]} < {end[a]})"
    t = {a: (f"(({a} + 0.5 - (c_{a} * {s} - {o})) / {2 * o})", f"((c_{a} * {s} + {s} + {o} - ({a} + 0.5)) / {2 * o})") for a, (s, o) in _T3.items()}
    ramp = lambda u: f"(CASE WHEN {u} < 0.5 THEN 2 * {u} * {u} ELSE 1 - 2 * (1 - {u}) * (1 - {u}) END)"
    weight = " * ".join(f"(CASE WHEN {side}_{a} OR {u} >= 1 THEN 1.0 ELSE {ramp(u)} END)" for a in _T3 for side, u in zip(("low", "high"), t[a]))
    joins = " ".join(f"JOIN {a}c ON {a} >= c_{a} * {s} - {o} AND {a} < c_{a} * {s} + {s} + {o}" for a, (s, o) in _T3.items())
    return f"WITH v AS ({VOXELS}), {', '.join(chunk(a) for a in _T3)}, w AS (SELECT x, y, z, sum({weight} * v * (1 + (c_x + c_y + c_z) % 2)) AS t FROM v {joins} GROUP BY ALL) SELECT x, y, z, CAST(round_even(round(t, 9), 0) AS BIGINT) AS value FROM w"


@query(_blend3_sql())
def q177_blend_three_axes(spark, d):
    """Overlapping chunks of the volume blended along all axes, rounded half to even."""
    v = voxels(spark, d)
    top = v.agg(F.max("z")).first()[0]
    axes = {a: (s, o, 0, 10 if a != "z" else (0 if top is None else top + 1)) for a, (s, o) in _T3.items()}
    rows = grids.overlapped_on(v.select("x", "y", "z", "v"), axes)
    out = grids.blend_on(rows, axes, F.col("v") * (1 + (F.col("c_x") + F.col("c_y") + F.col("c_z")) % 2), "quadratic", whole=True)
    return out.withColumn("value", F.col("value").cast("long"))


_DOCS = """e AS (SELECT user_id AS u, event_id AS k, event_type AS t FROM events),
    have AS (SELECT u, t || '.p' || (k % 3) || '.q' || (k % 4) AS path, max(k) AS value FROM e GROUP BY ALL),
    new AS (SELECT DISTINCT ON (u, path) * FROM (SELECT u, CASE WHEN u % 2 = 0 THEN t || '.p1' ELSE t || '.p2.q1.r' END AS path, max(k) AS value FROM e GROUP BY ALL))"""


@query(f"""WITH {_DOCS}, kept AS (SELECT * FROM have h WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.u = h.u AND (n.path = h.path OR starts_with(h.path, n.path || '.') OR starts_with(n.path, h.path || '.'))))
    SELECT u, path, CAST(value AS VARCHAR) AS value FROM kept UNION ALL SELECT u, path, CAST(value AS VARCHAR) FROM new""")
def q178_deep_documents(spark, d):
    """Nested documents made from dotted paths, taken apart again and merged with changes at other depths."""
    e = table(spark, d, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("k"), F.col("event_type").alias("t"))
    place = F.concat("t", F.lit(".p"), F.col("k") % 3, F.lit(".q"), F.col("k") % 4)
    have = docstore.leaves(docstore.nested(e.groupBy("u", place.alias("path")).agg(F.max("k").alias("value")), "u"), "u")
    spot = F.when(F.col("u") % 2 == 0, F.concat("t", F.lit(".p1"))).otherwise(F.concat("t", F.lit(".p2.q1.r")))
    new = e.groupBy("u", spot.alias("path")).agg(F.max("k").cast("string").alias("value"))
    merged = docstore.merged_leaves(have, new, "u")
    return docstore.leaves(docstore.nested(merged, "u"), "u")


def _subdivided_sql() -> str:
    draw = lambda k: f"('0x' || substr(md5('7:' || id || ':{k}:' || cx || ':' || cy || ':0'), 1, 8))::BIGINT"
    cells = lambda sx, sy, n, of: f"SELECT t.id, x0, x1, y0, y1, a.i AS cx, b.i AS cy{n} FROM {of} t, LATERAL (SELECT unnest(generate_series(CAST(floor(x0 / {sx}) AS BIGINT), CAST(floor(x1 / {sx}) AS BIGINT))) AS i) a, LATERAL (SELECT unnest(generate_series(CAST(floor(y0 / {sy}) AS BIGINT), CAST(floor(y1 / {sy}) AS BIGINT))) AS i) b"
    return f"""WITH l AS ({LINES}), a AS ({cells(64, 32, '', 'l')}), a1 AS (SELECT *, {draw(0)} < {int(0.2 * (1 << 32))} AS shown FROM a),
        b AS (SELECT id, x0, x1, y0, y1, cx, cy FROM ({cells(16, 8, ', t.cx AS px, t.cy AS py', '(SELECT * FROM a1 WHERE NOT shown)')}) WHERE floor(cx / 4) = px AND floor(cy / 4) = py), b1 AS (SELECT *, {draw(1)} < {int(0.5 * (1 << 32))} AS shown FROM b),
        c AS (SELECT id, x0, x1, y0, y1, cx, cy FROM ({cells(4, 2, ', t.cx AS px, t.cy AS py', '(SELECT * FROM b1 WHERE NOT shown)')}) WHERE floor(cx / 4) = px AND floor(cy / 4) = py)
        SELECT 0 AS level, cx, cy, id FROM a1 WHERE shown UNION ALL SELECT 1, cx, cy, id FROM b1 WHERE shown UNION ALL SELECT 2, cx, cy, id FROM c"""


@query(_subdivided_sql())
def q179_subdivided(spark, d):
    """Annotations dealt over three levels, each cell at its level's rate."""
    rows = layer_lines(spark, d).groupBy("id").agg(F.min(F.struct("x0", "x1", "y0", "y1")).alias("r")).select("id", "r.*").withColumns({"z0": F.lit(0.0), "z1": F.lit(0.0)})
    out = sampling.subdivided(rows, "id", [("x0", "x1"), ("y0", "y1"), ("z0", "z1")], [(64, 32, 1), (16, 8, 1), (4, 2, 1)], [0.2, 0.5, 1.0], 7)
    return out.select("level", "cx", "cy", "id")


@query("SELECT p_partkey, regexp_replace('part_x_r' || p_partkey || '_p' || p_size, '^[a-zA-Z_]+_r', 'net_r') AS id, regexp_replace(CAST(p_partkey AS VARCHAR) || '_r', '^[a-zA-Z_]+_r', 'net_r') AS other FROM part")
def q180_reprefixed_ids(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("part_x_r"), F.col("p_partkey"), F.lit("_p"), F.col("p_size"))
    return p.select("p_partkey", scalar.reprefixed(name, "net").alias("id"), scalar.reprefixed(F.concat(F.col("p_partkey"), F.lit("_r")), "net").alias("other"))


@query("""SELECT 'csv' AS format, CAST(c_custkey AS VARCHAR) || ',' || c_name AS line FROM customer UNION ALL SELECT 'json', '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' FROM customer""")
def q181_serialised_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    csv, json = (chunked.serialised(c, fmt).select(F.lit(fmt).alias("format"), "line") for fmt in ("csv", "json"))
    return csv.unionByName(json)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (floor(l_quantity / 16) = 1 AND floor(round(l_discount * 100, 0) / 4) = 1 AND floor(round(l_tax * 100, 0) / 4) = 0)")
def q182_deleted_chunk(spark, d):
    """A layer of which one chunk has been deleted."""
    root = scratch(spark)
    chunked.write_info(spark, root, chunked.LayerInfo((1.0, 1.0, 1.0), (0, 0, 0), (64, 16, 16), (16, 4, 4), "l_orderkey long, l_linenumber int, x double, y double, z double"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100, 0).alias("y"), F.round(F.col("l_tax") * 100, 0).alias("z"))
    chunked.write_rows(rows, root, ["x", "y", "z"])
    chunked.delete_chunks(spark, root, [(1, 1, 0), (99, 0, 0)])
    return chunked.read_box(spark, root, ["x", "y", "z"], (0, 0, 0), (64, 16, 16)).select("l_orderkey", "l_linenumber")


@query(f"WITH v AS ({VOXELS}) SELECT x // 2 AS x, y // 2 AS y, z, CASE WHEN sum(v) / 4 > 1200 THEN 1 ELSE 0 END AS v FROM v GROUP BY ALL")
def q183_data_resolution(spark, d):
    """Slices read at one resolution and given as a mask at half of it."""
    v = voxels(spark, d).select("x", "y", "z", "v")
    return resample.at_resolution(v, {"x": 10, "y": 10}, {"x": 4.0, "y": 4.0}, {"x": 8.0, "y": 8.0}, "area", 1200)
