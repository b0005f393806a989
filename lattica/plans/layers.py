"""Queries of the layer operators on the driver's tables: arrays, contacts, annotations, shard files, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import boxes, spatial
from ..operators import annotations, contact_tables, grids, matching, shapes
from ..sources import arrays, shards
from .flows import scratch
from .volume import POINTS, VOXELS, points, voxels

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_BOX = ((2, 12), (3, 8), (0, 2))


@query(f"SELECT g.x, g.y, g.z, coalesce(v.v, 0.0) AS v FROM (SELECT x, y, z FROM (SELECT unnest(generate_series(2, 11)) AS x), (SELECT unnest(generate_series(3, 7)) AS y), (SELECT unnest(generate_series(0, 1)) AS z)) g LEFT JOIN ({VOXELS}) v USING (x, y, z)")
def q122_array_cutout(spark, d):
    """An array layer written in chunks and read as a box that reaches beyond it: zero outside."""
    path = f"{scratch(spark)}/array"
    own = voxels(spark, d).select("x", "y", "z", "v")
    arrays.write_array(own, path, (4, 4, 2), bounds=((0, 10), (0, 10), (0, 1 << 20)))
    return arrays.cutout(arrays.read_chunks(spark, path, _BOX, (4, 4, 2)), _BOX, (4, 4, 2), filled=True)


@query(f"SELECT x, y, z, CASE WHEN x < 4 AND y < 4 AND z < 2 THEN -v ELSE v END AS v FROM ({VOXELS})")
def q123_array_rewrite(spark, d):
    """One chunk written again: its new values count, the other chunks stay."""
    path = f"{scratch(spark)}/array"
    own = voxels(spark, d).select("x", "y", "z", "v")
    arrays.write_array(own, path, (4, 4, 2))
    arrays.write_array(own.where("x < 4 and y < 4 and z < 2").withColumn("v", -F.col("v")), path, (4, 4, 2))
    top = own.agg(F.max("z")).first()[0]
    whole = ((0, 10), (0, 10), (0, (0 if top is None else top) + 1))
    return arrays.cutout(arrays.read_chunks(spark, path, whole, (4, 4, 2)), whole, (4, 4, 2)).where("v <> 0")


@query(f"SELECT x, y, z, v AS image, label, 7 AS mask FROM ({VOXELS}) WHERE x >= 1 AND x < 5 AND y >= 2 AND y < 6 AND z < 2")
def q124_layers_together(spark, d):
    """Three layers read as one, taken apart and put together again; one of them is a constant."""
    v = voxels(spark, d)
    box = ((1, 5), (2, 6), (0, 2))
    joint = arrays.together({"image": v.select("x", "y", "z", "v"), "label": v.select("x", "y", "z", F.col("label").alias("v")), "mask": arrays.constant(spark, box, 7)})
    return arrays.together(arrays.apart(joint, ["image", "label", "mask"]))


_CORE = f"SELECT seg_a * 100 + seg_b AS contact_id, seg_a, seg_b, x, y, z FROM ({POINTS})"
_AUTH = "[CAST('human' AS VARCHAR), 'model', 'rule'][CAST(x AS BIGINT) % 3 + 1]"


def _faces(spark, d):
    return points(spark, d).select((F.col("seg_a") * 100 + F.col("seg_b")).alias("contact_id"), "seg_a", "seg_b", "x", "y", "z")


def _core(spark, d):
    return _faces(spark, d).select("contact_id", "seg_a", "seg_b").distinct()


def _authority():
    return F.element_at(F.array(*map(F.lit, ("human", "model", "rule"))), (F.col("x").cast("long") % 3 + 1).cast("int"))


@query(f"""WITH c AS ({_CORE}), s AS (SELECT contact_id, {_AUTH} AS authority, max(y > 5) AS should_merge, max(z / 10) AS probability FROM c WHERE seg_a % 4 <> 0 GROUP BY ALL), m AS (SELECT contact_id, string_agg(authority || '=' || should_merge, ',' ORDER BY authority) AS decisions, string_agg(authority || '=' || CAST(CAST(round(probability * 10) AS INTEGER) AS VARCHAR), ',' ORDER BY authority) AS tenths FROM s GROUP BY ALL)
SELECT DISTINCT c.contact_id, decisions, tenths FROM c LEFT JOIN m USING (contact_id)""")
def q125_contact_decisions(spark, d):
    """Contacts with the decisions and probabilities of each authority; some contacts have none."""
    side = _faces(spark, d).where("seg_a % 4 <> 0").select("contact_id", _authority().alias("authority"), (F.col("y") > 5).alias("should_merge"), (F.col("z") / 10).alias("probability"))
    both = contact_tables.with_probabilities(contact_tables.with_decisions(_core(spark, d), side), side)
    text = lambda m, f: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), f(e["value"]))), ",")
    return both.select("contact_id", text("merge_decisions", lambda v: v.cast("string")).alias("decisions"), text("merge_probabilities", lambda v: F.round(v * 10).cast("int").cast("string")).alias("tenths"))


@query(f"WITH c AS ({_CORE}), s AS (SELECT contact_id, seg_a AS segment_id, max(CAST(x AS BIGINT)) AS supervoxel_id FROM c GROUP BY ALL UNION ALL SELECT contact_id, seg_b, max(CAST(x + y AS BIGINT)) FROM c WHERE seg_b % 3 <> 0 GROUP BY ALL) SELECT contact_id, segment_id, max(supervoxel_id) AS supervoxel_id FROM s GROUP BY ALL")
def q126_contact_supervoxels(spark, d):
    """Supervoxels attached to contacts, and split off again into their long table."""
    f = _faces(spark, d)
    side = f.select("contact_id", F.col("seg_a").alias("segment_id"), F.col("x").cast("long").alias("supervoxel_id")).unionByName(f.where("seg_b % 3 <> 0").select("contact_id", F.col("seg_b").alias("segment_id"), (F.col("x") + F.col("y")).cast("long").alias("supervoxel_id")))
    return contact_tables.split_tables(contact_tables.with_supervoxels(_core(spark, d), side))["supervoxels"]


_CLOUD = f"SELECT contact_id, CASE WHEN seg_a % 2 = 0 THEN 200 ELSE 500 END AS radius_nm, CASE WHEN CAST(y AS BIGINT) % 2 = 0 THEN 'a' ELSE 'b' END AS side, x, y, z FROM ({_CORE})"


@query(f"WITH p AS ({_CLOUD}) SELECT contact_id, side, x, y, z, count(*) AS n FROM p WHERE radius_nm = 200 GROUP BY ALL")
def q127_contact_points(spark, d):
    """Contacts that have the required point clouds, with them, and back in long form."""
    f = _faces(spark, d)
    cloud = f.select("contact_id", F.when(F.col("seg_a") % 2 == 0, 200).otherwise(500).alias("radius_nm"), F.lit(16).alias("n_points"), F.when(F.col("y").cast("long") % 2 == 0, "a").otherwise("b").alias("side"), F.lit(0).alias("i"), "x", "y", "z")
    own = contact_tables.with_points(_core(spark, d), cloud, [(200, 16)])
    return contact_tables.split_tables(own)["points"].groupBy("contact_id", "side", "x", "y", "z").agg(F.count("*").alias("n"))


_NEAR = f"SELECT c.contact_id, c.segment_id, v.x, v.y, v.z, mx, my, mz FROM (SELECT contact_id, unnest([seg_a, seg_b]) AS segment_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM ({_CORE}) GROUP BY contact_id, seg_a, seg_b) c LEFT JOIN ({VOXELS}) v ON v.label = c.segment_id"


@query(f"SELECT contact_id, segment_id, coalesce(CAST(x AS DOUBLE), mx) AS x, coalesce(CAST(y AS DOUBLE), my) AS y, coalesce(CAST(z AS DOUBLE), mz) AS z FROM (SELECT *, row_number() OVER (PARTITION BY contact_id, segment_id ORDER BY (x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2, x, y, z) AS k FROM ({_NEAR})) WHERE k = 1".replace("coalesce(CAST(x AS DOUBLE), mx)", "round(coalesce(CAST(x AS DOUBLE), mx) + 1e-9, 6)").replace("coalesce(CAST(y AS DOUBLE), my)", "round(coalesce(CAST(y AS DOUBLE), my) + 1e-9, 6)").replace("coalesce(CAST(z AS DOUBLE), mz)", "round(coalesce(CAST(z AS DOUBLE), mz) + 1e-9, 6)"))
def q128_representatives(spark, d):
    """For each side of a contact its segment's voxel nearest to the faces; the faces' mean where the segment has none."""
    seen = voxels(spark, d).select(F.col("label").alias("segment_id"), "x", "y", "z")
    f = _faces(spark, d)
    sides = f.select("contact_id", F.explode(F.array("seg_a", "seg_b")).alias("segment_id")).distinct()
    out = contact_tables.representatives(f, sides.join(seen, "segment_id"))
    return out.withColumns({a: F.round(F.col(a) + 1e-9, 6) for a in "xyz"})


@query(f"WITH p AS (SELECT DISTINCT x, y, z FROM ({_CORE})), v AS ({VOXELS}) SELECT p.x, p.y, p.z, v.x AS x_v, v.y AS y_v, v.z AS z_v FROM p JOIN v ON (v.x * 4 - p.x) ** 2 + (v.y * 4 - p.y) ** 2 + (v.z * 4 - p.z) ** 2 <= 36")
def q129_sphere_voxels(spark, d):
    """Voxels within 6 nm of the face points."""
    near = contact_tables.sphere_cells(_faces(spark, d).select("x", "y", "z").distinct(), ["x", "y", "z"], 6.0, [4, 4, 4])
    own = voxels(spark, d).select(F.col("x").alias("x_v"), F.col("y").alias("y_v"), F.col("z").alias("z_v"))
    return near.join(own, ["x_v", "y_v", "z_v"]).select("x", "y", "z", "x_v", "y_v", "z_v")


_WIDE = f"SELECT DISTINCT label, x + i AS x, y + j AS y, z FROM ({VOXELS}), (SELECT unnest(generate_series(-1, 1)) AS i), (SELECT unnest(generate_series(-1, 1)) AS j) WHERE label <> 0 AND abs(i) + abs(j) <= 1"


@query(f"WITH w AS ({_WIDE}) SELECT a.label AS cell_1, b.label AS cell_2, count(*) AS n FROM w a JOIN w b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.label < b.label GROUP BY ALL")
def q130_contact_masks(spark, d):
    return contact_tables.touching(voxels(spark, d), 1).groupBy("cell_1", "cell_2").agg(F.count("*").alias("n"))


#: One annotation an id: the first in the order of its coordinates.
_LINES = "SELECT * FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS x0, l_quantity + round(l_discount * 100, 0) AS x1, round(l_tax * 100, 0) AS y0, round(l_tax * 100, 0) + l_linenumber AS y1 FROM lineitem) QUALIFY row_number() OVER (PARTITION BY id ORDER BY x0, x1, y0, y1) = 1"


def _lines(spark, d):
    q, t = F.col("l_quantity"), F.round(F.col("l_tax") * 100, 0)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), q.alias("x0"), (q + F.round(F.col("l_discount") * 100, 0)).alias("x1"), t.alias("y0"), (t + F.col("l_linenumber")).alias("y1"), F.lit(0.0).alias("z0"), F.lit(0.0).alias("z1"))


def _stored(spark, d):
    path = f"{scratch(spark)}/annotations"
    annotations.write_layer(_lines(spark, d), path, [("x0", "x1"), ("y0", "y1"), ("z0", "z1")], [(64, 16, 1), (16, 4, 1)])
    return path


@query(f"SELECT DISTINCT * FROM ({_LINES})")
def q131_annotations_all(spark, d):
    """All annotations of a layer read from its cells: each once, in however many cells it lies."""
    return annotations.read_all(spark, _stored(spark, d)).select("id", "x0", "x1", "y0", "y1")


@query(f"SELECT DISTINCT * FROM ({_LINES}) WHERE id % 50 = 0")
def q132_annotations_by_id(spark, d):
    """The annotations of given ids, from the index by id."""
    wanted = _lines(spark, d).where("id % 50 = 0").select("id")
    return annotations.read_by_id(spark, _stored(spark, d), wanted).select("id", "x0", "x1", "y0", "y1")


@query(f"SELECT DISTINCT id, x0 FROM ({_LINES}) WHERE x1 >= 20 AND x0 <= 40 AND y1 >= 3 AND y0 <= 6")
def q133_annotations_in_bounds(spark, d):
    """The annotations that touch a box, from the cells that it touches."""
    return annotations.read_box(spark, _stored(spark, d), [("x0", "x1"), ("y0", "y1"), ("z0", "z1")], [(20, 40), (3, 6), (0, 0)], (16, 4, 1), 1).select("id", "x0")


@query(f"WITH b AS (SELECT DISTINCT * FROM ({_LINES})) SELECT id, x0 FROM b WHERE NOT (floor(x0 / 16) <= 1 AND floor(x1 / 16) >= 1 AND floor(y0 / 4) <= 0 AND floor(y1 / 4) >= 0) OR id % 2 = 0")
def q134_annotations_replaced(spark, d):
    """One cell written again with half of its annotations: read_all no longer finds those that lay there alone or elsewhere too,
    because the layer's index by id follows."""
    path = _stored(spark, d)
    bounds = [("x0", "x1"), ("y0", "y1"), ("z0", "z1")]
    annotations.replace_cell(spark, path, bounds, 1, (1, 0, 0), (16, 4, 1), lambda old: old.where("id % 2 = 0"))
    return annotations.read_by_id(spark, path).select("id", "x0")


@query("SELECT l_orderkey * 8 + l_linenumber AS id, ((l_orderkey * 8 + l_linenumber) // 16 // 4) % 8 AS shard, ((l_orderkey * 8 + l_linenumber) // 16) % 4 AS minishard, max(length(l_returnflag) + length(l_linestatus) + 1) AS size FROM lineitem GROUP BY ALL")
def q135_shard_files(spark, d):
    """Chunks written to shard files and read back from them."""
    path = f"{scratch(spark)}/shards"
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.concat_ws("|", "l_returnflag", "l_linestatus").alias("data")).dropDuplicates(["id"])
    shards.write_shards(rows, path, "id", "data", 4, 2, 3)
    return shards.read_shards(spark, path, 2).select("id", "shard", "minishard", F.length("data").cast("long").alias("size"))


_SYN = "SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS x, l_quantity * 10 AS y, l_discount * 1000 AS z, l_suppkey % 2 AS side, l_suppkey % 3 AS pre, l_partkey % 3 AS post FROM lineitem"


@query(f"""WITH s AS (SELECT DISTINCT * FROM ({_SYN}) WHERE x >= 500 AND x < 90000 AND pre <> post), a AS (SELECT * FROM s WHERE side = 0), b AS (SELECT * FROM s WHERE side = 1),
p AS (SELECT a.id AS ia, b.id AS ib, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM a JOIN b ON a.pre = b.pre AND a.post = b.post AND b.x > a.x - 12 AND b.x < a.x + 12 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 144)
SELECT a.id, CAST(count(ib) AS BIGINT) AS n_near, min(round(sqrt(d2), 6)) AS nearest FROM (SELECT DISTINCT id FROM a) a LEFT JOIN p ON p.ia = a.id GROUP BY a.id""")
def q136_keyed_candidates(spark, d):
    """Evaluation before matching: the box, no pairs within one segment, candidates of equal keys within the radius."""
    li = table(spark, d, "lineitem")
    s = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 10).alias("y"), (F.col("l_discount") * 1000).alias("z"), (F.col("l_suppkey") % 2).alias("side"), (F.col("l_suppkey") % 3).alias("pre"), (F.col("l_partkey") % 3).alias("post")).distinct()
    a, b = (matching.valid_points(s.where(F.col("side") == k).drop("side"), ["x"], [(500, 90000)], ("pre", "post")) for k in (0, 1))
    near = matching.keyed_pairs(a, b, 12.0, ["x", "y", "z"], ["pre", "post"])
    return a.select("id").distinct().join(near.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.round("dist", 6)).alias("nearest")), "id", "left").select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"), "nearest")


@query(f"WITH c AS (SELECT x, y, z, label FROM ({VOXELS})) SELECT z, label, bool_or(x = 0 OR x = 9 OR y = 0 OR y = 9) AS touches FROM c GROUP BY ALL")
def q137_edge_touches(spark, d):
    """Labels of a plane that touch its border."""
    return shapes.touches_edge(voxels(spark, d), ["z", "label"], {"x": 10, "y": 10})


@query(f"SELECT x, y, z, CASE WHEN label IN (SELECT l_linenumber FROM lineitem WHERE l_linenumber % 2 = 1) THEN 0 ELSE label END AS label FROM ({VOXELS})")
def q138_blackout(spark, d):
    """Listed labels set to zero."""
    listed = table(spark, d, "lineitem").where("l_linenumber % 2 = 1").select(F.col("l_linenumber").cast("long").alias("label"))
    return shapes.blacked_out(voxels(spark, d).select("x", "y", "z", "label"), "label", listed)


@query("WITH s AS (SELECT l_suppkey, l_linenumber FROM lineitem GROUP BY ALL) SELECT min(l_linenumber) AS resolution FROM (SELECT l_linenumber FROM s GROUP BY l_linenumber HAVING count(*) = (SELECT count(DISTINCT l_suppkey) FROM s))")
def q139_common_resolution(spark, d):
    """The smallest value that all layers share."""
    return shapes.common_least(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("layer"), F.col("l_linenumber").alias("resolution")), "layer", "resolution")


@query("WITH e AS (SELECT l_orderkey AS a, CAST(l_partkey AS VARCHAR) || '.0' AS sv FROM lineitem), m AS (SELECT p_partkey AS sv, p_partkey % 50 AS root FROM part) SELECT a, root, count(*) AS n FROM e JOIN m ON CAST(CAST(e.sv AS DOUBLE) AS BIGINT) = m.sv GROUP BY ALL")
def q140_edge_list_roots(spark, d):
    """Text ids such as 12.0 resolved to roots by a join; an id without one raises on the executors."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.concat(F.col("l_partkey").cast("string"), F.lit(".0")).alias("sv"))
    roots = table(spark, d, "part").select(F.col("p_partkey").alias("sv"), (F.col("p_partkey") % 50).alias("root"))
    return matching.with_roots(edges, "sv", roots).groupBy("a", "root").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT vec_id, (embedding[1] * 4) AS x, (embedding[2] * 4) AS y FROM embeddings) SELECT vec_id, CAST(ceil(round(x / 2 - 1.5, 10)) AS BIGINT) AS x0, CAST(ceil(round(x / 2 - 1.5, 10)) AS BIGINT) + 3 AS x1, CAST(ceil(round(y / 2 - 2.0, 10)) AS BIGINT) AS y0, CAST(ceil(round(y / 2 - 2.0, 10)) AS BIGINT) + 4 AS y1 FROM p")
def q141_boxes_at_points(spark, d):
    """Training boxes centred on annotated points."""
    p = table(spark, d, "embeddings").select("vec_id", (F.col("embedding")[0] * 4).alias("x"), (F.col("embedding")[1] * 4).alias("y"))
    (x0, x1), (y0, y1) = boxes.centred([F.col("x"), F.col("y")], [3, 4], [2, 2])
    return p.select("vec_id", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


@query("""WITH m AS (SELECT CAST(floor(min(l_extendedprice)) AS BIGINT) AS x0, CAST(ceil(max(l_extendedprice)) AS BIGINT) AS x1, CAST(floor(min(l_quantity)) AS BIGINT) AS y0, CAST(ceil(max(l_quantity)) AS BIGINT) AS y1 FROM lineitem),
    c AS (SELECT unnest(generate_series(x0 // 500, CAST(ceil(x1 / 500) AS BIGINT) - 1)) AS i, m.* FROM m), g AS (SELECT *, unnest(generate_series(y0 // 8, CAST(ceil(y1 / 8) AS BIGINT) - 1)) AS j FROM c),
    n AS (SELECT CAST(floor(l_extendedprice / 500) AS BIGINT) AS i, CAST(floor(l_quantity / 8) AS BIGINT) AS j, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT greatest(g.i * 500, x0) AS x0, least(g.i * 500 + 500, x1) AS x1, greatest(g.j * 8, y0) AS y0, least(g.j * 8 + 8, y1) AS y1, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (i, j)""")
def q142_contact_chunks(spark, d):
    """Cells of a contact layer clipped to the extent of its contacts, with the contacts of each."""
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    m = li.agg(F.floor(F.min("x")), F.ceil(F.max("x")), F.floor(F.min("y")), F.ceil(F.max("y"))).first()
    c = boxes.exact_chunks(spark, (m[0], m[2]), (m[1], m[3]), (500, 8)) if m[0] is not None else boxes.exact_chunks(spark, (0, 0), (0, 0), (500, 8))
    cell = lambda a, s: F.floor(F.col(a) / s)
    n = li.groupBy(cell("x", 500).alias("i"), cell("y", 8).alias("j")).agg(F.count("*").alias("n"))
    return c.withColumns({"i": cell("x0", 500), "j": cell("y0", 8)}).join(n, ["i", "j"], "left").select(*(F.col(k).cast("long").alias(k) for k in ("x0", "x1", "y0", "y1")), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH v AS ({VOXELS}) SELECT a.x, a.y, a.z, b.label AS other, CAST(abs(a.x - b.x) + abs(a.y - b.y) AS BIGINT) AS distance FROM v a JOIN v b ON a.z = b.z AND a.label <> 0 AND b.label <> 0 AND a.label <> b.label AND abs(a.x - b.x) + abs(a.y - b.y) <= 2 QUALIFY row_number() OVER (PARTITION BY a.x, a.y, a.z ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.y, b.x) = 1")
def q161_nearest_other(spark, d):
    """The nearest different label of every labelled voxel."""
    return annotations.nearest_other(voxels(spark, d), 2).withColumn("distance", F.col("distance").cast("long"))


@query("""WITH e AS (SELECT event_id AS pos, value - 60 AS v FROM events), n AS (SELECT max(pos) // 20 AS final FROM e), c AS (SELECT i AS chunk FROM (SELECT unnest(generate_series(0, final)) AS i FROM n)),
j AS (SELECT pos, v * (1 + chunk % 2) AS v FROM e JOIN c ON pos >= chunk * 20 - 5 AND pos < chunk * 20 + 25), r AS (SELECT pos, greatest(max(v), 0.0) AS value FROM j GROUP BY pos)
SELECT pos, value FROM r WHERE pos // 20 IN (SELECT pos // 20 FROM r GROUP BY pos // 20 HAVING max(value) > 0)""")
def q162_blend_greatest(spark, d):
    """Overlapping chunks reduced to the greatest value, empty chunks left out."""
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("value") - 60).alias("v"))
    last = e.agg(F.max("pos")).first()[0]
    rows = grids.overlapped(e, "pos", 20, 5, 0, 0 if last is None else last + 1)
    return grids.blended_max(rows, "pos", F.col("v") * (1 + F.col("chunk") % 2), 20)


@query(f"WITH v AS ({VOXELS}), p AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(round_even(l_quantity / 5, 0) AS BIGINT) AS x, CAST(round_even(l_discount * 100, 0) AS BIGINT) AS y, CAST(l_linenumber - 1 AS BIGINT) AS z FROM lineitem) SELECT v.label, count(*) AS n_lines, count(DISTINCT id) AS n_ids FROM p JOIN v USING (x, y, z) WHERE label <> 0 GROUP BY v.label")
def q163_lines_by_label(spark, d):
    """Lines grouped by the label at their first point, background left out."""
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 5).alias("px"), (F.col("l_discount") * 100).alias("py"), (F.col("l_linenumber") - 1).cast("double").alias("pz"))
    at = annotations.labels_at(li, ["px", "py", "pz"], voxels(spark, d))
    return at.where("label <> 0").groupBy("label").agg(F.count("*").alias("n_lines"), F.count_distinct("id").alias("n_ids"))


@query(f"""WITH s AS (SELECT DISTINCT * FROM ({_SYN})), a AS (SELECT * FROM s WHERE side = 0 AND id % 2 = 0), b AS (SELECT * FROM s WHERE side = 0 AND id % 2 = 1)
SELECT DISTINCT a.id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.pre = b.pre AND a.post = b.post AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 10000)""")
def q164_duplicates(spark, d):
    """Points that repeat another set's points of equal keys within the radius."""
    li, k = table(spark, d, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    s = li.where("l_suppkey % 2 = 0").select(k.alias("id"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 10).alias("y"), (F.col("l_discount") * 1000).alias("z"), (F.col("l_suppkey") % 3).alias("pre"), (F.col("l_partkey") % 3).alias("post")).distinct()
    out = matching.duplicates(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 100.0, ["x", "y", "z"], ["pre", "post"])
    return out.select("id").distinct()
