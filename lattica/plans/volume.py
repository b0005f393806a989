"""Queries of the volumetric operators on the driver's tables, with their SQL.

Stand-ins: ``part`` is a 10 x 10 x n grid of labelled voxels, ``lineitem`` a cloud of contact points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import spatial as S
from ..operators import components, contacts, grids, overlaps

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def voxels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("node"), (k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y"), F.floor(k / 100).alias("z"), (F.col("p_size") % 5).cast("long").alias("label"), F.col("p_retailprice").alias("v"))


VOXELS = "SELECT p_partkey AS node, p_partkey % 10 AS x, (p_partkey // 10) % 10 AS y, p_partkey // 100 AS z, CAST(p_size % 5 AS BIGINT) AS label, p_retailprice AS v FROM part"


def points(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_suppkey") % 20, F.col("l_partkey") % 20
    li = table(spark, d, "lineitem").where(a != b)
    return li.select(F.least(a, b).alias("seg_a"), F.greatest(a, b).alias("seg_b"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100, 0).alias("y"), F.round(F.col("l_tax") * 100, 0).alias("z"), F.col("l_discount").alias("aff"))


POINTS = "SELECT least(l_suppkey % 20, l_partkey % 20) AS seg_a, greatest(l_suppkey % 20, l_partkey % 20) AS seg_b, l_quantity AS x, round(l_discount * 100, 0) AS y, round(l_tax * 100, 0) AS z, l_discount AS aff FROM lineitem WHERE l_suppkey % 20 <> l_partkey % 20"

OVERLAP = "SELECT l_suppkey AS seg, l_partkey % 50 AS ref, count(*) AS n FROM lineitem WHERE l_suppkey <> 0 AND l_partkey % 50 <> 0 GROUP BY ALL"


def _overlaps(spark, d):
    return overlaps.overlap_counts(table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("ref")), "l_suppkey", "ref")


@query(OVERLAP)
def q01_overlap_counts(spark, d):
    return _overlaps(spark, d)


@query(f"SELECT seg, count(*) AS n_refs FROM ({OVERLAP}) WHERE n >= 18 GROUP BY seg HAVING count(*) >= 2")
def q02_merger_segments(spark, d):
    return overlaps.merger_segments(_overlaps(spark, d), 18)


@query(f"SELECT s_suppkey AS seg, coalesce(max(n), 0) AS most FROM supplier LEFT JOIN ({OVERLAP}) ON seg = s_suppkey GROUP BY s_suppkey HAVING coalesce(max(n), 0) < 22")
def q03_unclaimed_segments(spark, d):
    return overlaps.unclaimed_segments(table(spark, d, "supplier").select(F.col("s_suppkey").alias("seg")), _overlaps(spark, d), 22)


@query("SELECT l_partkey AS seg, count(*) AS n FROM lineitem WHERE l_partkey <> 0 GROUP BY l_partkey HAVING count(*) < 20")
def q04_small_segments(spark, d):
    return overlaps.small_segments(table(spark, d, "lineitem"), "l_partkey", 20)


@query("""WITH g AS (SELECT x.i AS cx, y.i AS cy, z.i AS cz FROM generate_series(0, 5) x(i), generate_series(0, 4) y(i), generate_series(0, 4) z(i)),
c AS (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS cx, CAST(floor(round(l_discount * 100, 0) / 4) AS BIGINT) AS cy, CAST(floor(round(l_tax * 100, 0) / 4) AS BIGINT) AS cz, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT g.cx, g.cy, g.cz, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (cx, cy, cz)""")
def q05_chunk_counts(spark, d):
    """Rows of each chunk of a grid, zero for the empty ones."""
    p = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100, 0).alias("y"), F.round(F.col("l_tax") * 100, 0).alias("z"))
    at = [c.alias(n) for c, n in zip(S.chunk_index([F.col(a) for a in "xyz"], (1, 1, 1), (0, 0, 0), (10, 4, 4)), ("cx", "cy", "cz"))]
    counts = p.groupBy(*at).agg(F.count("*").alias("n"))
    return S.grid(spark, (6, 5, 5)).drop("n").join(counts, ["cx", "cy", "cz"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem WHERE l_quantity * 4 >= 40 AND l_quantity * 4 < 120 AND l_discount >= 0.02 AND l_discount < 0.06 AND l_tax >= 0.01 AND l_tax < 0.05")
def q06_points_in_box(spark, d):
    b = S.box((40, 0.02, 0.01), (120, 0.06, 0.05))
    hit = S.contains([F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], b, (4, 1, 1))
    return table(spark, d, "lineitem").where(hit).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"))


@query("""SELECT DISTINCT l_quantity AS x, CAST(ceil(round((l_quantity - 1) / 7, 10)) AS DOUBLE) * 7 + 1 AS shrunk, CAST(floor(round((l_quantity - 1) / 7, 10)) AS DOUBLE) * 7 + 1 AS expanded, CAST(floor(round((l_quantity - 1) / 7, 10)) AS DOUBLE) * 7 + 1 AS floored FROM lineitem""")
def q07_snapped_bounds(spark, d):
    x = F.col("x")
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("x")).distinct().select("x", *[S.snapped(x, 1.0, 7.0, m, False).cast("double").alias(n) for m, n in (("shrink", "shrunk"), ("expand", "expanded"), ("floor", "floored"))])


_SEGMENTS = "SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_discount AS y0, l_tax AS z0, lead(l_quantity) OVER w AS x1, lead(l_discount) OVER w AS y1, lead(l_tax) OVER w AS z1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_tax)"


@query(f"""WITH s AS ({_SEGMENTS}), t AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy, z1 - z0 AS dz FROM s WHERE x1 IS NOT NULL),
u AS (SELECT *, (x0 >= 10 AND x0 < 30 AND y0 >= 0.03 AND y0 < 0.07 AND z0 >= 0.02 AND z0 < 0.06) OR (x1 >= 10 AND x1 < 30 AND y1 >= 0.03 AND y1 < 0.07 AND z1 >= 0.02 AND z1 < 0.06) AS inside,
 (dx <> 0 OR (x0 >= 10 AND x0 < 30)) AND (dy <> 0 OR (y0 >= 0.03 AND y0 < 0.07)) AND (dz <> 0 OR (z0 >= 0.02 AND z0 < 0.06)) AS still,
 greatest(0.0, CASE WHEN dx <> 0 THEN least((10 - x0) / dx, (30 - x0) / dx) ELSE 0.0 END, CASE WHEN dy <> 0 THEN least((0.03 - y0) / dy, (0.07 - y0) / dy) ELSE 0.0 END, CASE WHEN dz <> 0 THEN least((0.02 - z0) / dz, (0.06 - z0) / dz) ELSE 0.0 END) AS lo,
 least(1.0, CASE WHEN dx <> 0 THEN greatest((10 - x0) / dx, (30 - x0) / dx) ELSE 1.0 END, CASE WHEN dy <> 0 THEN greatest((0.03 - y0) / dy, (0.07 - y0) / dy) ELSE 1.0 END, CASE WHEN dz <> 0 THEN greatest((0.02 - z0) / dz, (0.06 - z0) / dz) ELSE 1.0 END) AS hi FROM t)
SELECT count(*) AS n_lines, CAST(count(*) FILTER (WHERE inside OR (still AND lo <= hi)) AS BIGINT) AS n_hits FROM u""")
def q08_lines_through_box(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_discount", "l_tax")
    s = table(spark, d, "lineitem").select(*[F.col(c).alias(f"{a}0") for a, c in zip("xyz", ("l_quantity", "l_discount", "l_tax"))], *[F.lead(c).over(w).alias(f"{a}1") for a, c in zip("xyz", ("l_quantity", "l_discount", "l_tax"))]).where("x1 is not null")
    hit = S.line_hits([F.col(f"{a}0") for a in "xyz"], [F.col(f"{a}1") for a in "xyz"], [(10.0, 30.0), (0.03, 0.07), (0.02, 0.06)])
    return s.agg(F.count("*").alias("n_lines"), F.count_if(hit).alias("n_hits"))


_CENTRE = "SELECT seg_a, seg_b, count(*) AS n, round(avg(aff) + 1e-9, 6) AS mean_weight, " + ", ".join(f"round(CASE WHEN sum(aff) > 0 THEN sum({a} * aff) / sum(aff) ELSE avg({a}) END + 1e-9, 6) AS com_{a}" for a in "xyz") + " FROM {} GROUP BY seg_a, seg_b"


def _rounded(df, *names):
    """Rounded for the comparison; the small shift keeps exact halves from falling either way."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


@query(_CENTRE.format(f"({POINTS})"))
def q09_weighted_centres(spark, d):
    return _rounded(contacts.weighted_centre(points(spark, d), ["seg_a", "seg_b"], "aff"), "mean_weight", "com_x", "com_y", "com_z")


@query(f"WITH p AS ({POINTS}) SELECT seg_a, seg_b, count(*) AS n FROM p WHERE (seg_a, seg_b) NOT IN (SELECT (seg_a, seg_b) FROM p WHERE x >= 50 AND y >= 10 AND z >= 6) GROUP BY seg_a, seg_b")
def q10_pairs_off_boundary(spark, d):
    edge = (F.col("x") >= 50) & (F.col("y") >= 10) & (F.col("z") >= 6)
    return contacts.drop_groups_touching(points(spark, d), ["seg_a", "seg_b"], edge).groupBy("seg_a", "seg_b").agg(F.count("*").alias("n"))


@query(f"SELECT seg_a, seg_b, count(*) AS n FROM ({POINTS}) GROUP BY seg_a, seg_b HAVING avg(aff) >= 0.0501")
def q11_mean_affinity(spark, d):
    return contacts.above_mean(points(spark, d), ["seg_a", "seg_b"], "aff", 0.0501).groupBy("seg_a", "seg_b").agg(F.count("*").alias("n"))


_REFS = "SELECT l_suppkey % 20 AS seg, l_partkey % 7 AS ref, count(*) AS n FROM lineitem WHERE l_suppkey % 20 <> 0 AND l_partkey % 7 <> 0 GROUP BY ALL"


@query(f"""WITH p AS ({POINTS}), edge AS (SELECT DISTINCT seg_a, seg_b FROM p WHERE x >= 50 AND y >= 10 AND z >= 6),
off AS (SELECT p.* FROM p ANTI JOIN edge USING (seg_a, seg_b)), kept AS (SELECT off.* FROM off SEMI JOIN (SELECT seg_a, seg_b FROM off GROUP BY ALL HAVING avg(aff) >= 0.0491) USING (seg_a, seg_b)),
centre AS ({_CENTRE.format('kept')} HAVING count(*) >= 20), m AS (SELECT seg_a, seg_b, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM kept GROUP BY ALL),
best AS (SELECT seg_a, seg_b, x, y, z FROM kept JOIN m USING (seg_a, seg_b) QUALIFY row_number() OVER (PARTITION BY seg_a, seg_b ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 9), x, y, z) = 1),
o AS ({_REFS}), r AS (SELECT seg, list(DISTINCT ref) AS refs FROM o WHERE n >= 60 GROUP BY seg)
SELECT centre.*, best.x, best.y, best.z, coalesce(list_has_any(a.refs, b.refs), false) AS should_merge FROM centre JOIN best USING (seg_a, seg_b) LEFT JOIN r a ON a.seg = seg_a LEFT JOIN r b ON b.seg = seg_b""")
def q12_contact_pipeline(spark, d):
    edge = (F.col("x") >= 50) & (F.col("y") >= 10) & (F.col("z") >= 6)
    refs = overlaps.overlap_counts(table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("s"), (F.col("l_partkey") % 7).alias("r")), "s", "r")
    out = contacts.contact_records(points(spark, d), refs, ["seg_a", "seg_b"], "aff", 20, 0.0491, edge, 60)
    return _rounded(out, "mean_weight", "com_x", "com_y", "com_z")


_FACE = "SELECT least(a.label, b.label) AS seg_a, greatest(a.label, b.label) AS seg_b, {} FROM v a JOIN v b ON {} WHERE a.label <> 0 AND b.label <> 0 AND a.label <> b.label"
_NEXT = {"x": "b.x = a.x + 1 AND b.y = a.y AND b.z = a.z", "y": "b.x = a.x AND b.y = a.y + 1 AND b.z = a.z", "z": "b.x = a.x AND b.y = a.y AND b.z = a.z + 1"}
_MIDDLE = {c: ", ".join(f"a.{a} + 0.5 AS {a}" if a == c else f"CAST(a.{a} AS DOUBLE) AS {a}" for a in "xyz") for c in "xyz"}


@query(f"WITH v AS ({VOXELS}) SELECT seg_a, seg_b, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM (" + " UNION ALL ".join(_FACE.format(_MIDDLE[a], _NEXT[a]) for a in "xyz") + ")")
def q13_axis_contacts(spark, d):
    return contacts.faces(voxels(spark, d))


@query(f"WITH v AS ({VOXELS}) SELECT a.x, a.y, a.z, CAST(a.label = b.label AND a.label <> 0 AS INTEGER) AS aff FROM v a JOIN v b ON b.x = a.x + 2 AND b.y = a.y + 1 AND b.z = a.z")
def q14_affinities(spark, d):
    return contacts.affinities(voxels(spark, d), (2, 1, 0))


_MORPH = "WITH v AS ({}), o AS (SELECT i, j FROM generate_series(-1, 1) a(i), generate_series(-1, 1) b(j) {}) SELECT v.x, v.y, v.z, {}(w.v) AS v FROM v, o JOIN v w ON w.x = v.x + o.i AND w.y = v.y + o.j AND w.z = v.z GROUP BY v.x, v.y, v.z"


@query(f"WITH v AS ({VOXELS}) SELECT a.x, a.y, a.z, min(b.v) AS v FROM v a JOIN v b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.z = b.z GROUP BY ALL")
def q15_erosion(spark, d):
    return grids.morphology(voxels(spark, d), "v", grids.footprint("square", 1), True)


@query(f"WITH v AS ({VOXELS}) SELECT a.x, a.y, a.z, max(b.v) AS v FROM v a JOIN v b ON abs(a.x - b.x) + abs(a.y - b.y) <= 2 AND a.z = b.z GROUP BY ALL")
def q16_dilation(spark, d):
    return grids.morphology(voxels(spark, d), "v", grids.footprint("diamond", 2), False)


_ERODE = "SELECT a.x, a.y, a.z, {}(b.v) AS v FROM {} a JOIN {} b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.z = b.z GROUP BY ALL"


@query(f"WITH v AS ({VOXELS}), e AS ({_ERODE.format('min', 'v', 'v')}) {_ERODE.format('max', 'e', 'e')}")
def q16a_opening(spark, d):
    return grids.opening(voxels(spark, d), "v", grids.footprint("square", 1))


@query(f"WITH v AS ({VOXELS}), e AS ({_ERODE.format('max', 'v', 'v')}) {_ERODE.format('min', 'e', 'e')}")
def q16b_closing(spark, d):
    return grids.closing(voxels(spark, d), "v", grids.footprint("square", 1))


@query(f"SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, round(avg(v) + 1e-9, 6) AS v FROM ({VOXELS}) GROUP BY ALL")
def q17_downsample_mean(spark, d):
    return _rounded(grids.downsample_mean(voxels(spark, d), "v", (2, 2, 2)), "v")


@query(f"SELECT x, y, z, label FROM (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, label, count(*) AS n FROM ({VOXELS}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY n DESC, label) = 1")
def q18_downsample_mode(spark, d):
    return grids.downsample_mode(voxels(spark, d), "label", (2, 2, 2))


@query(f"WITH a AS (SELECT x // 2 AS x, y // 2 AS y, z AS z, avg(v) AS v FROM ({VOXELS}) GROUP BY ALL), b AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, avg(v) AS v FROM a GROUP BY ALL) SELECT 1 AS level, x, y, z, round(v + 1e-9, 6) AS v FROM a UNION ALL SELECT 2, x, y, z, round(v + 1e-9, 6) FROM b")
def q18a_pyramid(spark, d):
    levels = grids.pyramid(voxels(spark, d), "v", [(2, 2, 1), (2, 2, 2)], False)
    return _rounded(levels[1].withColumn("level", F.lit(1)).unionByName(levels[2].withColumn("level", F.lit(2))), "v")


_CHUNKED = """WITH e AS (SELECT event_id AS pos, value FROM events), n AS (SELECT max(pos) // 500 AS final FROM e), c AS (SELECT i AS chunk, i * 500 AS lo, i * 500 + 500 AS hi, final FROM (SELECT unnest(generate_series(0, final)) AS i, final FROM n)),
j AS (SELECT pos, value, chunk, final, least(1.0, (pos + 0.5 - (lo - 25)) / 50.0) AS tl, least(1.0, (hi + 25 - (pos + 0.5)) / 50.0) AS th FROM e JOIN c ON pos >= lo - 25 AND pos < hi + 25)"""
_RAMPS = {"linear": "{t}", "quadratic": "CASE WHEN {t} < 0.5 THEN 2 * {t} * {t} ELSE 1 - 2 * (1 - {t}) * (1 - {t}) END", "bump": "exp(-1 / (1 - ({t} - 1) * ({t} - 1))) / (exp(-1 / (1 - ({t} - 1) * ({t} - 1))) + exp(-1 / (1 - {t} * {t})))"}


def _blend_sql(kind):
    side = lambda t, end: f"CASE WHEN chunk = {end} OR {t} >= 1 THEN 1.0 ELSE {_RAMPS[kind].format(t=t)} END"
    return f"{_CHUNKED} SELECT pos, round(sum(({side('tl', 0)}) * ({side('th', 'final')}) * (value * (1 + chunk % 2))) + 1e-9, 6) AS value FROM j GROUP BY pos"


def _blended(spark, d, kind):
    """All events, over chunks up to the last event's."""
    e = table(spark, d, "events").select(F.col("event_id").alias("pos"), "value")
    last = e.agg(F.max("pos")).first()[0]
    rows = grids.overlapped(e, "pos", 500, 25, 0, 0 if last is None else last + 1)
    return grids.blend(rows, "pos", F.col("value") * (1 + F.col("chunk") % 2), kind, 25)


@query(_blend_sql("linear"))
def q19_blend_linear(spark, d):
    return _rounded(_blended(spark, d, "linear"), "value")


@query(_blend_sql("quadratic"))
def q20_blend_quadratic(spark, d):
    return _rounded(_blended(spark, d, "quadratic"), "value")


@query(_blend_sql("bump"))
def q21_blend_bump(spark, d):
    return _rounded(_blended(spark, d, "bump"), "value")


@query(f"{_CHUNKED} SELECT pos, greatest(max(value * (1 + chunk % 2)), 0.0) AS value FROM j GROUP BY pos")
def q22_blend_max(spark, d):
    return _blended(spark, d, "max")


@query("""WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS median FROM events GROUP BY ALL), o AS (SELECT event_id, user_id, value, median, abs(value - median) AS off FROM events JOIN m USING (user_id)), s AS (SELECT user_id, quantile_cont(off, 0.5) * 1.4826 AS mad FROM o GROUP BY ALL)
SELECT event_id, round(median + 1e-9, 6) AS median, off > mad * 1.5 AS outlier, round(CASE WHEN off > mad * 1.5 THEN median ELSE value END + 1e-9, 6) AS filtered FROM o JOIN s USING (user_id)""")
def q23_median_outliers(spark, d):
    out = grids.median_outliers(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], "value", 1.5)
    return _rounded(out.select("event_id", "median", "outlier", "filtered"), "median", "filtered")


@query(f"SELECT x, y, arg_min(label, z) AS label, min(z) AS z FROM ({VOXELS}) WHERE label <> 0 GROUP BY x, y")
def q24_first_hit(spark, d):
    return grids.first_hit(voxels(spark, d), "label")


_EDGES = f"v AS ({VOXELS}), e AS (" + " UNION ALL ".join(f"SELECT a.node AS a, b.node AS b FROM v a JOIN v b ON {_NEXT[c]} WHERE a.label <> 0 AND a.label = b.label" for c in "xyz") + "), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"
_COMPONENTS = f"WITH RECURSIVE {_EDGES}, r(node, low) AS (SELECT a, a FROM sym UNION SELECT sym.b, r.low FROM r JOIN sym ON sym.a = r.node WHERE r.low < sym.b), c AS (SELECT node, min(low) AS component FROM (SELECT * FROM r UNION ALL SELECT b, a FROM sym WHERE a < b) GROUP BY node)"


def _labelled(spark, d):
    v = voxels(spark, d)
    return v, components.connected_components(grids.grid_edges(v, "node", "label"))


@query(f"{_COMPONENTS} SELECT node, component FROM c")
def q25_connected_components(spark, d):
    return _labelled(spark, d)[1]


@query(f"{_COMPONENTS}, s AS (SELECT component, count(*) AS n FROM c GROUP BY ALL), big AS (SELECT component, n FROM s ORDER BY n DESC, component LIMIT 1), k AS (SELECT v.* FROM v JOIN c USING (node) JOIN big USING (component)), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM k) SELECT x, y, z, big.component, big.n FROM k, m, big ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 9), x, y, z LIMIT 1")
def q26_largest_component_centre(spark, d):
    v, c = _labelled(spark, d)
    big = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    members = v.join(c, "node").join(F.broadcast(big), "component")
    return contacts.nearest_to_mean(members, ["component", "n"]).select("x", "y", "z", "component", "n")


@query(f"{_COMPONENTS}, s AS (SELECT component, count(*) AS n FROM c GROUP BY ALL) SELECT CASE WHEN n > 6 THEN 'large' ELSE 'small' END AS kept, count(*) AS n_components, CAST(sum(n) AS BIGINT) AS n_voxels FROM s GROUP BY ALL")
def q26a_component_filter(spark, d):
    """Components above a size, and those up to it."""
    sizes = _labelled(spark, d)[1].groupBy("component").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.when(F.col("n") > 6, "large").otherwise("small").alias("kept")).agg(F.count("*").alias("n_components"), F.sum("n").alias("n_voxels"))


@query(f"WITH v AS ({VOXELS}), b AS (SELECT v.label AS own, w.label AS other FROM v JOIN v w ON abs(v.x - w.x) <= 1 AND abs(v.y - w.y) <= 1 AND v.z = w.z WHERE v.label <> 0 AND w.label <> 0 AND v.label <> w.label), n AS (SELECT own, other, count(*) AS n FROM b GROUP BY ALL) SELECT own, other AS label, n FROM n QUALIFY row_number() OVER (PARTITION BY own ORDER BY n DESC, other) = 1")
def q26b_dominant_neighbour(spark, d):
    """The label most often met around each label."""
    v = voxels(spark, d)
    moves = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in grids.footprint("square", 1)])
    sent = v.where("label <> 0").select("z", F.col("label").alias("other"), F.explode(moves).alias("m"), "x", "y").select((F.col("x") + F.col("m.i")).alias("x"), (F.col("y") + F.col("m.j")).alias("y"), "z", "other")
    met = v.where("label <> 0").select("x", "y", "z", F.col("label").alias("own")).join(sent, ["x", "y", "z"]).where("own <> other")
    return overlaps.modal_label(met, ["own"], "other")


@query("SELECT l_orderkey, l_linenumber, ((cx & 1) | ((cy & 1) << 1) | ((cz & 1) << 2) | (((cx >> 1) & 1) << 3) | (((cy >> 1) & 1) << 4) | (((cx >> 2) & 1) << 5)) AS code FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 8) AS BIGINT) AS cx, CAST(floor(round(l_discount * 100, 0) / 3) AS BIGINT) AS cy, CAST(floor(round(l_tax * 100, 0) / 5) AS BIGINT) AS cz FROM lineitem)")
def q59_morton_codes(spark, d):
    at = S.chunk_index([F.col("l_quantity"), F.round(F.col("l_discount") * 100, 0), F.round(F.col("l_tax") * 100, 0)], (1, 1, 1), (0, 0, 0), (8, 3, 5))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.morton(at, (8, 4, 2)).alias("code"))


@query("SELECT o_orderkey, (o_orderkey >> 2) & 3 AS minishard, (o_orderkey >> 4) & 7 AS shard FROM orders")
def q60_shards(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.minishard(k, 2, 2).alias("minishard"), S.shard(k, 2, 2, 3).alias("shard"))


@query(f"WITH p AS ({POINTS}), l AS (SELECT 0 AS level, CAST(floor(x / 50) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 1, CAST(floor(x / 25) AS BIGINT), CAST(floor(y / 5) AS BIGINT), count(*) FROM p GROUP BY ALL UNION ALL SELECT 2, CAST(floor(x / 12.5) AS BIGINT), CAST(floor(y / 2.5) AS BIGINT), count(*) FROM p GROUP BY ALL) SELECT level, count(*) AS n_cells, max(n) AS most FROM l GROUP BY level")
def q62_spatial_levels(spark, d):
    """Cells and the fullest cell of each level of a spatial index; one pass over the points for all levels."""
    p = points(spark, d)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("x") / (50 / 2**k)).alias("cx"), F.floor(F.col("y") / (10 / 2**k)).alias("cy")) for k in range(3)])
    cells = p.select(F.explode(levels).alias("c")).groupBy("c.level", "c.cx", "c.cy").agg(F.count("*").alias("n"))
    return cells.groupBy("level").agg(F.count("*").alias("n_cells"), F.max("n").alias("most"))


@query("SELECT p_partkey AS n, p_partkey % 7 AS cx, (p_partkey // 7) % 5 AS cy, p_partkey // 35 AS cz, ((p_partkey % 7) % 2) * 4 + (((p_partkey // 7) % 5) % 2) * 2 + (p_partkey // 35) % 2 AS colour, (p_partkey % 7) * 64 + 3 AS x0, (p_partkey % 7) * 64 + 67 AS x1 FROM part")
def q56_strided_boxes(spark, d):
    cx, cy, cz = (c.cast("long") for c in S.nth_chunk(F.col("p_partkey"), (7, 5, 1 << 30)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), cx.alias("cx"), cy.alias("cy"), cz.alias("cz"), S.colour((cx, cy, cz)).alias("colour"), (cx * 64 + 3).alias("x0"), (cx * 64 + 67).alias("x1"))
