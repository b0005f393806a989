"""Queries of the array, vector and box operators on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..functions import boxes, scalar, vectors
from ..operators import shapes
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


def _round(df, *columns):
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns})


@query("SELECT event_id, round(value * 2 + 1e-9, 6) AS doubled, round(value + 3 + 1e-9, 6) AS added, round(value ** 2 + 1e-9, 6) AS squared, round(value / 4 + 1e-9, 6) AS quarter, CAST(floor(value / 4) AS BIGINT) AS whole, abs(value - 10) AS apart, CAST(CAST(value AS FLOAT) AS DOUBLE) AS f32, CAST(floor(least(greatest(value, 0), 255)) AS SMALLINT) AS u8 FROM events")
def q89_elementwise(spark, d):
    """Elementwise arithmetic and casts on chosen columns."""
    e, v = table(spark, d, "events"), F.col("value")
    out = e.select("event_id", (v * 2).alias("doubled"), (v + 3).alias("added"), F.pow(v, 2).alias("squared"), (v / 4).alias("quarter"), scalar.int_divide(v, 4).cast("long").alias("whole"), F.abs(v - 10).alias("apart"), v.cast("float").cast("double").alias("f32"), F.floor(scalar.clamped(v, 0, 255)).cast("short").alias("u8"))
    return shapes.applied(out, lambda c: F.round(c + 1e-9, 6), ["doubled", "added", "squared", "quarter"])


@query(f"SELECT z AS i0, y * 10 + x AS i1, v FROM ({VOXELS})")
def q90_rearrange(spark, d):
    """x y z -> z (y x)."""
    return shapes.rearranged(voxels(spark, d).select("x", "y", "z", "v"), ["x", "y", "z"], ["z", ["y", "x"]], {"x": 10, "y": 10})


@query("SELECT p_partkey // 6 AS a, (p_partkey // 2) % 3 AS b, p_partkey % 2 AS c, p_size FROM part")
def q91_split_axis(spark, d):
    """One axis as (a b c) of which the last two have sizes 3 and 2."""
    n = table(spark, d, "part").agg(F.max("p_partkey")).first()[0] or 0
    return shapes.split_axis(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", ["a", "b", "c"], [n // 6 + 1, 3, 2])


@query(f"SELECT 'sum' AS how, x, y, round(sum(label) + 1e-9, 6) AS v FROM ({VOXELS}) GROUP BY ALL UNION ALL SELECT 'mean', x, y, round(avg(label) + 1e-9, 6) FROM ({VOXELS}) GROUP BY ALL UNION ALL SELECT 'max', x, y, max(label) FROM ({VOXELS}) GROUP BY ALL UNION ALL SELECT 'min', x, y, min(label) FROM ({VOXELS}) GROUP BY ALL UNION ALL SELECT 'prod', x, y, sum(CASE label WHEN 4 THEN 1 WHEN 3 THEN -1 ELSE 0 END) FROM ({VOXELS}) GROUP BY ALL")
def q92_reduce(spark, d):
    """Reductions over z; the product is one of halves and twos, given as its power of two."""
    v = voxels(spark, d).select("x", "y", "z", F.col("label").cast("double").alias("v"))
    powers = v.withColumn("v", F.when(F.col("v") == 4, 2.0).when(F.col("v") == 3, 0.5).otherwise(1.0))
    parts = [shapes.reduced(v if how != "prod" else powers, ["x", "y"], how).withColumn("how", F.lit(how)) for how in ("sum", "mean", "max", "min", "prod")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _round(out.withColumn("v", F.when(F.col("how") == "prod", F.round(F.log2("v"), 0)).otherwise(F.col("v"))), "v").withColumn("v", F.when(F.col("how") == "prod", F.round("v", 0)).otherwise(F.col("v")))


@query(f"SELECT x, y, z, c, v FROM ({VOXELS}), (SELECT unnest(generate_series(0, 2)) AS c)")
def q93_repeat(spark, d):
    """A new axis of three slices, on an array whose axis of one slice is dropped and put back."""
    one = shapes.squeezed(voxels(spark, d).select("x", "y", "z", "v", F.lit(0).alias("t")), "t")
    return shapes.repeated(one, "c", 3)


@query(f"SELECT 'crop' AS how, x - 1 AS x, y - 2 AS y, z, v FROM ({VOXELS}) WHERE x >= 1 AND x < 9 AND y >= 2 AND y < 8 UNION ALL SELECT 'centre', x - 2, y - 3, z, v FROM ({VOXELS}) WHERE x >= 2 AND x < 7 AND y >= 3 AND y < 7")
def q94_crop(spark, d):
    v, sizes = voxels(spark, d).select("x", "y", "z", "v"), {"x": 10, "y": 10}
    return shapes.cropped(v, sizes, {"x": 1, "y": 2}).withColumn("how", F.lit("crop")).unionByName(shapes.cropped_centre(v, sizes, {"x": 5, "y": 4}).withColumn("how", F.lit("centre")))


_PAD = {"replicate": "least(greatest(i - 2, 0), 9)", "circular": "(i - 2 + 10) % 10", "reflect": "CASE WHEN i - 2 < 0 THEN 2 - i WHEN i - 2 > 9 THEN 18 - (i - 2) ELSE i - 2 END"}


@query(f"WITH v AS ({VOXELS}), g AS (SELECT unnest(generate_series(0, 13)) AS i) SELECT 'constant' AS mode, i AS x, y, z, coalesce(v.v, -1.0) AS v FROM g CROSS JOIN (SELECT DISTINCT y, z FROM v) q LEFT JOIN (SELECT x, y AS y2, z AS z2, v FROM v) v ON v.x = i - 2 AND v.y2 = y AND v.z2 = z" + "".join(f" UNION ALL SELECT '{mode}', i, y, z, v FROM g JOIN v ON v.x = {source}" for mode, source in _PAD.items()))
def q95_pad_centre(spark, d):
    """Ten positions in the middle of fourteen, padded in four ways."""
    v, out = voxels(spark, d).select("x", "y", "z", "v"), None
    for mode in ("constant", *_PAD):
        one = shapes.padded_centre(v, {"x": 10}, {"x": 14}, mode, -1.0).select(F.lit(mode).alias("mode"), F.col("x").cast("long").alias("x"), "y", "z", "v")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH v AS ({VOXELS}), g AS (SELECT unnest(generate_series(0, 19)) AS i), s AS (SELECT i, greatest(least((i + 0.5) / 2 - 0.5, 9.0), 0.0) AS spot FROM g)
SELECT 'nearest' AS mode, i AS x, y, z, v FROM g JOIN v ON v.x = i // 2 UNION ALL SELECT 'field', i, y, z, 2 * v FROM g JOIN v ON v.x = i // 2
UNION ALL SELECT 'linear', i, y, z, round(sum(v * (1 - abs(spot - v.x))) + 1e-9, 6) FROM s JOIN v ON abs(spot - v.x) < 1 GROUP BY i, y, z UNION ALL SELECT 'mask', i, y, z, CASE WHEN sum(v * (1 - abs(spot - v.x))) > 1500 THEN 1 ELSE 0 END FROM s JOIN v ON abs(spot - v.x) < 1 GROUP BY i, y, z""")
def q96_interpolate(spark, d):
    """Upsampling by two along x: nearest, displacement, linear, and a mask of the linear one."""
    v = voxels(spark, d).select("x", "y", "z", "v")
    linear = shapes.upsampled_linear(v, "x", 10, 2)
    parts = {"nearest": shapes.upsampled(v, ["x"], [2]), "field": shapes.upsampled(v, ["x"], [2], 2.0), "linear": _round(linear, "v"), "mask": shapes.thresholded(linear, 1500)}
    out = None
    for mode, one in parts.items():
        one = one.select(F.lit(mode).alias("mode"), F.col("x").cast("long").alias("x"), "y", "z", F.col("v").cast("double").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


_ERODED = "SELECT x, y, z, CAST(label AS DOUBLE) AS v FROM {0} a WHERE label <> 0 AND NOT EXISTS (SELECT 1 FROM {0} b WHERE b.z = a.z AND b.label = 0 AND ((b.x = a.x AND abs(b.y - a.y) <= 1) OR (b.y = a.y AND abs(b.x - a.x) <= 1)))"
_TWO = f"WITH a AS ({VOXELS}), b AS (SELECT x, y, z, (label + 1) % 5 AS label FROM a), ea AS ({_ERODED.format('a')}), eb AS ({_ERODED.format('b')})"


def _two(spark, d):
    v = voxels(spark, d)
    a = v.select("x", "y", "z", F.col("label").cast("double").alias("v"))
    return a, v.select("x", "y", "z", ((F.col("label") + 1) % 5).cast("double").alias("v"))


def _eroded(f, spark, d):
    """In planes: the third axis takes part in the position only."""
    a, b = (x.withColumn("x", F.col("z") * 16 + F.col("x")).select("x", "y", "v") for x in _two(spark, d))
    # planes lie 16 apart, and the gap between them holds nothing
    out = f(a, b, ["x", "y"], {"x": 1 << 20, "y": 10}, 1)
    return out.select((F.col("x") % 16).alias("x"), "y", F.floor(F.col("x") / 16).alias("z"), "v")


@query(f"{_TWO} SELECT a.x, a.y, a.z, CASE WHEN ea.v IS NOT NULL AND eb.v IS NOT NULL THEN abs(ea.v - eb.v) ELSE 0.0 END AS v FROM a LEFT JOIN ea ON ea.x = a.x AND ea.y = a.y AND ea.z = a.z LEFT JOIN eb ON eb.x = a.x AND eb.y = a.y AND eb.z = a.z")
def q97_pixel_error(spark, d):
    return _eroded(shapes.pixel_error, spark, d)


@query(f"{_TWO} SELECT a.x, a.y, a.z, coalesce((ea.v + eb.v) / 2, ea.v, eb.v, 0.0) AS v FROM a LEFT JOIN ea ON ea.x = a.x AND ea.y = a.y AND ea.z = a.z LEFT JOIN eb ON eb.x = a.x AND eb.y = a.y AND eb.z = a.z")
def q98_erode_combine(spark, d):
    return _eroded(shapes.erode_combined, spark, d)


@query("SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity + l_linenumber AS ax, l_quantity * 2 AS mx, CAST(floor(l_quantity / 4) AS BIGINT) AS fx, l_quantity - 7 * floor(l_quantity / 7) AS rx, l_quantity ** 2 AS px, l_quantity < l_linenumber AND l_discount * 100 < l_linenumber AND l_tax * 100 < l_linenumber AS below, l_quantity <= 10 * l_linenumber AND l_discount <= l_linenumber AND l_tax <= l_linenumber AS within, abs(l_discount - l_tax) <= greatest(1e-5 * greatest(abs(l_discount), abs(l_tax)), 1e-8) AS same, round(l_quantity * 4 / 16, 10) AS cx, round_even(l_discount * 1.5, 2) AS bx FROM lineitem")
def q99_vectors(spark, d):
    """Vector arithmetic; comparisons that must hold on all axes."""
    q, n, a, t = (F.col(c) for c in ("l_quantity", "l_linenumber", "l_discount", "l_tax"))
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + n).alias("id"), vectors.add([q], [n])[0].alias("ax"), vectors.multiply([q], 2)[0].alias("mx"), vectors.floor_divide([q], 4)[0].alias("fx"), vectors.modulo([q], 7)[0].alias("rx"), vectors.power([q], 2)[0].alias("px"),
        vectors.less([q, a * 100, t * 100], [n, n, n]).alias("below"), vectors.less_equal([q, a, t], [n * 10, n, n]).alias("within"), vectors.all_close([a, q], [t, q]).alias("same"), vectors.converted([q], [4], [16])[0].alias("cx"), vectors.rounded([a * 1.5], 2)[0].alias("bx"),
    )


_B = "SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS x0, l_quantity + l_linenumber AS x1, round(l_tax * 100, 0) AS y0, round(l_tax * 100, 0) + 4 AS y1 FROM lineitem"


def _b(spark, d):
    q, t = F.col("l_quantity"), F.round(F.col("l_tax") * 100, 0)
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), q.alias("x0"), (q + F.col("l_linenumber")).alias("x1"), t.alias("y0"), (t + 4).alias("y1"))


@query(f"SELECT id, CAST(floor(x0 / 4) AS BIGINT) AS i0, CAST(ceil(x1 / 4) AS BIGINT) AS i1, CAST(x0 AS BIGINT) AS j0, CAST(x1 AS BIGINT) AS j1, x0 + 8 AS s0, x1 AS s1, x0 AS e0, x1 + 8 AS e1, y0 AS t0, y1 AS t1, x0 AS l0, x0 + (y1 - y0) AS l1, least(x0, 20.0) * 2 AS c0, greatest(x0, 20.0) * 2 AS c1, y0 = 3 AS a0, y1 = 7 AS a1, CAST(5 AS DOUBLE) AS o0, 5 + (x1 - x0) AS o1, x0 AS z0, x0 + 9 AS z1, CAST(ceil(round(x0 / 4 - 2.5, 10)) AS BIGINT) AS g0 FROM ({_B})")
def q100_box_functions(spark, d):
    """Slices, shifts, axis swaps, corners, alignment, overrides."""
    b = _b(spark, d)
    x, y = (F.col("x0"), F.col("x1")), (F.col("y0"), F.col("y1"))
    named = {
        "i": boxes.slices([x], [4], rounding=True)[0], "j": boxes.slices([x], [1])[0], "s": boxes.moved([x], [2], [4], stop=False)[0], "e": boxes.moved([x], [2], [4], start=False)[0], "t": boxes.transposed([x, y], 0, 1)[0], "l": boxes.transposed([x, y], 0, 1, local=True)[0],
        "c": boxes.from_corners([x[0]], [20.0], [2])[0], "a": boxes.aligned([y], [(3, 7)]), "o": boxes.overridden([x], [F.lit(5.0)], [None])[0], "z": boxes.overridden([x], [None], [9])[0],
    }
    return b.select("id", *(c.alias(f"{n}{k}") for n, pair in named.items() for k, c in enumerate(pair)), boxes.centred([x[0]], [5], [4])[0][0].alias("g0"))


@query(f"SELECT id, part, round(x0 + (part // 3) * (x1 - x0) / 2, 10) AS x0, round(x0 + (part // 3 + 1) * (x1 - x0) / 2, 10) AS x1, round(y0 + (part % 3) * (y1 - y0) / 3, 10) AS y0, round(y0 + (part % 3 + 1) * (y1 - y0) / 3, 10) AS y1 FROM ({_B}), (SELECT CAST(unnest(generate_series(0, 5)) AS INTEGER) AS part)")
def q101_box_parts(spark, d):
    """Boxes cut into two by three parts."""
    return boxes.parts(_b(spark, d), [("x0", "x1"), ("y0", "y1")], [2, 3])


@query(f"WITH m AS (SELECT min(x0) AS a, max(x1) AS b, min(y0) AS c, max(y1) AS d FROM ({_B})), i AS (SELECT unnest(generate_series(CAST(floor(a / 16) AS BIGINT), CAST(ceil(b / 16) AS BIGINT) - 1)) AS i, a, b FROM m), j AS (SELECT unnest(generate_series(CAST(floor(c / 5) AS BIGINT), CAST(ceil(d / 5) AS BIGINT) - 1)) AS j, c, d FROM m) SELECT greatest(i * 16.0, a) AS x0, least((i + 1) * 16.0, b) AS x1, greatest(j * 5.0, c) AS y0, least((j + 1) * 5.0, d) AS y1 FROM i, j")
def q102_exact_chunks(spark, d):
    """The grid over the extent of all boxes, partial cells at its edges."""
    m = _b(spark, d).agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    return boxes.exact_chunks(spark, (m[0], m[2]), (m[1], m[3]), (16.0, 5.0))


@query(f"SELECT id, CAST(floor(x0 / 16) AS BIGINT) * 4 AS first, (CAST(floor(x0 / 16) AS BIGINT) + 1) * 4 AS after FROM ({_B})")
def q103_child_cells(spark, d):
    first, after = boxes.child_cells([F.floor(F.col("x0") / 16)], [16], [4])[0]
    return _b(spark, d).select("id", first.alias("first"), after.alias("after"))
