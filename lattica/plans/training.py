"""Queries of the augmentation, dataset and document helpers on the driver's tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import augment, datasets, docstore
from ..sources import files
from .flows import scratch
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


def _u(seed: int, *key: str) -> str:
    """The SQL of a seeded uniform number."""
    return f"(CAST(('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key) + "), 1, 8)) AS BIGINT) / 4294967296.0)"


def _n(seed: int, *key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_u(seed, *key, chr(39) + 'u' + chr(39))})) * cos({2 * math.pi} * {_u(seed, *key, chr(39) + 'v' + chr(39))}))"


def _r(df, *columns):
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns})


@query(f"SELECT event_id, round(CASE WHEN {_u(1, 'event_id')} < 0.3 THEN value * 2 ELSE value END + 1e-9, 6) AS sometimes, round(CASE WHEN value > 5 THEN value + (1 + {_u(2, 'event_id')} * 2) ELSE value END + 1e-9, 6) AS added, round(value + 0.5 * {_n(3, 'event_id')} + 1e-9, 6) AS noisy FROM events")
def q143_random_values(spark, d):
    """Changes by chance, amounts under a mask, normal noise."""
    e, k, v = table(spark, d, "events"), F.col("event_id"), F.col("value")
    out = e.select("event_id", augment.with_probability(0.3, 1, [k], v * 2, v).alias("sometimes"), augment.scalar_added(v, augment.uniform_between(2, 1, 3, k), v > 5).alias("added"), (v + augment.normal(3, 0.0, 0.5, k)).alias("noisy"))
    return _r(out, "sometimes", "added", "noisy")


@query(f"SELECT x, y, z, round(CASE WHEN v = 905 THEN v ELSE v + CASE WHEN x % 4 < 3 AND y % 4 < 3 THEN -8 + {_u(5, 'x // 4', 'y // 4')} * 16 ELSE 0 END END + 1e-9, 6) AS v FROM ({VOXELS})")
def q144_tile_pattern(spark, d):
    v = voxels(spark, d)
    return _r(v.select("x", "y", "z", augment.tile_pattern(F.col("v"), [F.col("x"), F.col("y")], 3, 4, 8.0, 5, keep=905.0).alias("v")), "v")


@query(f"WITH v AS ({VOXELS}), s AS (SELECT z FROM (SELECT DISTINCT z FROM v) ORDER BY {_u(6, 'z')}, z LIMIT 2) SELECT x, y, v.z, CASE WHEN v.z IN (SELECT z FROM s) THEN 0.0 ELSE v END AS v FROM v")
def q145_random_sections(spark, d):
    """Two sections blanked."""
    out = augment.random_sections(voxels(spark, d).select("x", "y", "z", "v"), "z", 2, 6)
    return out.select("x", "y", "z", F.when(F.col("chosen"), 0.0).otherwise(F.col("v")).alias("v"))


_BOXES = [[f"floor(-2 + {_u(7, str(k), str(i))} * 10)" for i in range(2)] for k in range(3)]


@query(f"SELECT x, y, z, CASE WHEN {' OR '.join(f'(x >= {a} AND x < {a} + 4 AND y >= {b} AND y < {b} + 4)' for a, b in _BOXES)} THEN -v ELSE v END AS v FROM ({VOXELS})")
def q146_random_boxes(spark, d):
    """Values negated inside as many boxes of four by four as cover about half of ten by ten."""
    n = augment.boxes_for_density((10, 10), (4, 4), 0.5)
    x, y = F.col("x"), F.col("y")
    hit = augment.in_any([x, y], augment.random_boxes((10, 10), (4, 4), n, 7))
    return voxels(spark, d).select("x", "y", "z", F.when(hit, -F.col("v")).otherwise(F.col("v")).alias("v"))


def _perlin(x: str, y: str, cell: int, seed: int) -> str:
    i, j, u, v = f"({x} // {cell})", f"({y} // {cell})", f"(({x} % {cell} + 0.5) / {cell})", f"(({y} % {cell} + 0.5) / {cell})"
    fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"
    corner = lambda a, b: f"(cos({2 * math.pi} * {_u(seed, f'({i} + {a})', f'({j} + {b})')}) * ({u} - {a}) + sin({2 * math.pi} * {_u(seed, f'({i} + {a})', f'({j} + {b})')}) * ({v} - {b}))"
    low, high = (f"({corner(0, b)} + {fade(u)} * ({corner(1, b)} - {corner(0, b)}))" for b in (0, 1))
    return f"({math.sqrt(2)} * ({low} + {fade(v)} * ({high} - {low})))"


@query(f"SELECT p_partkey, round({_perlin('(p_partkey % 40)', '(p_partkey // 40)', 8, 11)} + 1e-9, 6) AS one, round({_perlin('(p_partkey % 40)', '(p_partkey // 40)', 8, 11)} + 0.5 * {_perlin('(p_partkey % 40)', '(p_partkey // 40)', 4, 12)} + 1e-9, 6) AS two FROM part")
def q147_gradient_noise(spark, d):
    k = F.col("p_partkey")
    x, y = k % 40, F.floor(k / 40)
    return _r(table(spark, d, "part").select("p_partkey", augment.perlin(x, y, 8, 11).alias("one"), augment.perlin_octaves(x, y, 8, 2, 0.5, 11).alias("two")), "one", "two")


@query("""WITH e AS (SELECT event_id, event_type, value / 200 AS v, CAST(least(floor(value / 200 * 16), 15) AS INTEGER) AS bin FROM events), c AS (SELECT event_type, bin, count(*) AS n FROM e GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total FROM c),
o AS (SELECT *, greatest(n - 0.2 * total, 0.0) AS over_ FROM t), s AS (SELECT *, sum(over_) OVER (PARTITION BY event_type) AS spare FROM o), l AS (SELECT event_type, bin, (sum(n - over_) OVER (PARTITION BY event_type ORDER BY bin) + spare * (bin + 1) / 16.0) / total AS level FROM s)
SELECT event_id, round(level + 1e-9, 6) AS v FROM e JOIN l USING (event_type, bin)""")
def q148_equalised(spark, d):
    """Contrast-limited histogram equalisation of each event type's values."""
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("value") / 200).alias("v"))
    return _r(augment.equalised(e, ["event_type"], "v", 0.2, 16).select("event_id", "v"), "v")


@query("SELECT vec_id, true AS kept FROM embeddings")
def q149_rotation(spark, d):
    """Points turned at random keep their distances from the origin."""
    p = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.array(*(F.element_at("embedding", (i + k).cast("int")).cast("double") for k in (0, 10, 20)))).alias("p"))
    square = lambda q: F.transform(q, lambda x: x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    turned = p.withColumn("q", augment.rotated(F.col("p"), 4, F.col("vec_id")))
    return turned.select("vec_id", F.forall(F.arrays_zip(square(F.col("p")).alias("a"), square(F.col("q")).alias("b")), lambda z: F.abs(z["a"] - z["b"]) < 1e-9).alias("kept"))


@query(f"WITH v AS ({VOXELS}), b AS (SELECT l_linenumber AS n, l_linenumber - 2 AS sx, 7 - l_linenumber AS sy, 0 AS sz FROM lineitem GROUP BY ALL) SELECT n, CAST(((x - sx) * 4 + (y - sy)) * 2 + (z - sz) AS INTEGER) AS place, v FROM b JOIN v ON x >= sx AND x < sx + 4 AND y >= sy AND y < sy + 4 AND z >= sz AND z < sz + 2")
def q150_layer_samples(spark, d):
    """Boxes of an index read from a layer."""
    n = F.col("l_linenumber")
    index = table(spark, d, "lineitem").select(n.alias("n"), (n - 2).alias("x"), (7 - n).alias("y"), F.lit(0).alias("z")).distinct()
    return datasets.layer_samples(index, voxels(spark, d).select("x", "y", "z", "v"), ["x", "y", "z"], [4, 4, 2])


@query("""WITH c AS (SELECT l_suppkey AS contact_id, l_linenumber AS f FROM lineitem), a AS (SELECT contact_id, list(f ORDER BY f) AS faces FROM c WHERE contact_id % 3 <> 0 AND contact_id % 5 <> 0 GROUP BY ALL)
SELECT contact_id, contact_id % 2 = 0 AS target, CAST(list_sum(faces[1:20]) AS BIGINT) AS face_sum, CAST(least(len(faces), 20) AS BIGINT) AS n_real, 20 AS n_faces FROM a""")
def q151_contact_samples(spark, d):
    """Decided contacts with twenty faces each, cut or padded."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("contact_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("f")))).alias("contact_faces"))
    k = F.col("contact_id")
    c = c.withColumn("merge_decisions", F.when(k % 3 != 0, F.create_map(F.lit("human"), k % 2 == 0)).otherwise(F.create_map(F.lit("model"), F.lit(True)))).withColumn("cloud", F.when(k % 5 != 0, F.lit(1)))
    out = datasets.contact_samples(c, "human", 20, ["cloud"])
    return out.select("contact_id", "target", F.aggregate("faces", F.lit(0).cast("long"), lambda acc, x: acc + x["f"]).alias("face_sum"), F.size(F.filter("faces_valid", lambda v: v)).cast("long").alias("n_real"), F.size("faces").alias("n_faces"))


@query("""WITH a AS (SELECT c_custkey AS id, c_custkey % 7 AS x0, c_custkey % 7 + 10 + c_custkey % 5 AS x1, 0 AS y0, 8 + c_custkey % 3 AS y1 FROM customer WHERE c_nationkey % 5 = 3 AND c_custkey % 2 = 0), g AS (SELECT *, (x1 - x0 - 8) // 2 + 1 AS nx, (y1 - y0 - 8) // 1 + 1 AS ny FROM a)
SELECT id, n, x0 + (n % nx) * 2 AS x, y0 + (n // nx) % ny AS y FROM g, LATERAL (SELECT unnest(generate_series(0, nx * ny - 1)) AS n)""")
def q152_collection_boxes(spark, d):
    """Strided boxes inside the annotated boxes of a collection with a tag."""
    k = F.col("c_custkey")
    a = table(spark, d, "customer").select(k.alias("id"), (F.col("c_nationkey") % 5).cast("string").alias("collection"), F.when(k % 2 == 0, F.array(F.lit("train"), F.lit("good"))).otherwise(F.array(F.lit("good"))).alias("tags"), (k % 7).alias("x0"), (k % 7 + 10 + k % 5).alias("x1"), F.lit(0).alias("y0"), (8 + k % 3).alias("y1"))
    return datasets.collection_boxes(a, "3", ["train"], [8, 8], [2, 1], ["x", "y"])


@query("SELECT user_id, event_type AS outer_key, string_agg(inner_key || '=' || v, ',' ORDER BY inner_key) AS inner_values FROM (SELECT user_id, event_type, CAST(event_id % 3 AS VARCHAR) AS inner_key, max(event_id) AS v FROM events GROUP BY ALL) GROUP BY ALL")
def q153_dotted_keys(spark, d):
    """Documents from dotted paths."""
    rows = table(spark, d, "events").select("user_id", F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string")).alias("path"), "event_id")
    docs = docstore.expanded(rows, "user_id", "path", "event_id").select("user_id", F.explode("doc").alias("outer_key", "j"))
    inner = F.map_entries(F.from_json("j", "map<string, bigint>"))
    return docs.select("user_id", "outer_key", F.array_join(F.transform(F.array_sort(inner), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("inner_values"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS a, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'more' ELSE 'old' END AS b FROM customer UNION ALL SELECT -1, 'new', NULL")
def q154_documents_merged(spark, d):
    """Entries of changes in place of the documents' own; a document that only the changes have is added."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    have = c.select(k.alias("id"), F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("old")).alias("doc"))
    changes = c.where(k % 3 == 0).select(k.alias("id"), F.when(k % 2 == 0, F.create_map(F.lit("a"), F.lit("new"), F.lit("b"), F.lit("more"))).otherwise(F.create_map(F.lit("a"), F.lit("new"))).alias("doc"))
    changes = changes.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.create_map(F.lit("a"), F.lit("new")).alias("doc")))
    return docstore.merged(have, changes, "id", "doc").select("id", F.try_element_at("doc", F.lit("a")).alias("a"), F.try_element_at("doc", F.lit("b")).alias("b"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'line' WHEN 2 THEN 'ellipsoid' END AS kind, CASE WHEN event_id % 4 <> 3 THEN CAST(event_id AS DOUBLE) END AS ax, CASE WHEN event_id % 4 = 1 THEN CAST(event_id + 1 AS DOUBLE) END AS bx, CASE WHEN event_id % 4 = 2 THEN CAST(2 AS DOUBLE) END AS r FROM events")
def q155_decoded_shapes(spark, d):
    """Annotations of several kinds from JSON."""
    k = F.col("event_id").cast("string")
    triple = lambda v: F.concat(F.lit("["), v, F.lit(", 0, 0]"))
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"type": "point", "point": '), triple(k), F.lit("}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"type": "line", "pointA": '), triple(k), F.lit(', "pointB": '), triple((F.col("event_id") + 1).cast("string")), F.lit("}")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"type": "ellipsoid", "center": '), triple(k), F.lit(', "radii": [2, 2, 2]}'))).otherwise(F.lit('{"type": "mesh"}'))
    )
    out = table(spark, d, "events").select("event_id", docstore.decoded_shapes(text).alias("s"))
    return out.select("event_id", F.col("s.kind").alias("kind"), F.col("s.a")[0].alias("ax"), F.col("s.b")[0].alias("bx"), F.col("s.radii")[0].alias("r"))


@query("SELECT DISTINCT CAST(floor(l_quantity / 8) AS BIGINT) AS cx, CAST(floor(l_discount * 100 / 2) AS BIGINT) AS cy FROM lineitem")
def q156_nonempty_chunks(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return files.nonempty_chunks(li, ["x", "y"], [8, 2])


@query("SELECT o_custkey, max(o_orderkey) AS last_order, count(*) AS n FROM orders GROUP BY ALL")
def q157_parents_and_children(spark, d):
    """Two tables from one, joined again by the id that both were given."""
    parents, children = files.with_children(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], {"o_custkey": "owner"})
    both = parents.join(children, F.col("id") == F.col("parent_id"))
    return both.groupBy(F.col("owner").alias("o_custkey")).agg(F.max("o_orderkey").alias("last_order"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def q158_open_ids(spark, d):
    """What two checkpoints of a ledger leave open."""
    path = f"{scratch(spark)}/ledger"
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    files.record_done(ids.where("id % 3 = 0"), path, "first")
    files.record_done(ids.where("id % 5 = 0"), path, "second")
    return files.still_open(ids, path)


@query("""SELECT c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def q159_layer_groups(spark, d):
    """The collection filter goes before the ids."""
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("collection"))
    return docstore.layer_groups(groups, ids=[1, 2], collections=["BUILDING", "MACHINERY"]).select("id")


@query(f"SELECT c_custkey AS id, {_u(9, 'c_custkey')} < 0.25 AS swapped, CASE WHEN {_u(9, 'c_custkey')} < 0.25 THEN c_custkey % 11 ELSE c_custkey % 13 END AS x, CASE WHEN {_u(9, 'c_custkey')} < 0.25 THEN c_custkey % 13 ELSE c_custkey % 11 END AS y FROM customer")
def q160_rewritten_index(spark, d):
    """A quarter of the index read with two axes swapped."""
    index = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 13).alias("x"), (F.col("c_custkey") % 11).alias("y"))
    return datasets.rewritten_index(index, "id", 0.25, 9, ["x", "y"])
