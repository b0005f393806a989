"""Queries of layers with commits: versions of annotations and arrays, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..sources import annotation_layer as al
from ..sources import arrays, commits
from .flows import scratch
from .layers import _LINES as LINES
from .layers import _lines as layer_lines
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


_SIZES = ((64, 16, 1), (16, 4, 1))
_CELL = "floor(x0 / 16) <= {0} AND floor(x1 / 16) >= {0} AND floor(y0 / 4) <= {1} AND floor(y1 / 4) >= {1}"
#: Version 1: all lines.  Version 2: cell (1, 0) of level 1 without its odd ids, its others 40 longer.  Version 3: without what touches cell (2, 1).
_VERSIONS = f"""v1 AS (SELECT id, x0, x1, y0, y1 FROM ({LINES})),
v2 AS (SELECT id, x0, CASE WHEN {_CELL.format(1, 0)} THEN x1 + 40 ELSE x1 END AS x1, y0, y1 FROM v1 WHERE NOT ({_CELL.format(1, 0)}) OR id % 2 = 0),
v3 AS (SELECT * FROM v2 WHERE NOT ({_CELL.format(2, 1)}))"""


def _layer(spark, d, relation=None):
    """A layer of three versions."""
    layer = al.AnnotationLayer(f"{scratch(spark)}/annotations", [("x0", "x1"), ("y0", "y1"), ("z0", "z1")], _SIZES, relation)
    rows = layer_lines(spark, d)
    if relation:
        rows = rows.withColumn(relation, F.array(F.col("id") % 101, F.col("x0").cast("long")))
    al.created(layer, rows)
    al.replaced_cell(spark, layer, 1, (1, 0, 0), lambda old: old.where("id % 2 = 0").withColumn("x1", F.col("x1") + 40))
    al.replaced_cell(spark, layer, 1, (2, 1, 0), None)
    return layer


@query(f"WITH {_VERSIONS} SELECT 'cells' AS reader, 1 AS version, * FROM v1 UNION ALL SELECT 'ids', 2, * FROM v2 UNION ALL SELECT 'fine cells', 2, * FROM v2 UNION ALL SELECT 'cells', 3, * FROM v3 UNION ALL SELECT 'ids', 3, * FROM v3")
def q184_layer_versions(spark, d):
    """A cell replaced and another deleted: every reader of a version finds the same annotations, older versions stay."""
    layer = _layer(spark, d)
    reads = [
        ("cells", 1, al.read_all(spark, layer, 0, 1)), ("ids", 2, al.read_by_id(spark, layer, None, 2)), ("fine cells", 2, al.read_all(spark, layer, 1, 2)),
        ("cells", 3, al.read_all(spark, layer)), ("ids", 3, al.read_by_id(spark, layer)),
    ]
    out = None
    for name, version, df in reads:
        one = df.select(F.lit(name).alias("reader"), F.lit(version).alias("version"), "id", "x0", "x1", "y0", "y1")
        out = one if out is None else out.unionByName(one)
    return out


_GRID = "SELECT {0} AS level, id, unnest(generate_series(CAST(floor(x0 / {1}) AS BIGINT), CAST(floor(x1 / {1}) AS BIGINT))) AS cx, y0, y1 FROM v3"
_CELLS = " UNION ALL ".join(f"SELECT level, cx, unnest(generate_series(CAST(floor(y0 / {s[1]}) AS BIGINT), CAST(floor(y1 / {s[1]}) AS BIGINT))) AS cy FROM ({_GRID.format(k, s[0])})" for k, s in enumerate(_SIZES))


@query(f"WITH {_VERSIONS}, c AS ({_CELLS}) SELECT level, count(*) AS n_cells, max(n) AS most FROM (SELECT level, cx, cy, count(*) AS n FROM c GROUP BY ALL) GROUP BY level")
def q185_level_limits(spark, d):
    """The fullest cell of each level after the commits of a layer, read from its compacted version."""
    layer = _layer(spark, d)
    al.compacted(spark, layer)
    return al.limits(spark, layer)


@query(f"WITH {_VERSIONS}, r AS (SELECT DISTINCT id, unnest([id % 101, CAST(x0 AS BIGINT)]) AS related FROM v3) SELECT related, count(*) AS n, sum(id) AS ids, min(id) AS first FROM r GROUP BY related")
def q186_related_ids(spark, d):
    """The index by relation follows the commits of its layer."""
    rel = al.read_related(spark, _layer(spark, d, "tags"))
    total = F.aggregate("ids", F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)"))
    return rel.select("related", F.size("ids").cast("long").alias("n"), total.alias("ids"), F.col("ids")[0].alias("first"))


_TOP = "x < 4 AND y < 4 AND z < 2"
_GONE = "x // 4 = 1 AND y // 4 = 1"


@query(f"WITH v AS ({VOXELS}) SELECT 1 AS version, x, y, z, v FROM v UNION ALL SELECT 2, x, y, z, CASE WHEN {_TOP} THEN -v ELSE v END FROM v UNION ALL SELECT 4, x, y, z, CASE WHEN {_TOP} THEN -v ELSE v END FROM v WHERE NOT ({_GONE})")
def q187_array_versions(spark, d):
    """An array layer whose versions are read: one chunk written again, a column of chunks deleted, the rest compacted."""
    path, chunk = f"{scratch(spark)}/array", (4, 4, 2)
    own = voxels(spark, d).select("x", "y", "z", "v")
    arrays.commit_chunks(own, path, chunk)
    arrays.commit_chunks(own.where(_TOP.lower()).withColumn("v", -F.col("v")), path, chunk)
    arrays.delete_chunks(spark, path, own.where("floor(x / 4) = 1 and floor(y / 4) = 1").select(*[F.floor(F.col(a) / c).alias(n) for a, c, n in zip("xyz", chunk, arrays.CELLS)]).distinct())
    last = arrays.compact_chunks(spark, path)
    top = own.agg(F.max("z")).first()[0]
    whole = ((0, 10), (0, 10), (0, (0 if top is None else top) + 1))
    out = None
    for version in (1, 2, last):
        one = arrays.cutout(arrays.version_chunks(spark, path, version, whole, chunk), whole, chunk).where("v <> 0").withColumn("version", F.lit(version))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DOUBLE) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS price FROM orders WHERE o_orderkey % 7 <> 0")
def q188_table_commits(spark, d):
    """Any table with keys: rows changed and deleted by one commit, a second writer from the same version refused."""
    path = f"{scratch(spark)}/orders"
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    first = commits.commit(spark, path, {"orders": rows}, ["o_orderkey"], None, 0)
    new = rows.where("o_orderkey % 3 = 0 and o_orderkey % 7 <> 0").withColumn("price", F.col("price") + 1)
    gone = rows.where("o_orderkey % 3 = 0 or o_orderkey % 7 = 0")
    commits.commit(spark, path, {"orders": new}, ["o_orderkey"], gone, first)
    try:
        commits.commit(spark, path, {"orders": rows.where("false")}, ["o_orderkey"], rows, first)
    except commits.Conflict:
        pass
    return commits.read(spark, path, "orders", ["o_orderkey"])
