"""Queries of the annotation and task operators on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import table
from ..operators import annotations, contacts, tasks
from .registry import build, register
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


_BOXES = "SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity AS x0, l_quantity + round(l_discount * 100, 0) AS x1, round(l_tax * 100, 0) AS y0, round(l_tax * 100, 0) + l_linenumber AS y1 FROM lineitem"


def _boxes(spark, d):
    li = table(spark, d, "lineitem")
    x, y = F.col("l_quantity"), F.round(F.col("l_tax") * 100, 0)
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), x.alias("x0"), (x + F.round(F.col("l_discount") * 100, 0)).alias("x1"), y.alias("y0"), (y + F.col("l_linenumber")).alias("y1"), F.lit(0.0).alias("z0"), F.lit(0.0).alias("z1"))


def _cells(level, sx, sy):
    return f"SELECT {level} AS level, cx, cy, count(*) AS n FROM (SELECT unnest(generate_series(CAST(floor(x0 / {sx}) AS BIGINT), CAST(floor(x1 / {sx}) AS BIGINT))) AS cx, y0, y1 FROM b), LATERAL (SELECT unnest(generate_series(CAST(floor(y0 / {sy}) AS BIGINT), CAST(floor(y1 / {sy}) AS BIGINT))) AS cy) GROUP BY cx, cy"


@query(f"WITH b AS ({_BOXES}), c AS ({_cells(0, 64, 16)} UNION ALL {_cells(1, 16, 4)} UNION ALL {_cells(2, 4, 2)}) SELECT level, count(*) AS n_cells, max(n) AS most FROM c GROUP BY level")
def q77_spatial_index(spark, d):
    """Boxes dealt to every cell that they touch, on three levels."""
    index = annotations.spatial_index(_boxes(spark, d), [("x0", "x1"), ("y0", "y1"), ("z0", "z1")], [(64, 16, 1), (16, 4, 1), (4, 2, 1)])
    return annotations.cell_limits(index)


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def q78_last_of_each(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return annotations.last_of_each(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"WITH v AS ({VOXELS}), m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v WHERE label <> 0 GROUP BY label HAVING count(*) >= 10) SELECT label, n, x, y, z FROM v JOIN m USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 9), x, y, z) = 1")
def q79_label_centres(spark, d):
    """Size of each label and its member nearest to the centroid."""
    v = voxels(spark, d).where("label <> 0")
    size = v.groupBy("label").agg(F.count("*").alias("n")).where("n >= 10")
    return size.join(contacts.nearest_to_mean(v, ["label"]), "label")


@query(f"WITH v AS ({VOXELS}) SELECT x, y, z, tx, ty, distance FROM (SELECT a.x, a.y, a.z, b.x AS tx, b.y AS ty, CAST(abs(a.x - b.x) + abs(a.y - b.y) AS INTEGER) AS distance FROM v a JOIN v b ON a.z = b.z AND abs(a.x - b.x) + abs(a.y - b.y) <= 4 WHERE a.label = 1 AND b.label = 2) QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY distance, tx, ty) = 1")
def q80_nearest_label(spark, d):
    return annotations.nearest_label(voxels(spark, d), 1, 2, 4)


_LINES = "SELECT o_orderkey AS id, o_orderkey % 10 AS x0, (o_orderkey // 7) % 10 AS y0, o_custkey % 2 AS z0, o_custkey % 9 AS x1, (o_custkey // 3) % 10 AS y1, (o_orderkey // 3) % 2 AS z1 FROM orders"


def _lines(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(o.alias("id"), (o % 10).alias("x0"), (F.floor(o / 7) % 10).alias("y0"), (c % 2).alias("z0"), (c % 9).alias("x1"), (F.floor(c / 3) % 10).alias("y1"), (F.floor(o / 3) % 2).alias("z1"))


@query(f"""WITH v AS ({VOXELS}), l AS ({_LINES}), n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0), abs(z1 - z0)) AS n FROM l), k AS (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM n WHERE n > 0),
p AS (SELECT id, x0 + sign(x1 - x0) * ((2 * k * abs(x1 - x0) + n) // (2 * n)) AS x, y0 + sign(y1 - y0) * ((2 * k * abs(y1 - y0) + n) // (2 * n)) AS y, z0 + sign(z1 - z0) * ((2 * k * abs(z1 - z0) + n) // (2 * n)) AS z FROM k)
SELECT DISTINCT p.id, label FROM p JOIN v USING (x, y, z) WHERE label <> 0""")
def q81_labels_on_lines(spark, d):
    return annotations.labels_on_lines(_lines(spark, d), "id", ["x0", "y0", "z0"], ["x1", "y1", "z1"], voxels(spark, d))


@query(f"WITH v AS ({VOXELS}) SELECT event_id, coalesce(label, 0) AS label FROM events LEFT JOIN v ON x = CAST(round_even(value / 10, 0) AS BIGINT) AND y = user_id % 12 AND z = 0")
def q82_labels_at_points(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 10).alias("px"), (F.col("user_id") % 12).cast("double").alias("py"), F.lit(0.0).alias("pz"))
    return annotations.labels_at(e, ["px", "py", "pz"], voxels(spark, d)).select("event_id", "label")


@query("WITH p AS (SELECT l_extendedprice / 5000 AS px, l_quantity / 3 AS py, l_discount AS sx, l_tax AS sy FROM lineitem), w AS (SELECT CAST(floor(px) AS BIGINT) AS cx, CAST(floor(py) AS BIGINT) AS cy, sx, sy, 1 - sqrt((px - floor(px) - 0.5) * (px - floor(px) - 0.5) + (py - floor(py) - 0.5) * (py - floor(py) - 0.5)) AS w FROM p) SELECT cx, cy, round(sum(sx * w) / sum(w) + 1e-9, 6) AS dx, round(sum(sy * w) / sum(w) + 1e-9, 6) AS dy FROM w GROUP BY cx, cy")
def q83_field_from_points(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 5000).alias("px"), (F.col("l_quantity") / 3).alias("py"), F.col("l_discount").alias("sx"), F.col("l_tax").alias("sy"))
    return annotations.field_from_points(p, ["px", "py"], ["sx", "sy"]).withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in ("dx", "dy")})


def _tasks(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("").alias("completion_status"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("u"), F.col("o_custkey") % 50)).otherwise("").alias("active_user_id"), (F.col("o_custkey") % 200).cast("double").alias("last_leased_ts"), (F.col("o_orderkey") % 4 != 1).alias("is_active"))


_TASKS = "SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE '' END AS completion_status, CASE WHEN o_orderkey % 3 = 0 THEN 'u' || (o_custkey % 50) ELSE '' END AS active_user_id, CAST(o_custkey % 200 AS DOUBLE) AS last_leased_ts, o_orderkey % 4 <> 1 AS is_active FROM orders"


@query(f"""WITH t AS ({_TASKS}), r AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, 'u' || (o_orderkey % 50) AS u FROM orders WHERE o_totalprice > 150000), j AS (SELECT t.*, u, u IS NOT NULL AND is_active AND completion_status = '' AND (active_user_id = '' OR active_user_id = u OR last_leased_ts <= 110) AS ok FROM t LEFT JOIN r USING (task_id))
SELECT task_id, CASE WHEN ok THEN u ELSE active_user_id END AS active_user_id, CASE WHEN ok THEN 200.0 ELSE last_leased_ts END AS last_leased_ts, CASE WHEN u IS NOT NULL THEN ok END AS accepted FROM j""")
def q84_task_leases(spark, d):
    asked = table(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").cast("string").alias("task_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 50).alias("user_id"))
    return tasks.started(_tasks(spark, d), asked, F.lit(200.0)).select("task_id", "active_user_id", "last_leased_ts", "accepted")


@query(f"""WITH t AS ({_TASKS}), d AS (SELECT CAST(l_orderkey AS VARCHAR) AS task_id, CAST(l_partkey AS VARCHAR) AS up FROM lineitem), s AS (SELECT d.task_id, coalesce(t.completion_status = 'done', false) AS ok FROM d LEFT JOIN t ON t.task_id = up), r AS (SELECT task_id, bool_and(ok) AS ready FROM s GROUP BY task_id)
SELECT t.task_id, is_active OR coalesce(ready, false) AS is_active FROM t LEFT JOIN r USING (task_id)""")
def q85_task_activation(spark, d):
    """Tasks whose dependencies are all met become active."""
    deps = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("task_id"), F.col("l_partkey").cast("string").alias("dependent_on_task_id"), F.lit("done").alias("required_completion_status"), F.lit(False).alias("is_satisfied"))
    t = _tasks(spark, d)
    return tasks.activated(t, tasks.satisfied(deps, t)).select("task_id", "is_active")


@query("WITH s AS (SELECT user_id, event_type AS task_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS sec FROM events GROUP BY ALL) SELECT task_id, CAST(sum(sec) AS BIGINT) AS seconds, round(sum(sec / 3600 * coalesce(c_acctbal, 0)), 4) AS cost FROM s LEFT JOIN customer ON c_custkey = user_id GROUP BY task_id")
def q86_task_costs(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("task_id"), F.floor("value").alias("seconds_spent"))
    sheet = tasks.with_time(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("hourly_rate"))
    return tasks.task_costs(sheet, users).withColumn("cost", F.round("cost", 4))


@query("SELECT l_suppkey % 100 AS target, array_to_string(list_sort(list_distinct(list(l_partkey % 40))), ',') AS sources FROM lineitem GROUP BY ALL")
def q87_lineage_sources(spark, d):
    """Distinct sources of each target of an edge table."""
    e = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("id"), F.array(F.col("l_suppkey") % 100).alias("to"))
    out = annotations.related_index(e, "to", "id")
    return out.select(F.col("related").alias("target"), F.concat_ws(",", F.col("ids").cast("array<string>")).alias("sources"))


@register("table")
def _table(spark, root, name):
    return table(spark, root, name)


@register("filter")
def _filter(of, column, values):
    return of.where(F.col(column).isin(values))


@register("count")
def _count(of, by):
    return of.groupBy(*by).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE lang IN ('de', 'en') GROUP BY source")
def q88_spec(spark, d):
    """A DataFrame built from a declarative spec."""
    spec = {"@type": "count", "by": ["source"], "of": {"@type": "filter", "column": "lang", "values": ["de", "en"], "of": {"@type": "table", "name": "documents"}}}
    return build(spec, spark=spark, root=d)
