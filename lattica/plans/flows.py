"""Queries of the streaming, sampling and source operators on the driver's tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import sampling
from ..session import shared_dir
from ..sources import chunked
from ..streaming import edits

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; what a query leaves there goes with that folder."""
    return os.path.join(shared_dir(spark), f"run-{uuid.uuid4().hex}")


def stream_of(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder."""
    schema = table(spark, root, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{root}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT user_id FROM events WHERE event_type = 'click') THEN 100000 + c_custkey % 10 ELSE c_custkey END AS root FROM customer")
def q65_stream_relabel(spark, d):
    """Edit events as a stream, each applied once to the label table."""
    where = scratch(spark)
    edits.start_labels(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("root")), f"{where}/labels")
    e = stream_of(spark, d, "events").where("event_type = 'click'")
    twice = e.withColumn("event_id", F.explode(F.array(F.col("event_id"), F.col("event_id"))))  # every message is delivered twice
    stream = twice.select(F.col("event_id").cast("string"), F.array("user_id").alias("old_root_ids"), F.array(100000 + F.col("user_id") % 10).alias("new_root_ids"), F.col("ts").cast("timestamp").alias("ts"), F.lit("t").alias("table_id"))
    edits.run_listener(stream, f"{where}/labels", f"{where}/checkpoint").awaitTermination()
    return edits.current_labels(spark, f"{where}/labels")


@query("SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS start, count(*) AS n FROM events GROUP BY ALL")
def q72_daily_activity(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return edits.activity(e, "user_id", "ts", "1 day").select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("SELECT event_type, CASE WHEN user_id % 4 = 0 THEN 'none' WHEN user_id % 4 = 1 THEN 'merge' ELSE 'split' END AS operation, count(*) AS n FROM events GROUP BY ALL")
def q73_edit_operations(spark, d):
    e = table(spark, d, "events").withColumn("new_root_ids", F.when(F.col("user_id") % 4 > 0, F.sequence(F.lit(1).cast("long"), F.col("user_id") % 4)))
    return edits.classified(e).groupBy("event_type", "operation").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT user_id AS seed_id, max(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT coalesce(c_custkey, seed_id) AS seed_id, CASE WHEN ts IS NOT NULL THEN 'pending' ELSE 'completed' END AS status, CASE WHEN ts IS NOT NULL THEN 0 ELSE 2 END AS retry_count FROM customer c FULL JOIN u ON seed_id = c_custkey""")
def q74_queue_upsert(spark, d):
    now = F.lit("2024-01-01").cast("timestamp")
    queue = table(spark, d, "customer").select(F.col("c_custkey").alias("seed_id"), F.col("c_custkey").alias("root"), F.lit("completed").alias("status"), F.lit(2).alias("retry_count"), now.alias("created_at"), now.alias("last_attempt"), F.lit("x").alias("error"))
    updates = table(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("seed_id"), F.col("user_id").alias("root"), F.col("ts").cast("timestamp").alias("ts"))
    return edits.queue_latest(queue, updates).select("seed_id", "status", "retry_count")


@query("""WITH v AS (SELECT p_partkey % 10 AS x, (p_partkey // 10) % 10 AS y, p_partkey // 100 AS z, p_size % 5 AS label FROM part), m AS (SELECT min(x) AS ax, max(x) + 1 AS ex, min(y) AS ay, max(y) + 1 AS ey, min(z) AS az, max(z) + 1 AS ez FROM v),
    g AS (SELECT ax + i * 2 AS x0, ay + j * 3 AS y0, az + k * 1 AS z0, k * ((ex - ax - 4) // 2 + 1) * ((ey - ay - 4) // 3 + 1) + j * ((ex - ax - 4) // 2 + 1) + i AS n FROM m, range(100) a(i), range(100) b(j), generate_series(0, (SELECT ez - az FROM m)) c(k) WHERE ax + i * 2 + 4 <= ex AND ay + j * 3 + 4 <= ey AND az + k + 2 <= ez)
    SELECT g.n, g.x0, g.x0 + 4 AS x1, g.y0, g.y0 + 4 AS y1, g.z0, g.z0 + 2 AS z1, count(*) FILTER (WHERE label <> 0) AS n_voxels FROM g LEFT JOIN v ON v.z IN (g.z0, g.z0 + 1) AND v.x >= x0 AND v.x < x0 + 4 AND v.y >= y0 AND v.y < y0 + 4 GROUP BY ALL""")
def q57_strided_dataset(spark, d):
    """All boxes of four by four by two in the extent of the labelled volume, at a stride, with the labelled voxels of each."""
    k = F.col("p_partkey")
    v = table(spark, d, "part").select((k % 10).alias("x"), (F.floor(k / 10) % 10).alias("y"), F.floor(k / 100).alias("z"), (F.col("p_size") % 5).alias("label"))
    m = v.agg(*[f(a) for a in "xyz" for f in (F.min, F.max)]).first()
    start, stop = ([0 if x is None else x for x in (m[0], m[2], m[4])], [0 if x is None else x + 1 for x in (m[1], m[3], m[5])])
    size, stride = (4, 4, 2), (2, 3, 1)
    boxes = sampling.strided_boxes(spark, start, stop, size, stride)
    inside = v.where("label <> 0")
    for axis, a, s, t in zip("xyz", start, size, stride):  # every voxel names the boxes that hold it: as many as sizes are strides
        first, last = F.ceil((F.col(axis) - a - s + 1) / t), F.floor((F.col(axis) - a) / t)
        inside = inside.withColumn(f"{axis}0", F.explode(F.transform(F.sequence(F.greatest(first, F.lit(0)), last), lambda i: i * t + a)))
    n = inside.groupBy("x0", "y0", "z0").agg(F.count("*").alias("n_voxels"))
    return boxes.join(n, ["x0", "y0", "z0"], "left").select("n", "x0", "x1", "y0", "y1", "z0", "z1", F.coalesce("n_voxels", F.lit(0)).alias("n_voxels"))


@query("SELECT r_regionkey + k * 5 AS n, r_name AS name FROM region, generate_series(0, 4) t(k) WHERE r_regionkey + k * 5 < 23")
def q58_looped_dataset(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("n"), F.col("r_name").alias("name"))
    return sampling.looped(r, 23)


@query("SELECT CAST(r_regionkey AS BIGINT) AS n, r_name AS name, 0 AS dataset FROM region UNION ALL SELECT n_nationkey + 5, n_name, 1 FROM nation")
def q75_chained_datasets(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("n"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("name"))
    return sampling.chained([r, n])


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, y, z FROM (SELECT *, round(l_discount * 100, 0) AS y, round(l_tax * 100, 0) AS z FROM lineitem) WHERE l_quantity >= 5 AND l_quantity < 33 AND y >= 1 AND y < 7 AND z >= 2 AND z < 6")
def q76_chunked_layer(spark, d):
    """A table written as a layer of spatial chunks and read back by box."""
    root = scratch(spark)
    info = chunked.LayerInfo((1.0, 1.0, 1.0), (0, 0, 0), (64, 16, 16), (16, 4, 4), "l_orderkey long, l_linenumber int, x double, y double, z double")
    chunked.write_info(spark, root, info)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100, 0).alias("y"), F.round(F.col("l_tax") * 100, 0).alias("z"))
    chunked.write_rows(rows, root, ["x", "y", "z"])
    return chunked.read_box(spark, root, ["x", "y", "z"], (5, 1, 2), (33, 7, 6))
