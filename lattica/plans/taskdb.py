"""Queries of the task database operators on the driver's tables, with their SQL.

Orders stand for tasks, customers for users, nations for projects, events for edits and queue entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import table
from ..operators import taskdb

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_TASKS = "SELECT 'p' || (o_custkey % 5) AS project_name, 't' || o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'P' THEN 'Fair' ELSE '' END AS completion_status, 'u' || (o_custkey % 20) AS assigned_user_id, CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'u' || (o_custkey % 7) END AS completed_user_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS priority, o_orderkey % 3 = 0 AS is_paused, 'state ' || o_orderkey AS ng_state, CASE WHEN o_orderkey % 4 = 0 THEN 'note' END AS note FROM orders"


def _tasks(spark, d) -> DataFrame:
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.concat(F.lit("p"), (c % 5).cast("string")).alias("project_name"), F.concat(F.lit("t"), k.cast("string")).alias("task_id"), F.when(s == "F", "Done").when(s == "P", "Fair").otherwise("").alias("completion_status"), F.concat(F.lit("u"), (c % 20).cast("string")).alias("assigned_user_id"),
        F.when(s == "O", "").otherwise(F.concat(F.lit("u"), (c % 7).cast("string"))).alias("completed_user_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (k % 3 == 0).alias("is_paused"), F.concat(F.lit("state "), k.cast("string")).alias("ng_state"), F.when(k % 4 == 0, "note").alias("note"),
    )


def _keys(spark, d, modulus: int) -> DataFrame:
    """Every task whose user's number divides: a stated set of requests."""
    t = _tasks(spark, d)
    return t.where(F.substring("assigned_user_id", 2, 9).cast("int") % modulus == 0).select("project_name", "task_id")


@query(f"SELECT task_id, CASE WHEN CAST(substr(assigned_user_id, 2) AS INTEGER) % 5 = 0 THEN false WHEN CAST(substr(assigned_user_id, 2) AS INTEGER) % 2 = 0 THEN true ELSE is_paused END AS is_paused FROM ({_TASKS})")
def q104_pause_tasks(spark, d):
    """Tasks of some users paused, then those of others unpaused."""
    paused = taskdb.flagged(_tasks(spark, d), _keys(spark, d, 2), True)
    return taskdb.flagged(paused, _keys(spark, d, 5), False).select("task_id", "is_paused")


@query(f"SELECT task_id, CASE WHEN CAST(substr(assigned_user_id, 2) AS INTEGER) % 2 = 0 THEN '' ELSE completion_status END AS completion_status, CASE WHEN CAST(substr(assigned_user_id, 2) AS INTEGER) % 2 = 0 AND completion_status <> '' THEN '' ELSE completed_user_id END AS completed_user_id FROM ({_TASKS})")
def q105_reactivate(spark, d):
    return taskdb.reactivated(_tasks(spark, d), _keys(spark, d, 2)).select("task_id", "completion_status", "completed_user_id")


@query(f"SELECT task_id, priority, row_number() OVER (ORDER BY priority DESC, task_id) AS place FROM ({_TASKS}) WHERE project_name = 'p1' AND assigned_user_id = 'u6' AND is_paused")
def q106_paused_of_user(spark, d):
    from pyspark.sql import Window

    own = taskdb.paused_tasks(_tasks(spark, d), "p1", "u6")
    return own.select("task_id", "priority", F.row_number().over(Window.orderBy(F.col("priority").desc(), "task_id")).alias("place"))


_REQUESTS = "SELECT 'p' || (o_custkey % 5) AS project_name, 'd' || (o_orderkey % 1000) AS dependency_id, 't' || o_orderkey AS task_id, 't' || (CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey + 5 END) AS dependent_on_task_id FROM orders"


def _requests(spark, d):
    k = F.col("o_orderkey")
    on = F.when(k % 11 == 0, k).when(k % 7 == 0, F.lit(-1)).otherwise(k + 5)
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return table(spark, d, "orders").select(name("p", F.col("o_custkey") % 5).alias("project_name"), name("d", k % 1000).alias("dependency_id"), name("t", k).alias("task_id"), name("t", on).alias("dependent_on_task_id"))


@query(f"""WITH t AS ({_TASKS}), r AS ({_REQUESTS}), h AS (SELECT project_name, 'd' || CAST(substr(task_id, 2) AS BIGINT) AS dependency_id FROM t WHERE CAST(substr(task_id, 2) AS BIGINT) < 20),
c AS (SELECT r.*, CASE WHEN r.task_id = r.dependent_on_task_id THEN 'depends on itself' WHEN b.task_id IS NULL THEN 'no such task to depend on' END AS why FROM r LEFT JOIN t b ON b.project_name = r.project_name AND b.task_id = r.dependent_on_task_id),
g AS (SELECT project_name, dependency_id, count(*) AS n FROM c WHERE why IS NULL GROUP BY ALL)
SELECT c.project_name, c.dependency_id, c.task_id, coalesce(why, CASE WHEN h.dependency_id IS NOT NULL THEN 'exists already' WHEN g.n > 1 THEN 'asked for twice' ELSE 'made' END) AS outcome FROM c LEFT JOIN h USING (project_name, dependency_id) LEFT JOIN g USING (project_name, dependency_id)""")
def q107_new_dependencies(spark, d):
    """Checked inserts: what became of every request."""
    t = _tasks(spark, d)
    have = t.where(F.substring("task_id", 2, 20).cast("long") < 20).select("project_name", F.concat(F.lit("d"), F.substring("task_id", 2, 20)).alias("dependency_id"), F.lit("old").alias("task_id"), F.lit("x").alias("dependent_on_task_id"), F.lit(True).alias("is_satisfied"))
    out, rejected = taskdb.new_dependencies(have, t, _requests(spark, d))
    made = out.where("task_id <> 'old'").select("project_name", "dependency_id", "task_id", F.lit("made").alias("outcome"))
    return made.unionByName(rejected.select("project_name", "dependency_id", "task_id", F.col("reason").alias("outcome")))


@query(f"SELECT task_id, project_name, assigned_user_id FROM (SELECT 't' || (CAST(substr(task_id, 2) AS BIGINT) % 100) AS task_id, project_name, min(assigned_user_id) AS assigned_user_id FROM ({_TASKS}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY project_name) = 1")
def q108_task_across_projects(spark, d):
    """The first project that has a task of that id."""
    t = _tasks(spark, d).withColumn("task_id", F.concat(F.lit("t"), (F.substring("task_id", 2, 20).cast("long") % 100).cast("string"))).groupBy("task_id", "project_name").agg(F.min("assigned_user_id").alias("assigned_user_id"))
    return taskdb.across_projects(t, t.select("task_id")).select("task_id", "project_name", "assigned_user_id")


_FEEDBACK = "SELECT 'p' || (user_id % 5) AS project_name, event_id AS feedback_id, 'u' || (user_id % 7) AS user_id, 't' || (event_id % 1000) AS task_id, 't' || (event_id % 1500) AS feedback_task_id, epoch_us(ts) AS created_at FROM events"


@query(f"""WITH t AS ({_TASKS}), f AS (SELECT * FROM ({_FEEDBACK}) WHERE user_id = 'u3' AND project_name IN ('p0', 'p1', 'p3') ORDER BY created_at DESC, project_name, feedback_id LIMIT 50 OFFSET 10)
SELECT f.feedback_id, a.ng_state AS task_link, b.ng_state AS feedback_link, b.note, CASE WHEN b.task_id IS NULL THEN 'Unknown' ELSE b.completion_status END AS feedback, CASE WHEN b.completion_status = 'Accurate' THEN 'green' WHEN b.completion_status = 'Fair' THEN 'yellow' ELSE 'red' END AS feedback_color
FROM f LEFT JOIN t a ON a.project_name = f.project_name AND a.task_id = f.task_id LEFT JOIN t b ON b.project_name = f.project_name AND b.task_id = f.feedback_task_id""")
def q109_feedback(spark, d):
    """A page of a user's feedback with both tasks and a colour."""
    e, name = table(spark, d, "events"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    feedback = e.select(name("p", F.col("user_id") % 5).alias("project_name"), F.col("event_id").alias("feedback_id"), name("u", F.col("user_id") % 7).alias("user_id"), name("t", F.col("event_id") % 1000).alias("task_id"), name("t", F.col("event_id") % 1500).alias("feedback_task_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_at"))
    users = spark.createDataFrame([("p0", "u3"), ("p1", "u3"), ("p3", "u3"), ("p4", "u9")], "project_name string, user_id string")
    return taskdb.feedback_across_projects(feedback, _tasks(spark, d), users, "u3", 50, 10).select("feedback_id", "task_link", "feedback_link", "note", "feedback", "feedback_color")


@query("SELECT event_id AS edit_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE user_id % 5 = 2 AND event_type = 'purchase'")
def q110_edits_of_task(spark, d):
    """Edits of one task, the newest first."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project_name"), F.col("event_id").alias("edit_id"), F.col("event_type").alias("task_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("created_at"))
    own = taskdb.edits_of(e, "p2", task="purchase")
    return own.select("edit_id", F.row_number().over(Window.orderBy(F.col("created_at").desc(), F.col("edit_id").desc())).alias("place"))


@query("SELECT event_id AS submission_id FROM events WHERE user_id % 5 = 1 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20'")
def q111_submissions(spark, d):
    import datetime

    e = table(spark, d, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("project_name"), F.col("event_id").alias("submission_id"), F.col("event_type").alias("task_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("submitted_at"))
    return taskdb.submissions(e, "p1", task="click", first=datetime.datetime(2024, 1, 2), last=datetime.datetime(2024, 1, 20)).select("submission_id")


@query("""WITH q AS (SELECT user_id % 5 AS p, event_id AS seed_id, ts AS last_attempt FROM events), n AS (SELECT max(ts) AS now FROM events),
m AS (SELECT seed_id, CASE WHEN seed_id % 2 = 0 THEN 'completed' WHEN seed_id % 3 = 0 THEN 'processing' ELSE 'pending' END AS status, last_attempt FROM q) SELECT seed_id, status FROM m, n WHERE NOT (status = 'completed' AND last_attempt < date_trunc('day', now) - INTERVAL 3 DAY)""")
def q112_queue_states(spark, d):
    """Entries taken up, finished and, after some days, cleared away; the time of an attempt is that of the event here."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("project_name"), F.col("event_id").alias("seed_id"), F.lit("pending").alias("status"), F.col("ts").cast("timestamp").alias("last_attempt"))
    now = F.lit(e.agg(F.max("last_attempt")).first()[0])
    own = F.col("last_attempt")
    queue = taskdb.marked(e, e.where("seed_id % 3 = 0"), "processing", own)
    queue = taskdb.marked(queue, e.where("seed_id % 2 = 0"), "completed", own)
    return taskdb.cleaned_up(queue, now, 3).select("seed_id", "status")


_POINT = "[{a}, {b}, {c}]"


def _state(k: Column, n: Column) -> Column:
    """A view state as JSON: some layers by the order's numbers."""
    text = lambda c: c.cast("string")
    points = lambda count, step: F.concat_ws(", ", F.transform(F.sequence(F.lit(0), count), lambda i: F.concat(F.lit('{"point": ['), text(n % 100 + i * step), F.lit(", "), text(i), F.lit(", 2.5]}"))))
    layer = lambda name, inner: F.concat(F.lit('{"type": "annotation", "name": "' + name + '", "annotations": ['), inner, F.lit("]}"))
    segments = F.concat(F.lit('{"type": "segmentation", "name": "Segmentation", "segments": ["'), text(k), F.when(k % 13 == 0, F.lit('", "5')).otherwise(F.lit('", "!7')), F.lit('"]}'))
    layers = F.concat_ws(", ", segments, layer("Seed Location", points(F.lit(1), 3)), F.when(k % 5 != 0, layer("Root Location", points((k % 2).cast("int"), 4))), layer("Certain Ends", points((k % 4).cast("int"), 5)), F.when(k % 3 == 0, layer("Uncertain Ends", points(F.lit(0), 6))), layer("Breadcrumbs", F.lit("")))
    return F.concat(F.lit('{"layers": ['), layers, F.lit("]}"))


def _traced(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.element_at(F.array(*map(F.lit, ("Done", "Can't Continue", "Merger", "Faulty Task", "Other"))), (k % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(F.concat(F.lit("p"), (c % 3).cast("string")).alias("project_name"), k.cast("string").alias("task_id"), (k % 700).alias("seed_id"), F.concat(F.lit("u"), (c % 9).cast("string")).alias("user_id"), _state(k, c).alias("ng_state"), status.alias("completion_status"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CAST(o_custkey % 100 AS DOUBLE) AS seed_x, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 100 + (o_orderkey % 2) * 4 AS DOUBLE) END AS root_x, CAST(o_orderkey % 4 + 1 AS INTEGER) AS n_certain, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_uncertain, 0 AS n_breadcrumbs FROM orders")
def q113_state_annotations(spark, d):
    """Points by layer from JSON view states: the first seed, the last root, all ends."""
    out = _traced(spark, d).select("task_id", taskdb.annotations_of(F.col("ng_state")).alias("a"))
    return out.select("task_id", F.col("a.seed")[0].alias("seed_x"), F.col("a.root")[0].alias("root_x"), F.size("a.certain_ends").alias("n_certain"), F.size("a.uncertain_ends").alias("n_uncertain"), F.size("a.breadcrumbs").alias("n_breadcrumbs"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderkey % 5 = 3 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'not one segment' WHEN o_orderkey % 5 = 0 THEN 'no root layer' WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_orderkey % 3 <> 0 THEN 'no uncertain end' END WHEN o_orderkey % 5 = 2 THEN NULL ELSE 'no such status' END AS reason FROM orders""")
def q114_trace_verdicts(spark, d):
    return _traced(spark, d).select("task_id", taskdb.trace_verdict(F.col("ng_state"), F.col("completion_status")).alias("reason"))


_LAST = "SELECT 'p' || (o_custkey % 3) AS project_name, o_orderkey % 700 AS seed_id, max(CAST(o_orderkey AS VARCHAR)) AS task_id FROM orders WHERE o_orderkey % 5 <> 3 GROUP BY ALL"


@query(f"""WITH l AS ({_LAST}), t AS (SELECT l.*, o_orderkey AS k, o_custkey AS c FROM l JOIN orders ON CAST(o_orderkey AS VARCHAR) = l.task_id), s AS (SELECT DISTINCT 'p' || (o_custkey % 3) AS project_name, o_orderkey % 700 AS seed_id FROM orders)
SELECT s.project_name, s.seed_id, CASE WHEN t.k IS NULL THEN 'Raw' WHEN k % 5 = 2 THEN 'Wrong type' ELSE 'Proofread' END AS status, CASE WHEN k % 5 <> 0 THEN CAST(c % 100 + (k % 2) * 4 AS DOUBLE) END AS root_x, CASE WHEN k % 5 <> 0 THEN CAST(2 AS DOUBLE) END AS root_z, coalesce(t.task_id, '') AS tasks, coalesce(k % 4 + 1, 1) AS n_certain, coalesce(CASE WHEN k % 3 = 0 THEN 1 END, 0) AS n_uncertain, coalesce(CAST(k % 5 = 0 AS INTEGER), 0) AS n_follow
FROM s LEFT JOIN t ON t.project_name = s.project_name AND t.seed_id = s.seed_id""")
def q115_trace_completed(spark, d):
    """Segments, endpoints and follow-up tasks after all completions."""
    tasks = _traced(spark, d)
    seeds = tasks.select("project_name", "seed_id").distinct()
    segments = seeds.select("project_name", "seed_id", *(F.lit(None).cast("double").alias(f"root_{k}") for k in "xyz"), F.lit("Raw").alias("status"), F.array().cast("array<string>").alias("task_ids"))
    ends = seeds.select("project_name", "seed_id", *(F.lit(0.0).alias(k) for k in "xyz"), F.lit("CERTAIN").alias("status"), F.lit("old").alias("user"))
    after, points, follow = taskdb.trace_completed(segments, ends, tasks)
    counts = points.groupBy("project_name", "seed_id").agg(F.count_if(F.col("status") == "CERTAIN").alias("n_certain"), F.count_if(F.col("status") == "UNCERTAIN").cast("int").alias("n_uncertain"))
    more = follow.join(tasks.select("project_name", F.col("task_id").alias("original_task_id"), "seed_id"), ["project_name", "original_task_id"]).groupBy("project_name", "seed_id").agg(F.count("*").cast("int").alias("n_follow"))
    out = after.join(counts, ["project_name", "seed_id"], "left").join(more, ["project_name", "seed_id"], "left")
    return out.select("project_name", "seed_id", "status", "root_x", "root_z", F.concat_ws(",", "task_ids").alias("tasks"), F.coalesce("n_certain", F.lit(0)).alias("n_certain"), F.coalesce("n_uncertain", F.lit(0)).alias("n_uncertain"), F.coalesce("n_follow", F.lit(0)).alias("n_follow"))


@query(f"""WITH t AS ({_TASKS}), a AS (SELECT project_name, task_id, 't' || (CAST(substr(task_id, 2) AS BIGINT) + 5) AS original, completion_status FROM t WHERE completion_status <> 'Fair')
SELECT a.project_name, original AS task_id, a.task_id AS feedback_task_id, coalesce(nullif(o.completed_user_id, ''), 'someone') AS user_id FROM a JOIN t o ON o.project_name = a.project_name AND o.task_id = a.original""")
def q116_feedback_recorded(spark, d):
    t = _tasks(spark, d)
    answers = t.select("project_name", "task_id", F.concat(F.lit("t"), (F.substring("task_id", 2, 20).cast("long") + 5).cast("string")).alias("original_task_id"), F.lit("someone").alias("original_user"), F.when(F.col("completion_status") == "Fair", "Faulty Task").otherwise(F.col("completion_status")).alias("completion_status"))
    return taskdb.feedback_recorded(t, answers)


@query("SELECT 'p1' AS project_name, 'trace_' || c_custkey AS task_id, c_custkey AS seed_id, 'trace_v0' AS task_type, 7 AS priority FROM customer WHERE c_nationkey % 3 = 1 AND c_mktsegment = 'BUILDING' AND c_custkey % 4 <> 0 AND c_custkey IN (SELECT user_id FROM events)")
def q117_trace_tasks(spark, d):
    c = table(spark, d, "customer")
    segments = c.select(F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")).alias("project_name"), F.col("c_custkey").alias("seed_id"), F.col("c_mktsegment").alias("expected_segment_type"), F.lit("Raw").alias("status"), F.lit("b").alias("batch"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("task_ids"))
    return taskdb.trace_tasks(segments, "p1", expected_type="BUILDING", status="Raw", seeds=table(spark, d, "events").select(F.col("user_id").alias("seed_id")), priority=7)


@query("SELECT p_partkey AS current_segment_id, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS pre_synapse_count, (SELECT count(*) FROM lineitem WHERE l_suppkey = p_partkey) AS post_synapse_count FROM part")
def q118_segment_statistics(spark, d):
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    segments = p.select(F.col("p_partkey").alias("current_segment_id"), F.lit(-1).alias("pre_synapse_count"), F.lit(-1).alias("post_synapse_count"))
    return taskdb.segment_statistics(segments, li.select(F.col("l_partkey").alias("root_id")), li.select(F.col("l_suppkey").alias("root_id")))


@query("""WITH s AS (SELECT c_custkey AS supervoxel_id, c_custkey % 50 AS current_segment_id FROM customer), m AS (SELECT user_id AS supervoxel_id, event_id, 1000 + event_id * 2 + event_id % 2 AS new_root FROM events WHERE event_id % 50 = user_id % 50),
b AS (SELECT supervoxel_id, arg_max(new_root, event_id) AS new_root FROM m GROUP BY supervoxel_id) SELECT s.supervoxel_id, coalesce(b.new_root, s.current_segment_id) AS current_segment_id FROM s LEFT JOIN b USING (supervoxel_id)""")
def q119_split_supervoxels(spark, d):
    """Supervoxels follow the last split of their own root; what belongs to another root stays."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("supervoxel_id"), (F.col("c_custkey") % 50).alias("current_segment_id"))
    k = F.col("event_id")
    leaves = table(spark, d, "events").select(k.alias("event_no"), (k % 50).alias("old_root"), (k * 2 + 1000 + k % 2).alias("new_root"), F.lit(0).alias("ordinal"), F.col("user_id").alias("supervoxel_id"))
    return taskdb.split_supervoxels(own, leaves)


@query("""WITH r AS (SELECT 'p' || (l_suppkey % 3) AS project_name, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem), c AS (SELECT p_partkey % 6 AS cx, (p_partkey // 6) % 3 AS cy, 0 AS cz, max(p_partkey % 7) AS supervoxel_id FROM part GROUP BY ALL),
h AS (SELECT project_name, supervoxel_id, x, y, z FROM r JOIN c ON cx = CAST(floor(x / 10) AS BIGINT) AND cy = CAST(floor(y / 5) AS BIGINT) AND cz = CAST(floor(z / 50) AS BIGINT) WHERE supervoxel_id <> 0)
SELECT project_name, supervoxel_id AS seed_id, x AS seed_x, y AS seed_y, z AS seed_z, 'Raw' AS status FROM h QUALIFY row_number() OVER (PARTITION BY project_name, supervoxel_id ORDER BY x, y, z) = 1""")
def q120_segments_of_coordinates(spark, d):
    li, p = table(spark, d, "lineitem"), F.col("p_partkey")
    requests = li.select(F.concat(F.lit("p"), (F.col("l_suppkey") % 3).cast("string")).alias("project_name"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    cells = table(spark, d, "part").groupBy((p % 6).alias("cx"), (F.floor(p / 6) % 3).alias("cy"), F.lit(0).cast("long").alias("cz")).agg(F.max(p % 7).alias("supervoxel_id"))
    return taskdb.segments_of_coordinates(requests, cells, (10, 5, 50))


@query("SELECT n_name AS project_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'new' UNION ALL SELECT 'newer'")
def q121_new_projects(spark, d):
    """Projects that exist (some user belongs to them) and checked inserts: one name exists, one is asked for twice, one has none."""
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    have = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_name").alias("project_name"))
    first = have.agg(F.min("project_name").alias("project_name"))
    asked = spark.createDataFrame([("new",), ("newer",), ("twice",), ("twice",), (None,)], "project_name string").unionByName(first)
    return taskdb.inserted(have, asked, ["project_name"])[0]
