"""Queries of the record, document and ranking operators on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import scalar, spatial
from ..operators import docstore, matching, ranking, records
from ..session import checkpointed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("""SELECT c_custkey, o_orderkey, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'O'
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderpriority, o_orderkey) = 1""")
def q27_next_task(spark, d):
    """The open task of the highest priority for each user."""
    open_ = table(spark, d, "orders").where("o_orderstatus = 'O'").withColumnRenamed("o_custkey", "c_custkey")
    best = ranking.top_of_each(open_, ["c_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")])
    return best.join(table(spark, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", "o_orderkey", "o_orderpriority")


@query("""WITH t AS (SELECT o_custkey, o_orderkey, 1 AS strategy, o_orderpriority FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, o_orderkey, 2, o_orderpriority FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, o_orderkey, 3, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')
SELECT o_custkey, o_orderkey, strategy FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY strategy, o_orderpriority, o_orderkey) = 1""")
def q28_fallback_chain(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    parts = [o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'O'"), o.where("o_orderdate < timestamp '1996-01-01'")]
    return ranking.fallback_chain(parts, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "strategy")


@query("SELECT o_orderpriority, count(*) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_done, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_open, CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS n_large FROM orders GROUP BY ALL")
def q29_task_summary(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(s == "F").alias("n_done"), F.count_if(s == "O").alias("n_open"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"))


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) > 1")
def q30_duplicate_groups(spark, d):
    return ranking.duplicate_groups(table(spark, d, "orders"), ["o_custkey"])


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderdate DESC, o_totalprice DESC, o_orderkey) > 1 AS is_duplicate FROM orders")
def q31_duplicate_winner(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return ranking.marked_duplicates(o, ["o_custkey"], [F.col("o_orderstatus"), F.desc("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "o_custkey", "is_duplicate")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_shipdate END ASC NULLS FIRST, l_extendedprice, l_linenumber, l_partkey) = 1")
def q32_primary_row(spark, d):
    """The row with the earliest merge of each root; unmerged ones first."""
    li = table(spark, d, "lineitem")
    merged = F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(F.col("l_shipdate"))
    return ranking.top_of_each(li, ["l_orderkey"], [merged.asc_nulls_first(), F.col("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey")
def q33_unlocked(spark, d):
    locked = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return docstore.deleted(table(spark, d, "customer"), locked, ["c_custkey"]).select("c_custkey")


@query("SELECT doc_id, CASE WHEN n_chars < 200 THEN 'invalid' WHEN quality IS NULL THEN 'new' WHEN quality = 1 THEN 'matching' ELSE 'conflict' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def q34_ingest_states(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    j = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("n_chars") < 200, "invalid").when(F.col("quality").isNull(), "new").when(F.col("quality") == 1, "matching").otherwise("conflict").alias("state"))


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS seconds, round(sum(value) / 3600, 6) AS hours FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def q35_work_history(spark, d):
    e = table(spark, d, "events").where("ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("seconds"), F.round(F.sum("value") / 3600, 6).alias("hours"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q36_queue_latest(spark, d):
    """The latest update of each key; one partial aggregation instead of a sort."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return e.select("user_id", "e.event_id", "e.event_type")


@query("SELECT l_orderkey, count(*) AS n, CAST(count(*) FILTER (WHERE l_linestatus <> 'F') AS BIGINT) AS n_open, count(*) FILTER (WHERE l_linestatus <> 'F') = 0 AS is_ready FROM lineitem GROUP BY l_orderkey")
def q37_ready_items(spark, d):
    return records.ready(table(spark, d, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F")


_TOKENS = "SELECT conv_id, turn, role, string_split(text, ' ') AS tokens FROM conversations"


def _conversations(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.split("text", " ").alias("tokens"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') OR n_chars > 5000")
def q38_filter_any(spark, d):
    return docstore.matching(table(spark, d, "documents"), {"lang": ["de", "fr"], ">n_chars": [5000]}, True, ["doc_id", "lang", "n_chars"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') AND n_chars > 2000 AND source IN ('src0', 'src1', 'src2')")
def q39_filter_all(spark, d):
    return docstore.matching(table(spark, d, "documents"), {"lang": ["de", "fr"], ">n_chars": [2000], "source": ["src0", "src1", "src2"]}, False, ["doc_id", "lang", "n_chars"])


@query(f"SELECT conv_id, turn, role FROM ({_TOKENS}) WHERE list_has_any(tokens, ['the', 'les', 'und'])")
def q40_array_contains_any(spark, d):
    return docstore.matching(_conversations(spark, d), {"-tokens": ["the", "les", "und"]}, True, ["conv_id", "turn", "role"])


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(list_distinct(list(event_type)), lambda x: x NOT IN ('click', 'view')), ['seen']))), ',') AS tags FROM events GROUP BY user_id")
def q41_array_update(spark, d):
    tags = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return tags.select("user_id", F.concat_ws(",", docstore.array_updated(F.col("t"), F.array(F.lit("seen")), F.array(F.lit("click"), F.lit("view")))).alias("tags"))


@query("SELECT c_custkey, coalesce(n.seg, c_mktsegment) AS c_mktsegment, c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, CASE WHEN max(o_totalprice) > 300000 THEN 'LARGE' END AS seg FROM orders GROUP BY ALL) n ON o_custkey = c_custkey")
def q42_partial_update(spark, d):
    change = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.max("o_totalprice") > 300000, "LARGE").alias("c_mktsegment"))
    return docstore.partial_update(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), change, "c_custkey", ["c_mktsegment"])


@query("""WITH p AS (SELECT p_brand, p_size, max(p_retailprice) AS price FROM part GROUP BY ALL HAVING count(*) = 1),
u AS (SELECT l_returnflag, p_brand, p_size, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_returnflag, round(sum(l_quantity), 4) AS hours, round(sum(l_quantity * coalesce(price, 0)), 4) AS cost FROM u LEFT JOIN p USING (p_brand, p_size) GROUP BY ROLLUP (l_returnflag)""")
def q43_node_costs(spark, d):
    part = table(spark, d, "part")
    usage = table(spark, d, "lineitem").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey")
    out = records.costs(usage, part.withColumnRenamed("p_retailprice", "price"), ["p_brand", "p_size"], F.col("l_quantity"), "price", "l_returnflag")
    return out.withColumns({"hours": F.round("hours", 4), "cost": F.round("cost", 4)})


@query("SELECT event_type, user_id % 10 AS worker, grouping(user_id % 10) AS fleet, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, max(value) AS peak FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 10))")
def q44_grouping_sets(spark, d):
    """Totals for the fleet and for each worker in one pass."""
    e = table(spark, d, "events").withColumn("worker", F.col("user_id") % 10)
    sets = e.groupingSets([["event_type"], ["event_type", "worker"]], "event_type", "worker")
    return sets.agg(F.grouping("worker").cast("long").alias("fleet"), F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("peak")).select("event_type", "worker", "fleet", "n", "total", "mean", "peak")


@query("SELECT event_type, round(avg(value), 6) AS mean, max(value) AS peak, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS p25, CAST(max(event_id) - min(event_id) AS BIGINT) AS delta FROM events GROUP BY ALL")
def q45_summary_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("peak"), F.min("value").alias("low"), F.round(F.percentile("value", F.lit(0.25)), 6).alias("p25"), (F.max("event_id") - F.min("event_id")).alias("delta"))


@query("WITH s AS (SELECT user_id, event_type, sum(value) AS t FROM events GROUP BY ALL), g AS (SELECT *, t / sum(t) OVER (PARTITION BY user_id) AS share FROM s) SELECT user_id, arg_max(event_type, t) AS bottleneck, round(max(share), 6) AS share FROM g GROUP BY user_id")
def q46_bottleneck(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("t"))
    g = s.withColumn("share", F.col("t") / F.sum("t").over(Window.partitionBy("user_id")))
    return g.groupBy("user_id").agg(F.max_by("event_type", "t").alias("bottleneck"), F.round(F.max("share"), 6).alias("share"))


_SIDES = "SELECT l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS x, l_quantity * 10 AS y, l_discount * 1000 AS z, l_suppkey % 2 AS side FROM lineitem"


def _points(spark, d):
    """All line items as points of two sides, by the parity of their supplier."""
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 10).alias("y"), (F.col("l_discount") * 1000).alias("z"), (F.col("l_suppkey") % 2).alias("side"))


def _sides(spark, d):
    p = _points(spark, d).distinct()
    return p.where("side = 0").drop("side"), p.where("side = 1").drop("side")


def _pairs(spark, d):
    a, b = _sides(spark, d)
    right = b.select(*[F.col(c).alias(f"{c}_r") for c in b.columns])
    return spatial.distance_pairs(a, right, 12.0, ["x", "y", "z"])


@query(f"WITH p AS (SELECT DISTINCT id, x, y, z, side FROM ({_SIDES})) SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS dist FROM (SELECT * FROM p WHERE side = 0) a JOIN (SELECT * FROM p WHERE side = 1) b ON b.x > a.x - 12 AND b.x < a.x + 12 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 144")
def q47_range_join(spark, d):
    return _pairs(spark, d).select(F.col("id").alias("a"), F.col("id_r").alias("b"), F.round("dist", 6).alias("dist"))


@query()
def q48_match_scores(spark, d):
    """Optimal one-to-one matching of the pairs of q47, ids with the same places as one; tests hold it against brute force."""
    axes = ["x", "y", "z"]
    both = checkpointed(matching.alike(_points(spark, d).where("side in (0, 1)").repartition("id"), axes, ["side"]))
    a, b = (both.where(F.col("side") == s).drop("side") for s in (0, 1))
    total = lambda df: df.select(F.col("n_points").alias("n"))
    return matching.scores(total(a), total(b), matching.matched(matching.alike_pairs(a, b, 12.0, axes)))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT doc_id FROM documents WHERE n_chars > 1000) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def q49_compare_sets(spark, d):
    return records.compared(table(spark, d, "documents").where("n_chars > 1000"), table(spark, d, "labels"), "doc_id")


@query("SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://[^/]+/([^/?]+)', 1), '') AS bucket FROM pages")
def q50_bucket_from_url(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.bucket_of(F.col("url")).alias("bucket"))


@query("SELECT CASE WHEN url LIKE 'https%' THEN 'GET' ELSE 'POST' END AS method, CASE WHEN url LIKE 'https%' THEN 'B' ELSE 'A' END AS class, count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY ALL")
def q51_request_classes(spark, d):
    method = F.when(F.col("url").startswith("https"), "GET").otherwise("POST")
    p = table(spark, d, "pages").select(method.alias("method"), scalar.request_class(method, F.col("url")).alias("class"), scalar.egress_bytes(F.lit(None).cast("string"), F.col("html")).alias("b"))
    return p.groupBy("method", "class").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q52_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 10 AND l_quantity < 30 AND l_discount >= 0.02 AND l_discount < 0.08 THEN 1 ELSE 0 END AS roi_mask, CASE WHEN l_quantity > 40 THEN 0.0 ELSE l_quantity END AS filled, least(greatest(l_quantity, 5.0), 45.0) AS clamped, CAST(floor(-l_quantity / 7) AS BIGINT) AS floored, (1 - CAST(l_quantity AS BIGINT) + 256) % 256 AS inverted FROM lineitem")
def q53_masks_and_fills(spark, d):
    q, disc = F.col("l_quantity"), F.col("l_discount")
    roi = spatial.contains([q, disc], [(10.0, 30.0), (0.02, 0.08)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(roi, 1).otherwise(0).alias("roi_mask"), scalar.compare(q, "gt", 40, 0.0).alias("filled"), scalar.clamped(q, 5.0, 45.0).alias("clamped"), scalar.int_divide(-q, 7).alias("floored"), scalar.invert_uint8(q.cast("long")).alias("inverted"))


@query("SELECT event_id, round(1.1 * user_id + 0.2 * value + 3 - user_id, 6) AS dx, round(-0.1 * user_id + 0.9 * value - 2 - value, 6) AS dy FROM events")
def q54_affine_field(spark, d):
    dx, dy = scalar.affine_field(F.col("user_id"), F.col("value"), ((1.1, 0.2, 3), (-0.1, 0.9, -2)))
    return table(spark, d, "events").select("event_id", F.round(dx, 6).alias("dx"), F.round(dy, 6).alias("dy"))


@query(f"SELECT token, count(DISTINCT conv_id) AS n_convs, array_to_string(list_sort(list_distinct(list(conv_id))), ',') AS convs FROM (SELECT conv_id, unnest(tokens) AS token FROM ({_TOKENS})) WHERE length(token) > 12 GROUP BY token")
def q61_related_index(spark, d):
    """Inverted index: related key -> the rows that name it."""
    rows = _conversations(spark, d).select("conv_id", F.explode("tokens").alias("token")).where(F.char_length("token") > 12)
    out = rows.groupBy("token").agg(F.sort_array(F.collect_set("conv_id")).alias("convs"))
    return out.select("token", F.size("convs").cast("long").alias("n_convs"), F.concat_ws(",", F.col("convs").cast("array<string>")).alias("convs"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def q63_sessions(spark, d):
    return ranking.sessions(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", 6 * 3600)


@query("SELECT user_id AS run, max(ts) AS seen FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR")
def q64_stale_runs(spark, d):
    e = table(spark, d, "events")
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.min("ts").alias("started"))
    beats = e.groupBy(F.col("user_id").alias("run")).agg(F.max("ts").alias("beat"))
    return records.stale(runs, beats, "run", F.lit("2024-01-31").cast("timestamp"), 36 * 3600).select("run", "seen")


@query("SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY ALL")
def q66_shares(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return ranking.share_of_total(n, "n", "percent").withColumn("percent", F.round(F.col("percent") * 100, 6))


@query("SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) v(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def q67_zero_filled_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"))
    return records.counted(o, ["O", "F", "P", "X"], "status")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders SEMI JOIN (SELECT o_custkey, o_orderdate FROM orders GROUP BY ALL HAVING count(*) > 1) USING (o_custkey, o_orderdate)")
def q68_rows_of_duplicate_groups(spark, d):
    return ranking.rows_of_groups(table(spark, d, "orders"), ["o_custkey", "o_orderdate"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("(SELECT l_partkey AS k, 'both' AS side FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, 'both' FROM lineitem WHERE l_returnflag = 'R') UNION ALL (SELECT l_partkey, 'only' FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey, 'only' FROM lineitem WHERE l_returnflag = 'R')")
def q69_set_operations(spark, d):
    li = table(spark, d, "lineitem")
    a, r = (li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")) for f in "AR")
    return a.intersect(r).withColumn("side", F.lit("both")).unionByName(a.subtract(r).withColumn("side", F.lit("only")))


@query("SELECT user_id AS seed_id, CASE WHEN peak > 150 THEN CASE WHEN n % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE 'processing' END AS status, CAST(CASE WHEN peak > 150 THEN n % 4 + 1 ELSE n % 4 END AS BIGINT) AS retry_count FROM (SELECT user_id, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL)")
def q70_queue_retries(spark, d):
    """Queue items whose attempt took too long go back to the queue, or fail for good."""
    q = table(spark, d, "events").groupBy(F.col("user_id").alias("seed_id")).agg((F.count("*") % 4).alias("retry_count"), F.max("value").alias("peak")).withColumn("status", F.lit("processing"))
    return records.retried(q, q.where("peak > 150"), "seed_id", 3).select("seed_id", "status", "retry_count")


@query("SELECT s_suppkey AS c_custkey, s_name AS c_name, s_acctbal AS c_acctbal FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer ANTI JOIN supplier ON s_suppkey = c_custkey")
def q71_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return docstore.upsert(c, rows, ["c_custkey"])
