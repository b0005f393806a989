"""Edit-event streams: idempotent relabelling, latest-update queues and activity, as Structured Streaming.

An edit event names old roots and new ones.  Events may repeat; each event id
counts once.  A merge (one new root) relabels everything under its old roots, a
split (several) relabels by the given assignments, an event without new roots
changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..session import checkpointed

EVENT_SCHEMA = "event_id string, old_root_ids array<bigint>, new_root_ids array<bigint>, ts timestamp, table_id string"


def events(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100) -> DataFrame:
    """A stream of event files; malformed rows have a null event_id and are dropped."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).format(fmt).load(path).where("event_id is not null")


def classified(df: DataFrame) -> DataFrame:
    """With column ``operation``: merge, split or none."""
    n = F.size(F.coalesce("new_root_ids", F.array().cast("array<bigint>")))
    return df.withColumn("operation", F.when(n == 1, "merge").when(n > 1, "split").otherwise("none"))


def once(df: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once; state is kept as long as events may be late."""
    if df.isStreaming:
        return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return df.dropDuplicates(["event_id"])


def moves(df: DataFrame) -> DataFrame:
    """(old_root, new_root, ts, event_id) of the merges."""
    merges = classified(df).where("operation = 'merge'")
    return merges.select(F.explode("old_root_ids").alias("old_root"), F.element_at("new_root_ids", 1).alias("new_root"), "ts", "event_id").where("old_root <> new_root")


def relabelled(labels: DataFrame, moved: DataFrame, max_rounds: int = 32) -> DataFrame:
    """labels (id, root) after the moves: the latest move of a root counts, and chains of moves are followed.

    Each round doubles the length that is followed, and ends when no chain is left; raises if moves run in a circle.
    """
    step = checkpointed(moved.groupBy("old_root").agg(F.max_by("new_root", F.struct("ts", "event_id")).alias("new_root")))
    for _ in range(max_rounds):
        nxt = step.select(F.col("old_root").alias("new_root"), F.col("new_root").alias("further"))
        if step.join(nxt, "new_root", "left_semi").isEmpty():
            break
        step = checkpointed(step.join(nxt, "new_root", "left").select("old_root", F.coalesce("further", "new_root").alias("new_root")))
    else:
        raise ValueError("moves run in a circle")
    return labels.join(step.withColumnRenamed("old_root", "root"), "root", "left").select("id", F.coalesce("new_root", "root").alias("root"))


def queue_latest(queue: DataFrame, updates: DataFrame, key: str = "seed_id") -> DataFrame:
    """The queue after updates: one pending row for each key; status, retries and error start anew, last_attempt stays."""
    fresh = updates.groupBy(key).agg(F.max(F.struct("ts", "root")).alias("u")).select(key, F.col("u.root").alias("_root"), F.col("u.ts").alias("_ts"))
    j = queue.join(fresh, key, "full")
    hit = F.col("_ts").isNotNull()
    return j.select(key, F.coalesce("_root", "root").alias("root"), F.when(hit, "pending").otherwise(F.col("status")).alias("status"), F.when(hit, 0).otherwise(F.col("retry_count")).alias("retry_count"), F.when(hit, F.col("_ts")).otherwise(F.col("created_at")).alias("created_at"), "last_attempt", F.when(~hit, F.col("error")).alias("error"))


def run_listener(stream: DataFrame, state_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies the merges of a stream to the label table in ``state_dir``.

    Each micro-batch writes a new version of the table, named by the batch, so that a batch that runs again
    after a failure overwrites its own version and reads the one before: the result counts every event once.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        now = current_labels(spark, state_dir, before=batch_id)
        relabelled(now, moves(batch)).write.mode("overwrite").parquet(os.path.join(state_dir, f"version={batch_id}"))

    writer = once(stream).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def _versions(spark: SparkSession, state_dir: str) -> list[int]:
    """Versions in a folder of any Hadoop file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{state_dir}/{n}/_SUCCESS")))


def current_labels(spark: SparkSession, state_dir: str, before: int | None = None) -> DataFrame:
    """The label table after the last batch (before the given one)."""
    done = [v for v in _versions(spark, state_dir) if before is None or v < before]
    if not done:
        raise FileNotFoundError(f"no labels in {state_dir}")
    return spark.read.parquet(os.path.join(state_dir, f"version={done[-1]}"))


def start_labels(labels: DataFrame, state_dir: str) -> None:
    """Writes the first version."""
    labels.select("id", "root").write.mode("overwrite").parquet(os.path.join(state_dir, "version=-1"))


def activity(stream: DataFrame, key: str, at: str, window: str, late: str = "1 hour") -> DataFrame:
    """Rows of each key and window of event time, late rows admitted within the watermark."""
    df = stream.withWatermark(at, late) if stream.isStreaming else stream
    return df.groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
