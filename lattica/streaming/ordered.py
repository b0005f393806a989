"""Merges and splits of one stream, applied in the order of their events, late ones included.

An id stands under a root.  A merge moves every id under its old roots to the new
one; a split moves the ids that it assigns, if they stand under its old roots at that time.
Order is (ts, event_id), whatever the order of arrival.  Each id remembers its first
root and the last event that moved it: ids moved before a late event go on from where they
stand, only those moved later are replayed from their first root.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..session import checkpointed
from .edits import EVENT_SCHEMA, classified, current_labels

ORDERED_SCHEMA = f"{EVENT_SCHEMA}, assigned array<struct<id: bigint, root: bigint>>"
_BEFORE_ALL = "struct(timestamp'0001-01-01 00:00:00' AS ts, '' AS event_id)"


def steps(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log's merges (old_root, new_root, at) and splits (id, old_root, new_root, at); repeated events count once, events without a time or an id not at all."""
    own = classified(log.where("ts IS NOT NULL AND event_id IS NOT NULL").dropDuplicates(["event_id"])).withColumn("at", F.struct("ts", "event_id"))
    old = F.explode(F.array_distinct("old_root_ids")).alias("old_root")
    merges = own.where("operation = 'merge'").select(old, F.element_at("new_root_ids", 1).alias("new_root"), "at").where("old_root <> new_root")
    splits = own.where("operation = 'split'").select(old, "assigned", "at").select("old_root", F.explode("assigned").alias("a"), "at")
    return merges, splits.select("a.id", "old_root", F.col("a.root").alias("new_root"), "at").where("old_root <> new_root")


def replayed(state: DataFrame, log: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """State (id, first_root, root, at) after the events of the log that come after each id's ``at``.

    Each round moves every id by its next event.  The next merge is looked up once
    for each root and time that ids stand at, so ids that move together cost one row.
    Raises if ``max_rounds`` do not suffice; rounds are the longest chain of moves of one id.
    """
    merges, splits = (checkpointed(s) for s in steps(log))
    done = None
    now = checkpointed(state)
    for _ in range(max_rounds):
        stands = now.select("root", "at").distinct()
        m = stands.join(merges.select(F.col("old_root").alias("root"), "new_root", F.col("at").alias("next")), "root").where("next > at")
        m = m.groupBy("root", "at").agg(F.min(F.struct("next", "new_root")).alias("merge"))
        s = now.select("id", "root", "at").join(splits.select("id", F.col("old_root").alias("root"), "new_root", F.col("at").alias("next")), ["id", "root"]).where("next > at")
        s = s.groupBy("id").agg(F.min(F.struct("next", "new_root")).alias("split"))
        moved = checkpointed(now.join(m, ["root", "at"], "left").join(s, "id", "left").withColumn("step", F.least("merge", "split")))
        still = moved.where("step IS NULL").select("id", "first_root", "root", "at")
        done = still if done is None else done.unionByName(still)
        now = moved.where("step IS NOT NULL").select("id", "first_root", F.col("step.new_root").alias("root"), F.col("step.next").alias("at"))
        if now.isEmpty():
            return done
    raise RuntimeError(f"moves did not end in {max_rounds} rounds")


def applied(state: DataFrame, log: DataFrame, fresh: DataFrame) -> DataFrame:
    """State after new events ``fresh`` have joined the log (which holds them)."""
    first = fresh.where("ts IS NOT NULL AND event_id IS NOT NULL").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    late = F.col("first").isNotNull() & (F.col("at") >= F.col("first"))
    begun = state.crossJoin(F.broadcast(first)).select("id", "first_root", F.when(late, F.col("first_root")).otherwise(F.col("root")).alias("root"), F.when(late, F.expr(_BEFORE_ALL)).otherwise(F.col("at")).alias("at"))
    return replayed(begun, log)


def start(labels: DataFrame, state_dir: str) -> None:
    """Writes the first version of the state from labels (id, root)."""
    labels.select("id", F.col("root").alias("first_root"), "root", F.expr(_BEFORE_ALL).alias("at")).write.mode("overwrite").parquet(os.path.join(state_dir, "version=-1"))


def run_ordered_listener(stream: DataFrame, state_dir: str, log_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Applies a stream of ORDERED_SCHEMA to the state in ``state_dir``.

    A micro-batch writes its part of the log and a new version of the state, both
    named by the batch; one that runs again after a failure overwrites its own and reads those before.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        mine = batch.where("event_id is not null").select("event_id", "old_root_ids", "new_root_ids", "ts", "assigned")
        mine.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(log_dir, f"part={batch_id}"))
        log = spark.read.parquet(os.path.join(log_dir, "part=*")).where(F.col("batch") <= batch_id)
        applied(current_labels(spark, state_dir, before=batch_id), log, log.where(F.col("batch") == batch_id)).write.mode("overwrite").parquet(os.path.join(state_dir, f"version={batch_id}"))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def ordered_labels(spark: SparkSession, state_dir: str) -> DataFrame:
    """(id, root) after the last batch."""
    return current_labels(spark, state_dir).select("id", "root")
