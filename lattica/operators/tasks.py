"""Task tables: leases, completion, dependencies and timesheets as changes from one table to the next.

A request is decided on the table as it was; of several requests for a task the first (by time, then user) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: seconds after which a lease may be taken over.
IDLE_SECONDS = 90


def started(tasks: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Tasks after requests (task_id, user_id): leased if active, not completed, and free, one's own, or idle.

    Column ``accepted`` tells the outcome; null where nobody asked.
    """
    first = requests.groupBy("task_id").agg(F.min("user_id").alias("_user"))
    t = tasks.join(first, "task_id", "left")
    free = (F.col("active_user_id") == "") | (F.col("active_user_id") == F.col("_user")) | (F.col("last_leased_ts") <= now - IDLE_SECONDS)
    ok = F.col("_user").isNotNull() & F.col("is_active") & (F.col("completion_status") == "") & free
    return t.withColumns({"active_user_id": F.when(ok, F.col("_user")).otherwise(F.col("active_user_id")), "last_leased_ts": F.when(ok, now).otherwise(F.col("last_leased_ts")), "accepted": F.when(F.col("_user").isNotNull(), ok)}).drop("_user")


def completed(tasks: DataFrame, releases: DataFrame) -> DataFrame:
    """Tasks after releases (task_id, user_id, status); only the active user's count."""
    r = releases.groupBy("task_id", F.col("user_id").alias("active_user_id")).agg(F.max("status").alias("_status"))
    t = tasks.join(r, ["task_id", "active_user_id"], "left")
    hit = F.col("_status").isNotNull()
    return t.withColumns({"completion_status": F.when(hit, F.col("_status")).otherwise(F.col("completion_status")), "completed_user_id": F.when(hit, F.col("active_user_id")).otherwise(F.lit("")), "active_user_id": F.when(hit, "").otherwise(F.col("active_user_id"))}).drop("_status")


def satisfied(dependencies: DataFrame, tasks: DataFrame) -> DataFrame:
    """Dependencies after the tasks' completion: satisfied once the upstream has the required status."""
    up = tasks.select(F.col("task_id").alias("dependent_on_task_id"), F.col("completion_status").alias("_s"))
    return dependencies.join(up, "dependent_on_task_id", "left").withColumn("is_satisfied", F.col("is_satisfied") | F.coalesce(F.col("_s") == F.col("required_completion_status"), F.lit(False))).drop("_s")


def activated(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Tasks that wait for dependencies become active when all of theirs are satisfied."""
    ready = dependencies.groupBy("task_id").agg(F.bool_and("is_satisfied").alias("_ready"))
    return tasks.join(ready, "task_id", "left").withColumn("is_active", F.col("is_active") | F.coalesce("_ready", F.lit(False))).drop("_ready")


def with_time(timesheet: DataFrame, submissions: DataFrame) -> DataFrame:
    """(user_id, task_id, seconds_spent): the timesheet with submitted seconds added."""
    keys = ["user_id", "task_id"]
    return timesheet.select(*keys, "seconds_spent").unionByName(submissions.select(*keys, "seconds_spent")).groupBy(*keys).agg(F.sum("seconds_spent").alias("seconds_spent"))


def task_costs(timesheet: DataFrame, users: DataFrame) -> DataFrame:
    """(task_id, seconds, cost): time and cost of each task at its users' hourly rates."""
    return timesheet.join(users.select("user_id", "hourly_rate"), "user_id", "left").groupBy("task_id").agg(F.sum("seconds_spent").alias("seconds"), F.sum(F.col("seconds_spent") / 3600 * F.coalesce("hourly_rate", F.lit(0.0))).alias("cost"))
