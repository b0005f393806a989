"""Tables of the task database: checked inserts, flags, lookups, completion handlers.

Every function takes whole tables and batches of requests and returns new tables, so that a thousand requests
cost one join.  Requests that break a rule change nothing; they come back with a reason.  Null keys match nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<array<double>>"
#: What is read of a task's view state: annotation layers with points, segmentation layers with segments.
STATE = "struct<layers: array<struct<type: string, name: string, segments: array<string>, annotations: array<struct<point: array<double>>>>>>"


def checked(requests: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """``requests`` with ``reason``: that of the first rule that does not hold (null counts as not holding), else null."""
    reason = F.coalesce(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(text)) for holds, text in rules)) if rules else F.lit(None).cast("string")
    return requests.withColumn("reason", reason)


def inserted(df: DataFrame, requests: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with new rows, rejected requests): a request whose key exists, repeats or is null is rejected."""
    have = df.select(*keys).distinct().withColumn("_there", F.lit(True))
    counted = requests.groupBy(*keys).agg(F.count("*").alias("_n"))
    told = requests.join(counted, list(keys), "left").join(have, list(keys), "left")
    rules = [*((F.col(k).isNotNull(), f"no {k}") for k in keys), (F.col("_there").isNull(), "exists already"), (F.col("_n") == 1, "asked for twice")]
    told = checked(told, rules).drop("_there", "_n")
    return df.unionByName(told.where("reason is null").drop("reason"), allowMissingColumns=True), told.where("reason is not null")


def new_dependencies(dependencies: DataFrame, tasks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dependencies with the valid new ones, unsatisfied; rejected requests): tasks must differ and exist in the project."""
    ids = tasks.select("project_name", "task_id").distinct()
    known = requests.join(ids.withColumn("_a", F.lit(True)), ["project_name", "task_id"], "left")
    known = known.join(ids.select("project_name", F.col("task_id").alias("dependent_on_task_id"), F.lit(True).alias("_b")), ["project_name", "dependent_on_task_id"], "left")
    told = checked(known, [(F.col("task_id") != F.col("dependent_on_task_id"), "depends on itself"), (F.col("_a"), "no such task"), (F.col("_b"), "no such task to depend on")])
    good = told.where("reason is null").select(*requests.columns).withColumn("is_satisfied", F.lit(False))
    out, again = inserted(dependencies, good, ["project_name", "dependency_id"])
    return out, told.where("reason is not null").select(*requests.columns, "reason").unionByName(again.select(*requests.columns, "reason"))


def flagged(tasks: DataFrame, keys: DataFrame, paused: bool) -> DataFrame:
    """Tasks paused or unpaused by key."""
    hit = keys.select("project_name", "task_id").distinct().withColumn("_hit", F.lit(True))
    return tasks.join(hit, ["project_name", "task_id"], "left").withColumn("is_paused", F.coalesce(F.when(F.col("_hit"), F.lit(paused)), "is_paused")).drop("_hit").select(*tasks.columns)


def reactivated(tasks: DataFrame, keys: DataFrame) -> DataFrame:
    """Completed tasks by key are open again, without completion status and completer; open ones stay as they are."""
    hit = keys.select("project_name", "task_id").distinct().withColumn("_hit", F.col("task_id").isNotNull())
    out = tasks.join(hit, ["project_name", "task_id"], "left")
    again = F.coalesce("_hit", F.lit(False)) & (F.col("completion_status") != "")
    return out.withColumns({c: F.when(again, F.lit("")).otherwise(F.col(c)) for c in ("completion_status", "completed_user_id")}).select(*tasks.columns)


def paused_tasks(tasks: DataFrame, project: str, user: str | None = None) -> DataFrame:
    """Paused tasks of a project (and user), the highest priority first."""
    out = tasks.where((F.col("project_name") == project) & F.col("is_paused"))
    out = out if user is None else out.where(F.col("assigned_user_id") == user)
    return out.orderBy(F.col("priority").desc(), "task_id")


def across_projects(tasks: DataFrame, keys: DataFrame) -> DataFrame:
    """For each task id the task of the first project by name that has it."""
    own = tasks.join(keys.select("task_id").distinct(), "task_id", "left_semi")
    return own.groupBy("task_id").agg(F.min_by(F.struct(*[c for c in tasks.columns if c != "task_id"]), "project_name").alias("t")).select("task_id", "t.*")


def feedback_across_projects(feedback: DataFrame, tasks: DataFrame, users: DataFrame, user: str, limit: int = 20, skip: int = 0) -> DataFrame:
    """A page of a user's feedback in all projects they belong to, the newest first, with both tasks' states and a colour."""
    mine = users.where(F.col("user_id") == user).select("project_name").distinct()
    page = feedback.where(F.col("user_id") == user).join(mine, "project_name", "left_semi").orderBy(F.col("created_at").desc(), "project_name", "feedback_id").offset(skip).limit(limit)
    original = tasks.select("project_name", "task_id", F.col("ng_state").alias("task_link"))
    answer = tasks.select("project_name", F.col("task_id").alias("feedback_task_id"), F.col("ng_state").alias("feedback_link"), F.col("completion_status").alias("feedback"), "note", F.lit(True).alias("_there"))
    out = page.join(original, ["project_name", "task_id"], "left").join(answer, ["project_name", "feedback_task_id"], "left")
    kind = F.when(F.col("_there"), F.col("feedback")).otherwise(F.lit("Unknown"))
    colour = F.when(kind == "Accurate", F.lit("green")).when(kind == "Fair", F.lit("yellow")).otherwise(F.lit("red"))
    return out.withColumn("feedback", kind).withColumn("feedback_color", colour).drop("_there")


def edits_of(edits: DataFrame, project: str, task: str | None = None, user: str | None = None) -> DataFrame:
    """Edits of a project by task or user, the newest first."""
    out = edits.where(F.col("project_name") == project)
    out = out if task is None else out.where(F.col("task_id") == task)
    out = out if user is None else out.where(F.col("user_id") == user)
    return out.orderBy(F.col("created_at").desc(), F.col("edit_id").desc())


def submissions(timesheets: DataFrame, project: str, user: str | None = None, task: str | None = None, first=None, last=None) -> DataFrame:
    """Timesheet submissions under optional filters (both dates included), the newest first."""
    out = timesheets.where(F.col("project_name") == project)
    for column, value in (("user_id", user), ("task_id", task)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if first is None else out.where(F.col("submitted_at") >= F.lit(first))
    out = out if last is None else out.where(F.col("submitted_at") <= F.lit(last))
    return out.orderBy(F.col("submitted_at").desc(), F.col("submission_id").desc())


def marked(queue: DataFrame, keys: DataFrame, status: str, now: Column) -> DataFrame:
    """Queue entries of the keys in another state, with the time of the attempt."""
    if status not in ("processing", "completed"):
        raise ValueError(f"no state {status}")
    hit = keys.select("project_name", "seed_id").distinct().withColumn("_hit", F.lit(True))
    out = queue.join(hit, ["project_name", "seed_id"], "left")
    return out.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).withColumn("last_attempt", F.when(F.col("_hit"), now).otherwise(F.col("last_attempt"))).select(*queue.columns)


def cleaned_up(queue: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The queue without completed entries whose last attempt lies before the midnight of ``days`` ago."""
    old = (F.col("status") == "completed") & (F.col("last_attempt") < F.date_trunc("day", now) - F.expr(f"INTERVAL {days} DAYS"))
    return queue.where(~F.coalesce(old, F.lit(False)))


def annotations_of(state: Column) -> Column:
    """struct(seed, root, certain_ends, uncertain_ends, breadcrumbs) of a JSON view state: the first seed, the last root, all of the rest."""
    layers = F.filter(F.coalesce(F.from_json(state, STATE)["layers"], F.from_json(F.lit("[]"), "array<struct<type: string, name: string, segments: array<string>, annotations: array<struct<point: array<double>>>>>")), lambda x: x["type"] == "annotation")

    def named(name: str) -> Column:
        lists = F.transform(F.filter(layers, lambda x: x["name"] == name), lambda x: F.filter(F.transform(F.coalesce(x["annotations"], F.array().cast("array<struct<point: array<double>>>")), lambda a: a["point"]), lambda p: p.isNotNull()))
        return F.flatten(lists)

    seed, root = named("Seed Location"), named("Root Location")
    return F.struct(F.try_element_at(seed, F.lit(1)).alias("seed"), F.try_element_at(root, F.lit(-1)).alias("root"), named("Certain Ends").alias("certain_ends"), named("Uncertain Ends").alias("uncertain_ends"), named("Breadcrumbs").alias("breadcrumbs"))


def trace_verdict(state: Column, status: Column) -> Column:
    """Why a traced task must not be completed with a status, null if it may: what its view state has to hold."""
    parsed = F.from_json(state, STATE)
    layers = F.coalesce(parsed["layers"], F.array().cast("array<struct<type: string, name: string, segments: array<string>, annotations: array<struct<point: array<double>>>>>"))

    def layer(name: str) -> Column:
        return F.try_element_at(F.filter(layers, lambda x: x["name"] == name), F.lit(1))

    def count(name: str) -> Column:
        return F.coalesce(F.size(layer(name)["annotations"]), F.lit(0))

    segments = F.coalesce(F.size(F.filter(layer("Segmentation")["segments"], lambda s: ~s.startswith("!"))), F.lit(0))
    done = F.when(layer("Root Location").isNull(), F.lit("no root layer")).when(count("Root Location") != 1, F.lit("not one root")).when(count("Certain Ends") < 2, F.lit("too few certain ends"))
    stuck = F.when(count("Uncertain Ends") < 1, F.lit("no uncertain end"))
    return (
        F.when(status == "Faulty Task", F.lit(None).cast("string")).when(segments != 1, F.lit("not one segment")).when(status == "Done", done).when(status == "Can't Continue", stuck)
        .when(status.isin("Merger", "Wrong Cell Type"), F.lit(None).cast("string")).otherwise(F.lit("no such status"))
    )


def trace_completed(segments: DataFrame, endpoints: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, endpoints, follow-up tasks) after the completion of traced ``tasks``
    (project_name, task_id, seed_id, user_id, ng_state, completion_status).

    Faulty tasks change nothing.  A seed's endpoints are replaced by those of the state; "Done" asks for a follow-up.
    Of several tasks of one seed the last by id counts.
    """
    real = tasks.where((F.col("completion_status") != "Faulty Task") & F.col("seed_id").isNotNull())
    one = real.groupBy("project_name", "seed_id").agg(F.max_by(F.struct("task_id", "user_id", "ng_state", "completion_status"), "task_id").alias("t")).select("project_name", "seed_id", "t.*")
    one = one.withColumn("a", annotations_of(F.col("ng_state")))
    root = F.col("a.root")
    new = one.select(
        "project_name", "seed_id", F.lit(True).alias("_hit"), F.col("task_id").alias("_task"), root[0].alias("_x"), root[1].alias("_y"), (root[2] - 0.5).alias("_z"),
        F.when(F.col("completion_status").isin("Merger", "Wrong Cell Type"), F.lit("Wrong type")).otherwise(F.lit("Proofread")).alias("_status"),
    )
    joined = segments.join(new, ["project_name", "seed_id"], "left")
    changes = {f"root_{k}": F.coalesce(F.col(f"_{k}"), F.col(f"root_{k}")) for k in "xyz"} | {"status": F.coalesce("_status", "status"), "task_ids": F.when(F.col("_hit"), F.array_union(F.coalesce("task_ids", F.array().cast("array<string>")), F.array("_task"))).otherwise(F.col("task_ids"))}
    kinds = F.array(*(F.struct(F.lit(kind).alias("status"), F.col(f"a.{name}").alias("points")) for kind, name in (("CERTAIN", "certain_ends"), ("UNCERTAIN", "uncertain_ends"), ("BREADCRUMB", "breadcrumbs"))))
    ends = one.select("project_name", "seed_id", F.col("user_id").alias("user"), F.explode(kinds).alias("k")).select("project_name", "seed_id", "user", F.col("k.status").alias("status"), F.explode("k.points").alias("p"))
    ends = ends.select("project_name", "seed_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"), "status", "user")
    kept = endpoints.join(one.select("project_name", "seed_id"), ["project_name", "seed_id"], "left_anti")
    follow = one.where(F.col("completion_status") == "Done").select("project_name", F.concat(F.lit("postprocess_"), F.col("seed_id").cast("string"), F.lit("_"), "task_id").alias("task_id"), F.lit("trace_postprocess_v0").alias("task_type"), F.lit(10).alias("priority"), F.lit("postprocess").alias("batch_id"), F.col("task_id").alias("original_task_id"))
    return joined.withColumns(changes).select(*segments.columns), kept.unionByName(ends), follow


def feedback_recorded(tasks: DataFrame, answers: DataFrame) -> DataFrame:
    """(project_name, task_id, feedback_task_id, user_id) for completed feedback tasks
    (project_name, task_id, original_task_id, original_user, completion_status): whom the feedback is for."""
    original = tasks.select("project_name", F.col("task_id").alias("original_task_id"), F.nullif(F.col("completed_user_id"), F.lit("")).alias("_user"), F.lit(True).alias("_there"))
    out = answers.where((F.col("completion_status") != "Faulty Task") & F.col("original_task_id").isNotNull()).join(original, ["project_name", "original_task_id"])
    return out.select("project_name", F.col("original_task_id").alias("task_id"), F.col("task_id").alias("feedback_task_id"), F.coalesce("_user", "original_user", F.lit("unknown")).alias("user_id"))


def trace_tasks(segments: DataFrame, project: str, expected_type: str | None = None, status: str | None = None, batch: str | None = None, seeds: DataFrame | None = None, skip_existing: bool = True, priority: int = 50) -> DataFrame:
    """New tasks for the segments under all given filters; those that have tasks already are skipped."""
    out = segments.where(F.col("project_name") == project)
    for column, value in (("expected_segment_type", expected_type), ("status", status), ("batch", batch)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if seeds is None else out.join(seeds.select("seed_id").distinct(), "seed_id", "left_semi")
    out = out.where(F.coalesce(F.size("task_ids"), F.lit(0)) <= 0) if skip_existing else out
    return out.select("project_name", F.concat(F.lit("trace_"), F.col("seed_id").cast("string")).alias("task_id"), "seed_id", F.lit("trace_v0").alias("task_type"), F.lit(priority).alias("priority"))


def segments_of_coordinates(requests: DataFrame, cells: DataFrame, size: Sequence[int]) -> DataFrame:
    """New segments at coordinates (project_name, x, y, z): the supervoxel of the grid cell there is the seed; no supervoxel, no segment."""
    own = requests.withColumns({f"c{k}": F.floor(F.col(k) / s) for k, s in zip("xyz", size)})
    hit = own.join(cells.where("supervoxel_id <> 0"), ["cx", "cy", "cz"])
    return hit.groupBy("project_name", F.col("supervoxel_id").alias("seed_id")).agg(F.min(F.struct("x", "y", "z")).alias("p")).select("project_name", "seed_id", F.col("p.x").alias("seed_x"), F.col("p.y").alias("seed_y"), F.col("p.z").alias("seed_z"), F.lit("Raw").alias("status"))


def segment_statistics(segments: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Segments with the counts of synapses that start and end in their current id."""
    pre = before.groupBy(F.col("root_id").alias("current_segment_id")).agg(F.count("*").alias("_pre"))
    post = after.groupBy(F.col("root_id").alias("current_segment_id")).agg(F.count("*").alias("_post"))
    out = segments.drop("pre_synapse_count", "post_synapse_count").join(pre, "current_segment_id", "left").join(post, "current_segment_id", "left")
    return out.withColumn("pre_synapse_count", F.coalesce("_pre", F.lit(0))).withColumn("post_synapse_count", F.coalesce("_post", F.lit(0))).drop("_pre", "_post")


def split_supervoxels(supervoxels: DataFrame, leaves: DataFrame) -> DataFrame:
    """Supervoxels after splits: ``leaves`` (event_no, old_root, new_root, ordinal, supervoxel_id) list what each new root holds.

    Only supervoxels of the old root move; of several events the last counts, in one event the last new root.
    A null old root moves nothing.
    """
    own = supervoxels.select("supervoxel_id", F.col("current_segment_id").alias("old_root")).join(leaves, ["supervoxel_id", "old_root"])
    to = own.groupBy("supervoxel_id").agg(F.max_by("new_root", F.struct("event_no", "ordinal", "new_root")).alias("_to"))
    return supervoxels.join(to, "supervoxel_id", "left").withColumn("current_segment_id", F.coalesce("_to", "current_segment_id")).select(*supervoxels.columns)
