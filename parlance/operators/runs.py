"""History of job runs: job_id, job_name, run_id, start_time (ms), result_state, run_duration
(ms) and tasks, an array of structs with task_key, result_state and error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.mask import redact_error

# States of a task that failed by itself, and of one whose predecessor failed
ROOT_FAILURES = ("FAILED", "TIMEDOUT", "INTERNAL_ERROR", "CANCELED")
CASCADED = "UPSTREAM_FAILED"


def task_state(task: Column) -> Column:
    return F.upper(F.trim(F.coalesce(task["result_state"], F.lit(""))))


def failed_tasks(tasks: Column) -> Column:
    """Tasks that failed by themselves; if there are none, those that failed with another."""
    named = F.filter(
        F.coalesce(tasks, F.array().cast("array<struct<task_key:string,result_state:string,error:string>>")),
        lambda t: F.coalesce(t["task_key"], F.lit("")) != "",
    )
    root = F.filter(
        named,
        lambda t: (task_state(t) != CASCADED) & task_state(t).rlike("|".join(ROOT_FAILURES)),
    )
    cascaded = F.filter(named, lambda t: task_state(t) == CASCADED)
    return F.when(F.size(root) > 0, root).otherwise(cascaded)


def failure_records(runs: DataFrame) -> DataFrame:
    """Runs with the keys of their failed tasks and a map from task to redacted error.

    The tasks of one run are an array of a job's few tasks, so they are worked on in place.
    """
    failed = runs.withColumn("_failed", failed_tasks(F.col("tasks")))
    # a key listed twice keeps its last error
    errors = F.aggregate(
        "_failed",
        F.create_map().cast("map<string,string>"),
        lambda acc, t: F.map_concat(
            F.map_filter(acc, lambda key, _: key != t["task_key"]),
            F.create_map(
                t["task_key"],
                redact_error(
                    F.when(F.coalesce(t["error"], F.lit("")) != "", t["error"]).otherwise(
                        "Unknown error"
                    )
                ),
            ),
        ),
    )
    return failed.select(
        "job_id",
        "job_name",
        "run_id",
        F.transform("_failed", lambda t: t["task_key"]).alias("failed_tasks"),
        errors.alias("errors"),
        F.col("start_time").cast("string").alias("timestamp"),
    )


def recent_failures(
    runs: DataFrame, as_of: Column, hours: int = 1, newest: int | None = None
) -> DataFrame:
    """Failure records of the runs of the last hours that have a failed task; with ``newest``,
    only so many failed runs of each job."""
    now = F.unix_millis(as_of)
    started = F.col("start_time").between(now - hours * 3_600_000, now)
    # WITH_FAILURES holds no FAILED
    failed = runs.filter(started & F.col("result_state").rlike("FAILED|WITH_FAILURES"))
    failed = failed.filter(F.size(failed_tasks(F.col("tasks"))) > 0)
    if newest is None:
        return failure_records(failed)
    latest_first = Window.partitionBy("job_id").orderBy(
        F.col("start_time").desc(), F.col("run_id").desc()
    )
    placed = failed.withColumn("_place", F.row_number().over(latest_first))
    return failure_records(placed.filter(F.col("_place") <= newest).drop("_place"))


def pipeline_summary(runs: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Latest run per job: state, start in Brasília time, seconds, state per task.

    Jobs listed in ``jobs`` (job_id) that never ran show NO_RUNS. Of a task that a run lists
    several times (retries) the last entry counts; tasks without a key stand under "unknown".
    """
    latest = (
        runs.groupBy("job_id")
        .agg(
            F.max_by(
                F.struct("result_state", "start_time", "run_duration", "tasks"),
                F.struct("start_time", "run_id"),
            ).alias("run")
        )
        .withColumn("_ran", F.lit(True))
    )
    if jobs is not None:
        latest = jobs.select("job_id").distinct().join(latest, "job_id", "left")
    started = F.from_utc_timestamp(
        F.timestamp_millis(F.col("run.start_time")), "-03:00"
    )
    states = F.transform(
        F.col("run.tasks"),
        lambda t: F.struct(
            F.coalesce(t["task_key"], F.lit("unknown")).alias("key"),
            F.coalesce(t["result_state"], F.lit("UNKNOWN")).alias("state"),
        ),
    )
    # an entry goes if a later one has its key
    last = F.filter(
        states,
        lambda t, i: ~F.exists(
            F.slice(states, i + 2, F.greatest(F.size(states), F.lit(1))),
            lambda later: later["key"] == t["key"],
        ),
    )
    return latest.select(
        "job_id",
        F.when(
            F.col("_ran"), F.coalesce(F.col("run.result_state"), F.lit("UNKNOWN"))
        ).otherwise("NO_RUNS").alias("status"),
        F.concat(
            F.date_format(started, "yyyy-MM-dd HH:mm:ss"), F.lit(" (horario de Brasilia)")
        ).alias("last_run_at"),
        (F.coalesce(F.col("run.run_duration"), F.lit(0)) / 1000).alias("duration_sec"),
        F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>")).alias(
            "tasks"
        ),
    )
