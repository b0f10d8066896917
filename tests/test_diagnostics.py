import pytest
from pyspark.sql import functions as F

from parlance.operators import diagnostics, platform_metrics, runs

COSTS = [
    ("anthropic", "claude-opus-x", 1000, 500, 0.0525),
    ("anthropic", "claude-sonnet-x", 2000, 1000, 0.021),
    ("openai", "gpt-4o", 5000, 2000, 0.0325),
    ("openai", "gpt-4-0613", 1000, 0, 0.03),
    ("nobody", "claude-opus", 1000, 500, 0.0),
    ("anthropic", "unknown", 1000, 500, 0.0),
    ("anthropic", "claude-opus", 0, 0, 0.0),
    (" ANTHROPIC ", "Claude-Opus-x", 1000, 500, 0.0525),
    (None, None, None, None, 0.0),
]


def test_cost(spark):
    df = spark.createDataFrame(COSTS, "p string, m string, i bigint, o bigint, want double")
    cost = diagnostics.cost_usd(F.col("p"), F.col("m"), F.col("i"), F.col("o"))
    assert df.filter(cost != F.col("want")).count() == 0


def test_error_hash(one_column):
    a, b, c, d, e = one_column(["x", " x \n", "y", "", None], diagnostics.error_hash)
    assert a == b != c and d == e and len(d) == 64


def raw(spark):
    return spark.sql(
        """select id, cast(ts as timestamp) as timestamp, 1L as job_id, 2L as run_id, 'task' as
        failed_task, error as error_message, status, 1.23456D as duration_seconds, pr as pr_number
        from values
        ('a', '2024-01-02 10:00:00', 'open one', 'success', 10L),
        ('b', '2024-01-02 10:00:00', 'merged one', 'success', 11L),
        ('c', '2024-01-02 10:00:00', 'closed one', 'success', 12L),
        ('d', '2024-01-02 10:00:00', 'odd one', 'success', 13L),
        ('e', '2024-01-02 10:00:00', 'no lookup', 'success', 14L),
        ('f', '2024-01-02 10:00:00', 'no number', 'success', null),
        ('g', '2024-01-01 10:00:00', 'too old', 'success', 15L),
        ('h', '2024-01-02 10:00:00', 'failed one', 'llm_failed', 0L)
        as t(id, ts, error, status, pr)"""
    )


def test_records(spark):
    row = diagnostics.build_records(raw(spark)).filter("id = 'f'").first()
    assert row["duration_seconds"] == 1.235 and row["pr_number"] == 0 and row["provider"] == ""
    assert row["pr_status"] is None and row["confidence"] == 0.0 and len(row) == 29


def test_duplicates(spark):
    diag = diagnostics.build_records(raw(spark))
    as_of = F.lit("2024-01-03 09:00:00").cast("timestamp")
    states = spark.sql(
        """select * from values (10L, 'open'), (11L, 'merged'), (12L, 'closed'), (13L, 'unknown'),
        (14L, null) as t(pr_number, pr_state)"""
    )
    errors = raw(spark).select("error_message").unionAll(spark.sql("select ' new '"))
    found = {
        r["error_message"].strip(): (r["is_duplicate"], r["reason"])
        for r in diagnostics.duplicate_decision(errors, diag, as_of, states).collect()
    }
    assert found == {
        "open one": (True, "previous_pr_open"), "merged one": (True, "previous_pr_merged"),
        "closed one": (False, "previous_pr_closed_without_merge"),
        "odd one": (True, "previous_pr_status_unknown"),
        "no lookup": (True, "pr_status_check_failed"),
        "no number": (True, "previous_success_without_pr_number"),
        "too old": (False, "no_previous_success"), "failed one": (False, "no_previous_success"),
        "new": (False, "no_previous_success"),
    }
    unchecked = diagnostics.duplicate_decision(errors, diag, as_of).collect()
    reasons = {r["error_message"]: r["reason"] for r in unchecked}
    assert reasons["closed one"] == "previous_success_no_git_check"


def test_feedback(spark):
    diag = diagnostics.build_records(raw(spark))
    feedback = spark.sql(
        """select pr as pr_number, status as pr_status, cast(at as timestamp) as resolved_at from
        values (10L, 'closed', '2024-01-02 11:00:00'), (10L, 'merged', '2024-01-02 12:00:00'),
        (11L, 'closed', '2024-01-02 10:30:00'), (12L, 'open', '2024-01-02 10:30:00'),
        (0L, 'merged', '2024-01-02 10:30:00') as t(pr, status, at)"""
    )
    updated = diagnostics.apply_feedback(diag, feedback)
    rows = {r["id"]: (r["pr_status"], r["resolution_time_hours"], r["feedback"]) for r in updated.collect()}
    assert len(rows) == 8 and rows["c"] == rows["h"] == (None, None, None)
    assert rows["a"] == ("merged", 2.0, "fix_accepted") and rows["b"] == ("closed", 0.5, "fix_rejected")
    reasons = [r["reason"] for r in diagnostics.rejected_feedback(feedback).collect()]
    assert sorted(reasons) == ["pr_number must be positive", "pr_status must be merged or closed"]


def test_outcome_status(spark):
    df = spark.sql(
        """select * from values (0, 1.0D, true, false, 'no_fix_proposed'),
        (1, 0.4D, false, true, 'low_confidence'), (1, 0.5D, false, true, 'validation_failed'),
        (1, 0.9D, true, true, 'dry_run'), (1, 0.9D, true, false, 'success'),
        (null, 0.9D, true, false, 'no_fix_proposed') as t(f, c, v, d, want)"""
    )
    status = diagnostics.outcome_status(F.col("f"), F.col("c"), 0.5, F.col("v"), F.col("d"))
    assert df.filter(status != F.col("want")).count() == 0


def test_alerts_on_nothing(spark):
    none = diagnostics.build_records(raw(spark).limit(0))
    as_of = F.lit("2024-01-03").cast("timestamp")
    assert tuple(diagnostics.cost_alert(none, as_of).first()) == (0.0, False)
    assert tuple(diagnostics.failure_alert(none, as_of).first()) == (0.0, False)
    assert diagnostics.repeated_error_alert(none, as_of).count() == 0


RUNS = """
select 1L as job_id, 'j' as job_name, 7L as run_id, 1704067200000L as start_time,
    'FAILED' as result_state, 65000L as run_duration, array(
    named_struct('task_key', 'pre', 'result_state', 'SUCCESS', 'error', cast(null as string)),
    named_struct('task_key', 'bronze_ingestion', 'result_state', 'failed', 'error', 'boom a@x.com'),
    named_struct('task_key', 'gold', 'result_state', 'UPSTREAM_FAILED', 'error', 'u')) as tasks
union all select 1L, 'j', 8L, 1704067100000L, 'SUCCESS_WITH_FAILURES', 1L, array(
    named_struct('task_key', 'a', 'result_state', 'UPSTREAM_FAILED', 'error', ''),
    named_struct('task_key', 'b', 'result_state', 'UPSTREAM_FAILED', 'error', cast(null as string)))
union all select 2L, 'k', 9L, 1704067200000L, 'SUCCESS', 1L, array(
    named_struct('task_key', 'a', 'result_state', cast(null as string), 'error', ''))
"""


def test_failures(spark):
    found = {
        r["run_id"]: (r["failed_tasks"], r["errors"])
        for r in runs.failure_records(spark.sql(RUNS)).collect()
    }
    assert found == {
        7: (["bronze_ingestion"], {"bronze_ingestion": "boom <REDACTED:EMAIL>"}),
        8: (["a", "b"], {"a": "Unknown error", "b": "Unknown error"}),
        9: ([], {}),
    }
    as_of = F.lit("2024-01-01 00:30:00").cast("timestamp")
    recent = runs.recent_failures(spark.sql(RUNS), as_of, hours=1)
    assert sorted(r["run_id"] for r in recent.collect()) == [7, 8]
    assert runs.recent_failures(spark.sql(RUNS), as_of, hours=1, newest=1).count() == 1
    late = F.lit("2024-01-03").cast("timestamp")
    assert runs.recent_failures(spark.sql(RUNS), late, hours=1).count() == 0


def test_pipeline_summary(spark):
    jobs = spark.sql("select explode(array(1L, 2L, 3L)) as job_id")
    rows = {r["job_id"]: r for r in runs.pipeline_summary(spark.sql(RUNS), jobs).collect()}
    assert rows[1]["status"] == "FAILED" and rows[1]["duration_sec"] == 65.0
    assert rows[1]["last_run_at"] == "2023-12-31 21:00:00 (horario de Brasilia)"
    assert rows[1]["tasks"]["gold"] == "UPSTREAM_FAILED" and rows[2]["tasks"] == {"a": "UNKNOWN"}
    assert (rows[3]["status"], rows[3]["last_run_at"], rows[3]["duration_sec"], rows[3]["tasks"]) == (
        "NO_RUNS", None, 0.0, {},
    )


def test_platform(spark):
    deps = spark.sql(
        """select * from values (1, 'success', 2000L), (1, 'success', null), (1, 'pending', 9L),
        (2, 'failed', 1L) as t(company_id, status, duration_ms)"""
    )
    rows = {r["company_id"]: tuple(r)[1:] for r in platform_metrics.deployment_breakdown(deps).collect()}
    assert rows == {1: (3, 2, 0, 0, 0, 2.0), 2: (1, 0, 1, 0, 0, None)}
    channels = spark.sql(
        """select * from values (1, 'w', 'connected'), (1, 'w', 'x'), (1, 't', 'connected')
        as t(company_id, channel, state)"""
    )
    row = platform_metrics.channel_metrics(channels).first()
    assert (row["total"], row["by_channel"], row["connected"]) == (3, {"w": 2, "t": 1}, 2)
    logs = spark.sql("select 'Observer x' as message, 'success' as level union all select 'a', 'b'")
    branches = spark.sql("select explode(array('fix/agent-auto-1', 'fix/agent-auto-2', 'x')) as branch")
    assert tuple(platform_metrics.diagnosis_metrics(logs, branches).first()) == (2, 2, 0.25)


def test_status_must_be_known(spark):
    with pytest.raises(Exception):
        diagnostics.build_records(raw(spark).drop("status")).filter("no_such = 1")


def test_feedback_into_the_stored_log(spark, tmp_path):
    """Late, repeated and contradicting feedback: the latest of a pull request counts, and partitions
    without one of its records keep their files."""
    import os
    from datetime import datetime as dt

    rows = [
        {"id": f"d{i}", "timestamp": dt(2024, 1, 1), "pr_number": i % 20, "status": "success"} for i in range(100)
    ]
    schema = ", ".join(x.strip() for x in diagnostics.DIAGNOSTICS_DDL.split(","))
    full = spark.createDataFrame([], schema).schema
    records = spark.createDataFrame([tuple(r.get(f.name) for f in full.fields) for r in rows], full)
    log = diagnostics.stored_log(str(tmp_path / "log"), parts=16)
    diagnostics.store_records(records, log)

    def files():
        return {
            os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns
            for a, _, names in os.walk(log.path) for f in names if f.startswith("part-")
        }

    def feed(*rows):
        df = spark.createDataFrame(list(rows), "pr_number long, pr_status string, resolved_at timestamp")
        return diagnostics.store_feedback(df, log).first()

    before = files()
    assert feed((7, "merged", dt(2024, 1, 2, 10)))["changed"] == 5
    after = files()
    assert 0 < sum(before.get(f) == t for f, t in after.items()) < len(after)
    assert feed((7, "merged", dt(2024, 1, 2, 10)))["changed"] == 0
    assert feed((7, "closed", dt(2024, 1, 2, 9)), (0, "merged", dt(2024, 1, 3)), (8, "open", dt(2024, 1, 3)))["changed"] == 0
    assert files() == after
    assert feed((7, "closed", dt(2024, 1, 2, 11)))["changed"] == 5
    stored = diagnostics.incremental.current(spark, log)
    got = {(r["pr_number"], r["feedback"], r["resolution_time_hours"]) for r in stored.collect() if r["feedback"]}
    assert got == {(7, "fix_rejected", 35.0)} and stored.count() == 100
