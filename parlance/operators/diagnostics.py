"""Log of failure diagnoses: records, feedback, duplicates, and the dashboard over it.

Everything that depends on the clock takes an ``as_of`` timestamp column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.functions.regex import unicode
from parlance.operators.conversations import count_where
from parlance.sources import incremental
from parlance.sources.incremental import KeyedTable

DIAGNOSTICS_DDL = """
    id string, timestamp timestamp, job_id bigint, job_name string, run_id bigint,
    failed_task string, error_message string, error_hash string, diagnosis string,
    root_cause string, fix_description string, file_to_fix string, confidence double,
    requires_human_review boolean, pr_url string, pr_number bigint, branch_name string,
    provider string, model string, input_tokens bigint, output_tokens bigint,
    estimated_cost_usd double, duration_seconds double, status string, pr_status string,
    pr_resolved_at timestamp, resolution_time_hours double, feedback string, pr_kind string
"""
SUCCESS = "success"


def cost_usd(
    provider: Column,
    model: Column,
    input_tokens: Column,
    output_tokens: Column,
    prices: Sequence[tuple[str, str, float, float]] = fv.TOKEN_PRICES,
) -> Column:
    """Estimated cost by the first price row of the provider whose model prefix fits, else 0.

    The price list is an argument of the driver, so a chain of conditions replaces a join.
    """
    vendor = F.lower(F.trim(F.coalesce(provider, F.lit(""))))
    name = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    used_in, used_out = F.coalesce(input_tokens, F.lit(0)), F.coalesce(output_tokens, F.lit(0))
    costs = [
        F.when(
            (vendor == F.lit(p)) & name.startswith(prefix),
            (used_in * F.lit(price_in) + used_out * F.lit(price_out)) / 1_000_000,
        )
        for p, prefix, price_in, price_out in prices
    ]
    return F.round(F.coalesce(*costs, F.lit(0.0)), 6)


def error_hash(message: Column) -> Column:
    """SHA-256 of the message without surrounding blanks; NULL hashes as the empty text."""
    bare = F.regexp_replace(F.coalesce(message, F.lit("")), unicode(r"^\s+|\s+$"), "")
    return F.sha2(bare, 256)


def build_records(raw: DataFrame) -> DataFrame:
    """Raw diagnoses -> log rows: defaults filled in, cost and hash computed.

    ``raw`` needs id, timestamp, job_id, run_id, failed_task, error_message, status and
    duration_seconds; any other column of the log may be absent.
    """
    have = set(raw.columns)
    defaults = {"string": "", "bigint": 0, "double": 0.0, "boolean": False}
    unset = {"id", "timestamp", "pr_status", "pr_resolved_at", "resolution_time_hours", "feedback"}

    def filled(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return value if name in unset else F.coalesce(value, F.lit(defaults[kind]))

    fields = [part.split() for part in DIAGNOSTICS_DDL.split(",")]
    columns = {name: filled(name, kind) for name, kind in fields}
    columns["error_hash"] = error_hash(columns["error_message"])
    columns["duration_seconds"] = F.round(columns["duration_seconds"], 3)
    columns["estimated_cost_usd"] = cost_usd(
        columns["provider"], columns["model"], columns["input_tokens"], columns["output_tokens"]
    )
    return raw.select(*[value.alias(name) for name, value in columns.items()])


def outcome_status(
    fixes: Column,
    confidence: Column,
    threshold: float,
    valid: Column,
    dry_run: Column,
    duplicate: Column | None = None,
    answered: Column | None = None,
    attempt: Column | None = None,
    report: Column | None = None,
) -> Column:
    """Status of a diagnosis: the first obstacle, or ``success``.

    ``duplicate`` is true for an error already dealt with and ``answered`` false where the model
    failed. ``attempt`` is the result of the pull request: created, unchanged (it would change
    nothing, so a report is tried instead) or failed; ``report`` that of the report: created,
    unsupported or failed. Arguments left out stand for no obstacle.
    """
    no = F.lit(False)
    duplicate, answered = no if duplicate is None else duplicate, ~no if answered is None else answered
    attempt = F.lit("created") if attempt is None else attempt
    report = F.lit("created") if report is None else report
    unchanged = attempt == "unchanged"
    return (
        F.when(duplicate, "duplicate_skip")
        .when(~answered, "llm_failed")
        .when(F.coalesce(fixes, F.lit(0)) == 0, "no_fix_proposed")
        .when(confidence < threshold, "low_confidence")
        .when(~valid, "validation_failed")
        .when(dry_run, "dry_run")
        .when(unchanged & (report == "created"), "report_pr_created")
        .when(unchanged & (report == "unsupported"), "report_skipped")
        .when(unchanged, "report_failed")
        .when(attempt == "failed", "pr_failed")
        .otherwise(SUCCESS)
    )


def apply_feedback(diagnostics: DataFrame, feedback: DataFrame) -> DataFrame:
    """Log with the results of pull requests written in.

    ``feedback`` has pr_number, pr_status and resolved_at; the latest row of a number counts, and
    rows that are neither merged nor closed are left out. Log rows without a pull request, which
    all share the number 0, stay out of the join.
    """
    valid = feedback.filter((F.col("pr_number") > 0) & F.col("pr_status").isin("merged", "closed"))
    latest = valid.groupBy("pr_number").agg(
        F.max(F.struct("resolved_at", "pr_status")).alias("_new")
    )
    with_pr = diagnostics.filter(F.col("pr_number") > 0)
    without = diagnostics.filter(~(F.coalesce("pr_number", F.lit(0)) > 0))
    new = F.col("_new")
    known = new.isNotNull()
    hours = (F.unix_timestamp(new["resolved_at"]) - F.unix_timestamp("timestamp")) / 3600
    opinion = F.when(new["pr_status"] == "merged", "fix_accepted").otherwise("fix_rejected")
    updated = (
        with_pr.join(latest, "pr_number", "left")
        .withColumns(
            {
                "pr_status": F.when(known, new["pr_status"]).otherwise(F.col("pr_status")),
                "pr_resolved_at": F.when(known, new["resolved_at"]).otherwise(
                    F.col("pr_resolved_at")
                ),
                "resolution_time_hours": F.when(known, hours).otherwise(
                    F.col("resolution_time_hours")
                ),
                "feedback": F.when(known, opinion).otherwise(F.col("feedback")),
            }
        )
        .select(*diagnostics.columns)
    )
    return updated.unionByName(without)


def stored_log(root: str, parts: int = 64) -> KeyedTable:
    """The log as a table by record; ``changed_at`` orders the versions of a record."""
    return KeyedTable(root, "diagnostics", ("id",), "changed_at", parts=parts)


def store_records(records: DataFrame, log: KeyedTable) -> DataFrame:
    """Adds records to the stored log; a record that is there in a newer version stays as it is."""
    return incremental.merge(records.withColumn("changed_at", F.col("timestamp")), log)


def store_feedback(feedback: DataFrame, log: KeyedTable) -> DataFrame:
    """Writes the results of pull requests into the stored log and returns what changed. Only records
    that the feedback is about are written anew, and only partitions that hold one. Feedback that is
    older than what a record has is ignored, so it may come late, twice or in any order."""
    spark = feedback.sparkSession
    records = incremental.current(spark, log)
    valid = feedback.filter((F.col("pr_number") > 0) & F.col("pr_status").isin("merged", "closed"))
    about = records.join(valid.select("pr_number").distinct(), "pr_number", "left_semi")
    updated = apply_feedback(about.withColumn("_had", F.col("pr_resolved_at")), feedback)
    updated = updated.where(F.col("_had").isNull() | (F.col("pr_resolved_at") > F.col("_had"))).drop("_had")
    changed_at = F.greatest("changed_at", "pr_resolved_at")
    return incremental.merge(updated.withColumn("changed_at", changed_at), log)


def rejected_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback rows that cannot be used, with the reason."""
    reason = F.when(
        F.coalesce("pr_number", F.lit(0)) <= 0, "pr_number must be positive"
    ).when(
        ~F.coalesce(F.col("pr_status").isin("merged", "closed"), F.lit(False)),
        "pr_status must be merged or closed",
    )
    return feedback.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def within(since: Column, as_of: Column) -> Column:
    """True for times after ``since`` and up to ``as_of``: what came later is not known yet."""
    return (F.col("timestamp") > since) & (F.col("timestamp") <= as_of)


def from_on(since: Column, as_of: Column) -> Column:
    """The same with ``since`` itself included."""
    return (F.col("timestamp") >= since) & (F.col("timestamp") <= as_of)


def successes_since(diagnostics: DataFrame, as_of: Column, hours: int) -> DataFrame:
    recent = within(as_of - F.make_interval(hours=F.lit(hours)), as_of)
    return diagnostics.filter((F.col("status") == SUCCESS) & recent)


def recent_successes(
    diagnostics: DataFrame, as_of: Column, hours: int = 24, newest: int | None = None
) -> DataFrame:
    """Successful diagnoses of the last hours; with ``newest``, only so many of each error."""
    recent = successes_since(diagnostics, as_of, hours).select(
        "id", "timestamp", "job_id", "job_name", "run_id", "failed_task", "error_hash",
        "pr_url", "pr_number", "branch_name", "confidence", "status",
    )
    if newest is None:
        return recent
    latest_first = Window.partitionBy("error_hash").orderBy(
        F.col("timestamp").desc(), F.col("id").desc()
    )
    return (
        recent.withColumn("_place", F.row_number().over(latest_first))
        .filter(F.col("_place") <= newest)
        .drop("_place")
    )


def duplicate_decision(
    errors: DataFrame,
    diagnostics: DataFrame,
    as_of: Column,
    pull_requests: DataFrame | None = None,
    hours: int = 24,
) -> DataFrame:
    """Errors with ``is_duplicate`` and ``reason``, from the latest success and its pull request.

    ``errors`` has error_message; ``pull_requests`` has pr_number and pr_state, where a NULL state
    or an absent number means the lookup failed. All is decided per error hash, so the errors
    themselves are joined once, to one row per hash.
    """
    latest = (
        successes_since(diagnostics, as_of, hours)
        .groupBy("error_hash")
        .agg(F.max_by(F.coalesce("pr_number", F.lit(0)), F.struct("timestamp", "id")).alias("pr"))
    )
    if pull_requests is None:
        reason = F.lit("previous_success_no_git_check")
        decided = latest.select("error_hash", reason.alias("_reason"))
    else:
        states = pull_requests.groupBy(F.col("pr_number").alias("_number")).agg(
            F.max("pr_state").alias("state")
        )
        state = F.col("state")
        reason = (
            F.when(F.col("pr") == 0, "previous_success_without_pr_number")
            .when(state.isNull(), "pr_status_check_failed")
            .when(state.isin("open", "merged"), F.concat(F.lit("previous_pr_"), state))
            .when(state == "closed", "previous_pr_closed_without_merge")
            .otherwise(F.concat(F.lit("previous_pr_status_"), state))
        )
        decided = latest.join(states, F.col("pr") == F.col("_number"), "left").select(
            "error_hash", reason.alias("_reason")
        )
    reason = F.coalesce("_reason", F.lit("no_previous_success"))
    new = ("no_previous_success", "previous_pr_closed_without_merge")
    return (
        errors.withColumn("error_hash", error_hash(F.col("error_message")))
        .join(decided, "error_hash", "left")
        .withColumns({"is_duplicate": ~reason.isin(*new), "reason": reason})
        .drop("_reason")
    )


def days_back(as_of: Column, days: int) -> Column:
    return from_on(F.date_sub(F.to_date(as_of), days).cast("timestamp"), as_of)


def hours_back(as_of: Column, hours: int) -> Column:
    return from_on(as_of - F.make_interval(hours=F.lit(hours)), as_of)


def share_of_all(count: str) -> Column:
    """Percentage of a count in the sum over the (few) grouped rows."""
    return F.round(F.col(count) * 100.0 / F.sum(count).over(Window.partitionBy()), 2)


def diagnoses_per_day(diag: DataFrame, as_of: Column) -> DataFrame:
    """Panel 1: diagnoses per day and status, last 30 days."""
    return (
        diag.filter(days_back(as_of, 30))
        .groupBy(F.to_date("timestamp").alias("dia"), "status")
        .agg(F.count(F.lit(1)).alias("diagnosticos"))
        .orderBy(F.col("dia").desc(), "status")
    )


def cost_per_model(diag: DataFrame, as_of: Column) -> DataFrame:
    """Panel 2: calls, tokens and cost per provider and model, last 30 days."""
    return (
        diag.filter(days_back(as_of, 30) & (F.col("provider") != ""))
        .groupBy("provider", "model")
        .agg(
            F.count(F.lit(1)).alias("chamadas"),
            F.sum("input_tokens").alias("total_input_tokens"),
            F.sum("output_tokens").alias("total_output_tokens"),
            F.round(F.sum("estimated_cost_usd"), 4).alias("custo_total_usd"),
        )
        .orderBy(F.col("custo_total_usd").desc(), "provider", "model")
    )


def cumulative_cost(diag: DataFrame, as_of: Column) -> DataFrame:
    """Panel 3: cost per day and running total, last 60 days (a window over at most 61 rows)."""
    daily = (
        diag.filter(days_back(as_of, 60))
        .groupBy(F.to_date("timestamp").alias("dia"))
        .agg(F.sum("estimated_cost_usd").alias("_cost"))
    )
    running = F.sum("_cost").over(Window.orderBy("dia"))
    return daily.select(
        "dia",
        F.round("_cost", 4).alias("custo_dia_usd"),
        F.round(running, 4).alias("custo_acumulado_usd"),
    ).orderBy("dia")


def confidence_per_task(diag: DataFrame) -> DataFrame:
    """Panel 4: confidence per failed task."""
    return (
        diag.filter(F.col("confidence") > 0)
        .groupBy("failed_task")
        .agg(
            F.count(F.lit(1)).alias("total_diagnosticos"),
            F.round(F.avg("confidence"), 3).alias("confianca_media"),
            F.round(F.min("confidence"), 3).alias("confianca_minima"),
            F.round(F.max("confidence"), 3).alias("confianca_maxima"),
        )
        .orderBy(F.col("total_diagnosticos").desc(), "failed_task")
    )


def frequent_errors(diag: DataFrame, top: int = 10) -> DataFrame:
    """Panel 5: most frequent errors by hash, with the whole first message, distinct runs, and
    first and last time."""
    return (
        diag.filter(F.col("error_hash").isNotNull())
        .groupBy("error_hash")
        .agg(
            F.min_by("error_message", F.struct("timestamp", "id")).alias("erro_resumo"),
            F.count(F.lit(1)).alias("ocorrencias"),
            F.countDistinct("run_id").alias("runs_distintos"),
            F.min("timestamp").alias("primeira_ocorrencia"),
            F.max("timestamp").alias("ultima_ocorrencia"),
        )
        .orderBy(F.col("ocorrencias").desc(), "error_hash")
        .limit(top)
    )


def status_shares(diag: DataFrame) -> DataFrame:
    """Panel 6: diagnoses and share per status."""
    return (
        diag.groupBy("status")
        .agg(F.count(F.lit(1)).alias("total"))
        .withColumn("percentual", share_of_all("total"))
        .orderBy(F.col("total").desc(), "status")
    )


def latency_per_model(diag: DataFrame) -> DataFrame:
    """Panel 7: average and longest diagnosis per provider and model."""
    return (
        diag.filter(F.col("duration_seconds") > 0)
        .groupBy("provider", "model")
        .agg(
            F.round(F.avg("duration_seconds"), 2).alias("tempo_medio_s"),
            F.round(F.max("duration_seconds"), 2).alias("tempo_max_s"),
            F.count(F.lit(1)).alias("execucoes"),
        )
        .orderBy("tempo_medio_s", "provider", "model")
    )


def latest_pull_requests(diag: DataFrame, top: int = 20) -> DataFrame:
    """Panel 8: newest pull requests."""
    return (
        diag.filter(F.col("pr_url") != "")
        .orderBy(F.col("timestamp").desc(), F.col("id").desc())
        .limit(top)
        .select(
            "timestamp", "job_name", "failed_task",
            F.round("confidence", 2).alias("confianca"),
            "pr_number", "pr_url", "pr_status",
            F.concat("provider", F.lit("/"), "model").alias("llm"),
        )
    )


def acceptance_shares(diag: DataFrame) -> DataFrame:
    """Panel 9: created pull requests per state and feedback."""
    return (
        diag.filter(F.col("status") == SUCCESS)
        .groupBy(F.coalesce("pr_status", F.lit("pending")).alias("pr_status"), "feedback")
        .agg(F.count(F.lit(1)).alias("total"))
        .withColumn("percentual", share_of_all("total"))
        .orderBy(F.col("total").desc(), "pr_status", "feedback")
    )


def resolution_hours(diag: DataFrame) -> DataFrame:
    """Panel 10: hours until a pull request was merged or closed."""
    hours = "resolution_time_hours"
    return (
        diag.filter(F.col("pr_status").isin("merged", "closed") & F.col(hours).isNotNull())
        .groupBy("pr_status")
        .agg(
            F.count(F.lit(1)).alias("prs_resolvidos"),
            F.round(F.avg(hours), 2).alias("tempo_medio_h"),
            F.round(F.min(hours), 2).alias("tempo_min_h"),
            F.round(F.max(hours), 2).alias("tempo_max_h"),
        )
    )


def acceptance_per_model(diag: DataFrame) -> DataFrame:
    """Panel 11: accepted and rejected pull requests per provider and model."""
    return (
        diag.filter((F.col("status") == SUCCESS) & (F.col("pr_number") > 0))
        .groupBy("provider", "model")
        .agg(
            F.count(F.lit(1)).alias("prs_criados"),
            count_where(F.col("feedback") == "fix_accepted").alias("aceitos"),
            count_where(F.col("feedback") == "fix_rejected").alias("rejeitados"),
        )
        .withColumn(
            "taxa_aceitacao_pct",
            F.round(F.try_divide(F.col("aceitos") * 100.0, F.col("prs_criados")), 2),
        )
        .orderBy(F.col("taxa_aceitacao_pct").desc_nulls_last(), "provider", "model")
    )


def cost_alert(diag: DataFrame, as_of: Column, limit_usd: float = 5.0) -> DataFrame:
    """Alert 1: cost of the last 24 hours."""
    total = F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 4)
    return (
        diag.filter(hours_back(as_of, 24))
        .agg(total.alias("custo_24h"))
        .withColumn("alerta", F.col("custo_24h") > limit_usd)
    )


def failure_alert(diag: DataFrame, as_of: Column, limit_pct: float = 10.0) -> DataFrame:
    """Alert 2: share of failed model calls in the last 24 hours."""
    failed = count_where(F.col("status") == "llm_failed")
    share = F.round(F.try_divide(failed * 100.0, F.count(F.lit(1))), 2)
    return (
        diag.filter(hours_back(as_of, 24))
        .agg(F.coalesce(share, F.lit(0.0)).alias("taxa_falha_pct"))
        .withColumn("alerta", F.col("taxa_falha_pct") > limit_pct)
    )


def repeated_error_alert(
    diag: DataFrame, as_of: Column, hours: int = 6, more_than: int = 3
) -> DataFrame:
    """Alert 3: errors that came back more than three times in six hours."""
    return (
        diag.filter(hours_back(as_of, hours))
        .groupBy("error_hash")
        .agg(F.count(F.lit(1)).alias("repeticoes"))
        .filter(F.col("repeticoes") > more_than)
        .orderBy(F.col("repeticoes").desc(), "error_hash")
    )
