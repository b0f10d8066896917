"""Aggregates over the platform's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.intent import classify_intent, estimate_tokens
from parlance.operators.conversations import count_where

COST_PER_DIAGNOSIS_USD = 0.25
LOG_MARK = "Observer"
FIX_BRANCH_PREFIX = "fix/agent-auto-"


def deployment_breakdown(deployments: DataFrame) -> DataFrame:
    """Deployments per company: total, by status, average seconds of the successful ones."""
    status = F.col("status")
    return deployments.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[
            count_where(status == name).alias(name)
            for name in ("success", "failed", "running", "cancelled")
        ],
        (F.avg(F.when(status == "success", F.col("duration_ms"))) / 1000).alias(
            "avg_duration_seconds"
        ),
    )


def pipeline_metrics(pipelines: DataFrame) -> DataFrame:
    """Pipelines per company, and how many have a job."""
    return pipelines.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("databricks_job_id").alias("with_databricks_job"),
    )


def channel_metrics(channels: DataFrame) -> DataFrame:
    """Channel instances per company: total, connected, and a map from channel to number.

    Counted per channel first, so the map of a company holds one entry per channel. Instances
    without a channel stand under "unknown".
    """
    channel = F.coalesce("channel", F.lit("unknown")).alias("channel")
    per_channel = channels.groupBy("company_id", channel).agg(
        F.count(F.lit(1)).alias("instances"),
        count_where(F.col("state") == "connected").alias("connected"),
    )
    entries = F.sort_array(F.collect_list(F.struct("channel", "instances")))
    return per_channel.groupBy("company_id").agg(
        F.sum("instances").alias("total"),
        F.map_from_entries(entries).alias("by_channel"),
        F.sum("connected").alias("connected"),
    )


def diagnosis_metrics(
    logs: DataFrame,
    branches: DataFrame,
    log_mark: str = LOG_MARK,
    branch_prefix: str = FIX_BRANCH_PREFIX,
) -> DataFrame:
    """Diagnoses from the deployment log (messages with ``log_mark``), fix branches, the larger of
    both, and estimated cost."""
    logged = logs.select(
        F.coalesce(
            F.col("message").contains(log_mark) & (F.col("level") == "success"), F.lit(False)
        ).alias("is_log"),
        F.lit(False).alias("is_fix"),
    )
    fixes = branches.select(
        F.lit(False).alias("is_log"),
        F.coalesce(F.col("branch").startswith(branch_prefix), F.lit(False)).alias("is_fix"),
    )
    counts = logged.unionAll(fixes).agg(
        count_where(F.col("is_log")).alias("diagnoses_logged"),
        count_where(F.col("is_fix")).alias("prs_created"),
    )
    return counts.select(
        F.greatest("diagnoses_logged", "prs_created").alias("total_diagnostics"),
        "prs_created",
        F.round(F.col("diagnoses_logged") * COST_PER_DIAGNOSIS_USD, 2).alias(
            "estimated_cost_usd"
        ),
    )


def intent_volume(messages: DataFrame) -> DataFrame:
    """Messages and estimated tokens per day, channel and intent."""
    return messages.groupBy(
        F.to_date("timestamp").alias("day"),
        "channel",
        classify_intent(F.col("message_body")).alias("intent"),
    ).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.coalesce(estimate_tokens(F.col("message_body")), F.lit(0))).alias("tokens"),
    )
