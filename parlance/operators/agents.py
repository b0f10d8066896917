"""Agent performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.operators.conversations import count_where, rate
from parlance.operators.ranking import percent_ranks


def agent_metrics(conversations: DataFrame) -> DataFrame:
    """Counts, averages and rates per agent."""
    outcome = F.col("outcome")
    per_agent = conversations.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total_conversations"),
        count_where(outcome == fv.SOLD).alias("wins"),
        count_where(outcome == fv.GHOSTED).alias("ghosting_count"),
        count_where(outcome.isin(*fv.LOST)).alias("lost_count"),
        F.avg("total_messages").alias("avg_messages_per_conv"),
        F.avg("duration_minutes").alias("avg_duration_min"),
        F.avg("avg_response_time_sec").alias("avg_response_time"),
        F.avg("inbound_count").alias("avg_lead_engagement"),
    )
    whole = F.col("total_conversations")
    return per_agent.withColumns(
        {
            "win_rate": rate(F.col("wins"), whole),
            "ghosting_rate": rate(F.col("ghosting_count"), whole),
            "loss_rate": rate(F.col("lost_count"), whole),
        }
    )


def agent_performance(conversations: DataFrame) -> DataFrame:
    """Agent metrics with percentiles among all agents.

    Response time ranks from slow to fast (no response time: 100); ghosting ranks ascending, so a
    high percentile means much ghosting.
    """
    return percent_ranks(
        agent_metrics(conversations),
        key="agent_id",
        ranks={
            "win_rate_percentile": ("win_rate", False),
            "response_time_percentile": ("avg_response_time", True),
            "ghosting_rate_percentile": ("ghosting_rate", False),
        },
    )
