"""Conversation level: one row per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.messages import message_order


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 60


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def rate(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, NULL for an empty whole."""
    return F.round(F.try_divide(part, whole) * 100, 2)


FIRST_MESSAGE = {
    "outcome": "conversation_outcome",
    "campaign_id": "campaign_id",
    "agent_id": "agent_id",
    "city": "meta_city",
    "state": "meta_state",
    "device": "meta_device",
    "lead_source": "meta_lead_source",
}


def conversation_aggregates() -> list[Column]:
    """Counts, times and averages, and the first message as a struct ``_first_message``."""
    return [
        F.count(F.lit(1)).alias("total_messages"),
        count_where(F.col("direction") == "inbound").alias("inbound_count"),
        count_where(F.col("direction") == "outbound").alias("outbound_count"),
        F.min("timestamp").alias("first_message_at"),
        F.max("timestamp").alias("last_message_at"),
        F.avg("meta_response_time_sec").alias("avg_response_time_sec"),
        count_where(F.col("meta_is_business_hours")).alias("business_hours_messages"),
        F.array_sort(F.collect_set("message_type")).alias("message_types_used"),
        F.min_by(
            F.struct(*[F.col(source).alias(name) for name, source in FIRST_MESSAGE.items()]),
            message_order(),
        ).alias("_first_message"),
    ]


def conversation_columns() -> dict[str, Column]:
    """Columns of the conversation table that are worked out after the aggregation."""
    first = {name: F.col("_first_message")[name] for name in FIRST_MESSAGE}
    duration = minutes_between(F.col("first_message_at"), F.col("last_message_at"))
    return {**first, "duration_minutes": duration}


CONVERSATION_COLUMNS = (
    "conversation_id", "total_messages", "inbound_count", "outbound_count", "first_message_at",
    "last_message_at", "avg_response_time_sec", "business_hours_messages", "message_types_used",
    *FIRST_MESSAGE, "duration_minutes",
)


def enrich_conversations(messages: DataFrame) -> DataFrame:
    """Counts, times, averages and the attributes of the first message, in one aggregation."""
    aggregated = messages.groupBy("conversation_id").agg(*conversation_aggregates())
    return aggregated.withColumns(conversation_columns()).select(*CONVERSATION_COLUMNS)
