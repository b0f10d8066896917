"""Silence of the lead, and what brought them back.

Time is cut into slices as long as the gap looked for. Two messages of one slice are never
further apart than the limit, so every gap lies between the last message of a slice and the
first of the next one: first and last message per slice are enough, and these aggregate before
the shuffle, however many messages one conversation has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.operators.conversations import minutes_between
from parlance.operators.ranking import null_safe


def time_slice(time: Column, minutes: int) -> Column:
    return F.floor(F.unix_timestamp(time) / (minutes * 60))


def slice_marks(messages: DataFrame, minutes: int) -> DataFrame:
    """Per conversation and slice: first and last inbound, last outbound message."""
    inbound, outbound = F.col("direction") == "inbound", F.col("direction") == "outbound"
    return (
        messages.filter(F.col("timestamp").isNotNull())
        .groupBy("conversation_id", time_slice(F.col("timestamp"), minutes).alias("slice"))
        .agg(
            F.min(
                F.when(
                    inbound,
                    F.struct("timestamp", "message_id", "message_body", "conversation_outcome"),
                )
            ).alias("first_in"),
            F.max(F.when(inbound, F.col("timestamp"))).alias("last_in"),
            F.max(F.when(outbound, F.struct("timestamp", "message_id", "message_body"))).alias(
                "last_out"
            ),
        )
    )


def marked_gaps(messages: DataFrame, minutes: int) -> DataFrame:
    earlier = (
        Window.partitionBy("conversation_id")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    marks = slice_marks(messages, minutes).withColumns(
        {
            "prev_timestamp": F.last("last_in", ignorenulls=True).over(earlier),
            "out_before": F.last("last_out", ignorenulls=True).over(earlier),
        }
    )
    gap = minutes_between(F.col("prev_timestamp"), F.col("first_in.timestamp"))
    return marks.withColumn("gap_minutes", gap).filter(F.col("gap_minutes") > minutes)


def silence_gaps(messages: DataFrame, minutes: int = 120) -> DataFrame:
    """Inbound messages that came more than ``minutes`` after the one before."""
    return marked_gaps(messages, minutes).select(
        "conversation_id",
        "first_in.timestamp",
        "first_in.message_id",
        "first_in.message_body",
        "first_in.conversation_outcome",
        "prev_timestamp",
        "gap_minutes",
    )


def reactivation_messages(messages: DataFrame, minutes: int = 120) -> DataFrame:
    """Last outbound message strictly inside each gap; gaps without one are left out."""
    gaps = marked_gaps(messages, minutes)
    ends = gaps.select(
        "conversation_id", "slice", F.col("first_in.timestamp").alias("gap_end")
    )
    # outbound messages of the slice the gap ends in, sent before its end
    inside = (
        messages.filter((F.col("direction") == "outbound") & F.col("timestamp").isNotNull())
        .groupBy(
            "conversation_id",
            time_slice(F.col("timestamp"), minutes).alias("slice"),
            "timestamp",
        )
        .agg(F.max(F.struct("message_id", "message_body")).alias("sent"))
        .alias("o")
        .join(ends.alias("e"), null_safe("o", "e", ["conversation_id", "slice"]))
        .filter(F.col("o.timestamp") < F.col("gap_end"))
        .groupBy("o.conversation_id", "o.slice")
        .agg(
            F.max(F.struct("timestamp", "sent.message_id", "sent.message_body")).alias("out_inside")
        )
    )
    last_out = F.coalesce("out_inside", "out_before")
    return (
        gaps.alias("g")
        .join(inside.alias("i"), null_safe("g", "i", ["conversation_id", "slice"]), "left")
        .withColumn("_out", last_out)
        .filter(F.col("_out.timestamp") > F.col("prev_timestamp"))
        .select(
            "g.conversation_id",
            "first_in.timestamp",
            "prev_timestamp",
            "gap_minutes",
            F.col("_out.timestamp").alias("out_timestamp"),
            F.col("_out.message_id").alias("out_message_id"),
            F.col("_out.message_body").alias("reactivation_message"),
        )
    )


def churn_summary(gaps: DataFrame) -> DataFrame:
    """Gaps, longest and average silence, and whether the deal was taken up again."""
    return (
        gaps.groupBy("conversation_id")
        .agg(
            F.count(F.lit(1)).alias("churn_events"),
            F.max("gap_minutes").alias("max_silence_minutes"),
            F.avg("gap_minutes").alias("avg_silence_minutes"),
            F.min_by("conversation_outcome", F.struct("timestamp", "message_id")).alias(
                "outcome"
            ),
        )
        .withColumn("was_reengaged", F.col("outcome").isin(fv.SOLD, *fv.OPEN_DEAL))
    )
