"""Repeated contacts of one lead and first-contact resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.operators.conversations import count_where, rate
from parlance.operators.ranking import null_safe, number_rows, up_to


def contact_sequence(signals: DataFrame, conversations: DataFrame) -> DataFrame:
    """Numbered contacts from stored signals and conversations."""
    return numbered_contacts(
        signals.select("conversation_id", "lead_phone").join(
            conversations.select("conversation_id", "outcome", "first_message_at"),
            "conversation_id",
        )
    )


def numbered_contacts(facts: DataFrame) -> DataFrame:
    """Conversations of each phone, numbered by time, with their number.

    Numbered in ranges of equal size, so that one phone (or the missing one) may hold any share of
    the rows, and all of them in one hour.
    """
    numbered = number_rows(
        facts.select("conversation_id", "lead_phone", "outcome", "first_message_at"),
        keys=["lead_phone"],
        order=["first_message_at", "conversation_id"],
        position="contact_number",
        total="total_contacts",
    )
    won_at_once = (F.col("contact_number") == 1) & (F.col("outcome") == fv.SOLD)
    return numbered.withColumn("is_first_contact_win", won_at_once)


def contact_order() -> Column:
    """Contacts by time, those without one last, then by conversation."""
    return F.struct(
        F.col("first_message_at").isNull().alias("untimed"), "first_message_at", "conversation_id"
    )


def resolution_kinds(facts: DataFrame) -> DataFrame:
    """Conversations, wins and kind of resolution per phone, in one aggregation.

    ``first_win`` is the place of the first win in the order of the contacts.
    """
    won = F.col("outcome") == fv.SOLD
    per_phone = facts.groupBy("lead_phone").agg(
        F.count(F.lit(1)).alias("total_conversations"),
        count_where(won).alias("total_wins"),
        F.min(F.when(won, contact_order())).alias("first_win"),
    )
    kind = (
        F.when(F.col("total_wins") == 0, "no_resolution")
        .when(F.col("total_conversations") == 1, "first_contact_resolution")
        .otherwise("multi_contact_resolution")
    )
    return per_phone.withColumn("resolution_type", kind)


def first_contact_resolution(facts: DataFrame) -> DataFrame:
    """Conversations, wins and kind of resolution per phone, from its conversations.

    ``first_win_contact`` is the lowest contact number (always 1); ``first_win_contact_number``
    that of the first win: the contacts up to it, counted without numbering all of them.
    """
    rows = facts.select("lead_phone", "outcome", "first_message_at", "conversation_id")
    kinds = resolution_kinds(rows)
    wins = kinds.filter(F.col("first_win").isNotNull()).select("lead_phone", "first_win")
    places = up_to(
        rows, wins, ["lead_phone"], contact_order(), "first_win", "first_win_contact_number"
    )
    return (
        kinds.alias("n")
        .join(places.alias("s"), null_safe("n", "s", ["lead_phone"]), "left")
        .select(
            "n.lead_phone", "total_conversations", "total_wins",
            F.lit(1).cast("bigint").alias("first_win_contact"),
            "first_win_contact_number", "resolution_type",
        )
    )


def fcr_summary(resolution: DataFrame) -> DataFrame:
    """Leads, average contacts and share per kind of resolution; ``resolution_kinds`` is enough."""
    per_kind = resolution.groupBy("resolution_type").agg(
        F.count(F.lit(1)).alias("leads"), F.avg("total_conversations").alias("avg_contacts")
    )
    # three rows at most
    whole = F.sum("leads").over(Window.partitionBy())
    return per_kind.withColumn("pct_of_total", rate(F.col("leads"), whole))
