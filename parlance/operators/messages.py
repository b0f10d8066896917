"""Message level: dedup, cleaning, parsing, filters.

Order inside a conversation is always (timestamp, message_id), so that equal times do not leave
a result to chance. Messages without a readable time are neither first nor last while there is
one with a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEDUP_KEYS = ("conversation_id", "timestamp", "direction", "sender_phone", "message_body")
METADATA_SCHEMA = (
    "device string, city string, state string, response_time_sec string, "
    "is_business_hours string, lead_source string"
)


def message_order() -> Column:
    """For ``min_by``: the first message, those without a time behind all others."""
    return F.struct(F.col("timestamp").isNull().alias("untimed"), "timestamp", "message_id")


def last_order() -> Column:
    """For ``max_by``: the last message, those without a time before all others."""
    return F.struct("timestamp", "message_id")


def dedup_messages(bronze: DataFrame) -> DataFrame:
    """One row per message: of its deliveries the one furthest on (read, delivered, other).

    Ties go to the lowest message_id. The filter on the row number keeps one row per message and
    task before the shuffle, however many copies there are; columns nobody reads stay in the file.
    """
    furthest = F.when(F.col("status") == "read", 3).when(F.col("status") == "delivered", 2)
    deliveries = Window.partitionBy(*DEDUP_KEYS).orderBy(
        furthest.otherwise(1).desc(), "message_id"
    )
    return (
        bronze.withColumn("_place", F.row_number().over(deliveries))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def removed_rows(bronze: DataFrame) -> DataFrame:
    """Rows in, rows out and rows removed by the dedup, without building the result."""
    per_key = bronze.groupBy(*DEDUP_KEYS).agg(F.count(F.lit(1)).alias("copies"))
    totals = per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_input"),
        F.count(F.lit(1)).alias("rows_output"),
    )
    return totals.withColumn("rows_removed", F.col("rows_input") - F.col("rows_output"))


def normalise_names(messages: DataFrame) -> DataFrame:
    """Tidied sender name; blank ones become the agent id or a name made from the conversation."""
    name = F.trim(F.regexp_replace("sender_name", r"\s+", " "))
    stand_in = F.when(F.col("direction") == "outbound", F.col("agent_id")).otherwise(
        F.concat(F.lit("Lead_"), F.substring("conversation_id", -8, 8))
    )
    blank = F.col("sender_name").isNull() | (F.trim("sender_name") == "")
    return messages.withColumn(
        "sender_name_normalized", F.when(blank, stand_in).otherwise(F.initcap(name))
    )


def parse_metadata(messages: DataFrame) -> DataFrame:
    """Typed columns from the metadata JSON, parsed once; values that do not fit become NULL."""
    parsed = messages.withColumn("_meta", F.from_json("metadata", METADATA_SCHEMA))
    meta = F.col("_meta")
    return parsed.withColumns(
        {
            "meta_device": meta["device"],
            "meta_city": meta["city"],
            "meta_state": meta["state"],
            "meta_response_time_sec": meta["response_time_sec"].try_cast("int"),
            "meta_is_business_hours": meta["is_business_hours"].try_cast("boolean"),
            "meta_lead_source": meta["lead_source"],
        }
    ).drop("_meta")


def type_timestamp(messages: DataFrame) -> DataFrame:
    """Message time as a timestamp; text in any ISO form is read, other text becomes NULL."""
    return messages.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))


def clean_messages(bronze: DataFrame) -> DataFrame:
    """Raw messages -> the clean message table."""
    return type_timestamp(parse_metadata(normalise_names(dedup_messages(bronze))))


def has_inbound_text(allow_blank: bool = False) -> Column:
    """True for messages of the lead that have text."""
    inbound = (F.col("direction") == "inbound") & F.col("message_body").isNotNull()
    return inbound if allow_blank else inbound & (F.col("message_body") != "")


def inbound_text(messages: DataFrame, allow_blank: bool = False) -> DataFrame:
    """Messages of the lead that have text."""
    return messages.filter(has_inbound_text(allow_blank))


def with_lower(messages: DataFrame) -> DataFrame:
    """Adds ``_lower``, the text of the lead in lower case: worked out once, however many words are
    looked for in it."""
    text = F.when(F.col("direction") == "inbound", F.col("message_body"))
    return messages.withColumn("_lower", F.lower(text))
