"""All that is known per conversation, from one pass over the messages.

The conversation table, the keyword sentiment and the lead signals group by the same key. Taken
together they need one aggregation, and the scores built on them need no join. Aggregates that a
result does not use are not computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators import conversations, leads, sentiment
from parlance.operators.messages import with_lower


def conversation_facts(messages: DataFrame) -> DataFrame:
    """One row per conversation with the columns of all three tables."""
    return (
        with_lower(messages).groupBy("conversation_id")
        .agg(
            *conversations.conversation_aggregates(),
            *sentiment.keyword_aggregates(),
            *leads.signal_aggregates(),
        )
        .withColumns(
            {
                **conversations.conversation_columns(),
                **sentiment.keyword_columns(),
                **leads.signal_columns(),
            }
        )
        .drop("_first_message")
    )


def conversations_of(facts: DataFrame) -> DataFrame:
    return facts.select(*conversations.CONVERSATION_COLUMNS)


def sentiment_of(facts: DataFrame) -> DataFrame:
    """Conversations with inbound text, blank or not."""
    return (
        facts.filter(F.col("inbound_messages") > 0)
        .withColumn("outcome", F.col("_inbound_outcome"))
        .select(*sentiment.SENTIMENT_COLUMNS)
    )


def signals_of(facts: DataFrame) -> DataFrame:
    """Conversations with inbound text that is not blank."""
    return facts.filter(F.col("_first_inbound").isNotNull()).select(*leads.SIGNAL_COLUMNS)
