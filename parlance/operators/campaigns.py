"""Campaign results, contact times, e-mail providers and competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.functions.mask import mask_email
from parlance.operators.conversations import count_where, rate


def campaign_roi(conversations: DataFrame, scores: DataFrame) -> DataFrame:
    """Campaign results from stored conversations and scores."""
    return campaign_results(
        conversations.join(
            scores.select("conversation_id", "lead_score", "score_tier"), "conversation_id"
        )
    )


def campaign_results(scored: DataFrame) -> DataFrame:
    """Leads, conversions, lead quality and tiers per campaign, over scored conversations."""
    outcome, tier = F.col("outcome"), F.col("score_tier")
    stats = scored.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("total_leads"),
        count_where(outcome == fv.SOLD).alias("conversions"),
        count_where(outcome == fv.GHOSTED).alias("ghosting_count"),
        F.avg("lead_score").alias("avg_lead_quality"),
        F.avg("total_messages").alias("avg_messages_to_convert"),
        F.avg("duration_minutes").alias("avg_duration_min"),
        F.avg("avg_response_time_sec").alias("avg_response_time"),
        count_where(tier == "hot").alias("hot_leads"),
        count_where(tier == "warm").alias("warm_leads"),
        count_where(tier == "cold").alias("cold_leads"),
    )
    return stats.withColumns(
        {
            "conversion_rate": rate(F.col("conversions"), F.col("total_leads")),
            "ghosting_rate": rate(F.col("ghosting_count"), F.col("total_leads")),
        }
    ).orderBy(F.col("conversion_rate").desc(), "campaign_id")


def campaign_geo(conversations: DataFrame) -> DataFrame:
    """Leads and conversions per campaign and state."""
    return (
        conversations.groupBy("campaign_id", "state")
        .agg(
            F.count(F.lit(1)).alias("leads"),
            count_where(F.col("outcome") == fv.SOLD).alias("conversions"),
        )
        .withColumn("conversion_rate", rate(F.col("conversions"), F.col("leads")))
    )


def temporal_heatmap(conversations: DataFrame) -> DataFrame:
    """Contacts and conversion per hour and weekday (Sunday is 1) of the first message."""
    first = F.col("first_message_at")
    return (
        conversations.groupBy(
            F.hour(first).alias("contact_hour"),
            F.dayofweek(first).alias("contact_dow"),
            F.date_format(first, "EEEE").alias("dow_name"),
        )
        .agg(
            F.count(F.lit(1)).alias("total_contacts"),
            count_where(F.col("outcome") == fv.SOLD).alias("wins"),
            F.avg("avg_response_time_sec").alias("avg_response_time"),
            F.avg("total_messages").alias("avg_messages"),
        )
        .withColumn("conversion_rate", rate(F.col("wins"), F.col("total_contacts")))
        .orderBy("contact_dow", "contact_hour")
    )


def best_hour_per_day(heatmap: DataFrame) -> DataFrame:
    """Hour with the highest conversion per weekday; the earlier one on a tie."""
    best = F.min_by(
        F.struct(*[c for c in heatmap.columns if c != "contact_dow"]),
        F.struct(-F.coalesce("conversion_rate", F.lit(-1.0)), "contact_hour"),
    )
    picked = heatmap.groupBy("contact_dow").agg(best.alias("_best"))
    return picked.select("contact_dow", "_best.*").select(*heatmap.columns)


def provider_category(domain: Column, exact: bool = False) -> Column:
    """Mail provider of a domain by substring, or by whole first label with ``exact``."""
    if exact:
        label = F.substring_index(domain, ".", 1)
        groups = {
            "Gmail": ["gmail"], "Microsoft": ["hotmail", "outlook"], "Yahoo": ["yahoo"],
            "Apple": ["icloud", "me"],
        }
        named = [F.when(label.isin(*labels), name) for name, labels in groups.items()]
        return F.coalesce(*named, F.lit("Outros"))
    return (
        F.when(domain.contains("gmail"), "Gmail")
        .when(domain.contains("hotmail") | domain.contains("outlook"), "Microsoft")
        .when(domain.contains("yahoo"), "Yahoo")
        .when(domain.contains("icloud") | domain.contains("me.com"), "Apple")
        .otherwise("Outros")
    )


def masked_emails(mentions: DataFrame) -> DataFrame:
    """E-mail mentions (conversation_id, value) in masked form."""
    return mentions.select("conversation_id", mask_email(F.col("value")).alias("email_masked"))


def email_providers(emails: DataFrame, exact: bool = False) -> DataFrame:
    """Mentions and share per mail domain; one input row per masked e-mail.

    The total is an aggregate of the grouped rows, joined in as a scalar.
    """
    domain = F.get(F.split("email_masked", "@"), F.lit(1))
    stats = (
        emails.filter(F.col("email_masked").isNotNull())
        .groupBy(domain.alias("provider"))
        .agg(F.count(F.lit(1)).alias("total_leads"))
    )
    total = stats.agg(F.sum("total_leads")).scalar()
    return stats.select(
        "provider",
        provider_category(F.col("provider"), exact).alias("provider_category"),
        "total_leads",
        rate(F.col("total_leads"), total).alias("pct_of_total"),
    ).orderBy(F.col("total_leads").desc(), "provider")


def competitor_intel(mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """Mentions, losses, wins and average lowest price of the conversation per competitor.

    ``facts`` needs conversation_id, outcome and first_price.
    """
    outcome = F.col("outcome")
    named = (
        mentions.groupBy("conversation_id", F.col("value").alias("competitor"))
        .agg(F.count(F.lit(1)).alias("mentions"))
        .join(facts.select("conversation_id", "outcome", "first_price"), "conversation_id")
    )

    def mentions_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("mentions")).otherwise(0))

    priced = F.col("first_price").isNotNull()
    stats = named.groupBy("competitor").agg(
        F.sum("mentions").alias("mention_count"),
        mentions_where(outcome.isin(*fv.LOST)).alias("losses_when_mentioned"),
        mentions_where(outcome == fv.SOLD).alias("wins_despite_mention"),
        F.try_divide(
            F.sum(F.col("first_price") * F.col("mentions")), mentions_where(priced)
        ).alias("avg_competitor_price_mentioned"),
    )
    return stats.withColumns(
        {
            "loss_rate": rate(F.col("losses_when_mentioned"), F.col("mention_count")),
            "win_despite_rate": rate(F.col("wins_despite_mention"), F.col("mention_count")),
        }
    ).orderBy(F.col("mention_count").desc(), "competitor")
