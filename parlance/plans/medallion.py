"""Bronze -> Silver -> Gold: the order in which the tables build on each other."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from parlance.functions.mask import HashKey
from parlance.operators import agents, campaigns, contacts, facts, funnel, leads, quality
from parlance.operators import messages as msg
from parlance.operators import negotiation, scoring, silence
from parlance.sources.tables import read_parquet, write_parquet


@dataclass(frozen=True)
class Silver:
    """Silver tables. ``messages`` holds clear text; ``public_messages`` is what is published."""

    messages: DataFrame
    facts: DataFrame

    @property
    def conversations(self) -> DataFrame:
        return facts.conversations_of(self.facts)

    @property
    def sentiment(self) -> DataFrame:
        return facts.sentiment_of(self.facts)

    @property
    def signals(self) -> DataFrame:
        return facts.signals_of(self.facts)

    @property
    def public_messages(self) -> DataFrame:
        return leads.redact_messages(self.messages)

    def profile(self, key: HashKey) -> DataFrame:
        return leads.leads_profile(self.messages, key)


def build_silver(bronze: DataFrame) -> Silver:
    """Silver tables as lazy plans."""
    clean = msg.clean_messages(bronze)
    return Silver(clean, facts.conversation_facts(clean))


def store_silver(silver: Silver, folder: str) -> Silver:
    """Silver tables written once and read back, so that the Gold tables share the work.

    The facts are computed from the written messages. The folder has clear text in it and must be
    as protected as Bronze.
    """
    spark = silver.messages.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        write_parquet(df, f"{folder}/{name}")
        return read_parquet(spark, f"{folder}/{name}", df.schema)

    clean = stored(silver.messages, "messages")
    return Silver(clean, stored(facts.conversation_facts(clean), "facts"))


@dataclass(frozen=True)
class Published:
    """All published tables as stored, and the numbers of the quality checks."""

    tables: dict[str, DataFrame]
    numbers: DataFrame


def publish(bronze: DataFrame, folder: str, key: HashKey, at_once: int = 4) -> Published:
    """Writes Silver and Gold, each table once, and observes the numbers of the gate in the same
    jobs; those of Bronze in the job that reads it. ``at_once`` tables are written side by side, so
    that small ones do not wait for each other.
    """
    spark = bronze.sparkSession
    raw, seen = quality.observed(bronze, "bronze")
    silver = store_silver(build_silver(raw), f"{folder}/clear")
    plans = {
        "messages": silver.public_messages, "conversations": silver.conversations,
        "leads_profile": silver.profile(key), **build_gold(silver),
    }
    watches = {"bronze": seen}

    def write(name: str) -> DataFrame:
        df, watches[name] = quality.observed(plans[name], name)
        write_parquet(df, f"{folder}/{name}")
        return read_parquet(spark, f"{folder}/{name}", plans[name].schema)

    with ThreadPoolExecutor(at_once) as pool:
        stored = dict(zip(plans, pool.map(inheritable_thread_target(spark)(write), plans)))
    return Published({"bronze": bronze, **stored}, quality.numbers_of(spark, watches))


def build_gold(silver: Silver) -> dict[str, DataFrame]:
    """The Gold tables by name, as lazy plans over the Silver tables."""
    clean, convs = silver.messages, silver.conversations
    scored = scoring.with_score(scoring.scorable(silver.facts))
    classified = scoring.with_persona(scored)
    gaps = silence.silence_gaps(clean)
    complexity = negotiation.negotiation_complexity(clean)
    disclosed = silver.facts.filter("_first_inbound is not null")
    resolution = contacts.first_contact_resolution(disclosed)
    emails = campaigns.masked_emails(leads.entity_mentions(clean, "emails"))
    return {
        "funil_vendas": funnel.funnel(clean, convs),
        "fatal_messages": funnel.fatal_messages(clean),
        "agent_performance": agents.agent_performance(convs),
        "sentiment": silver.sentiment,
        "email_providers": campaigns.email_providers(emails),
        "lead_scoring": scored.select(*scoring.SCORE_COLUMNS),
        "temporal_analysis": campaigns.temporal_heatmap(convs),
        "competitor_intel": campaigns.competitor_intel(
            leads.entity_mentions(clean, "competitors"), silver.facts
        ),
        "campaign_roi": campaigns.campaign_results(scored),
        "campaign_geo": campaigns.campaign_geo(convs),
        "personas": classified.select(*scoring.PERSONA_COLUMNS),
        "persona_summary": scoring.persona_summary(classified),
        "churn_reengagement": silence.churn_summary(gaps),
        "negotiation_complexity": complexity,
        "negotiation_by_outcome": negotiation.negotiation_by_outcome(complexity),
        "first_contact_resolution": resolution,
        "fcr_summary": contacts.fcr_summary(resolution),
    }
