"""What a lead disclosed: entity mentions, signals for scoring, and the masked profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import extract as ex
from parlance.functions import mask as mk
from parlance.operators.messages import has_inbound_text, inbound_text, message_order, with_lower

EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "cpfs": ex.extract_cpf,
    "emails": ex.extract_email,
    "phones": ex.extract_phone,
    "plates": ex.extract_plate,
    "ceps": ex.extract_cep,
    "competitors": ex.extract_competitor,
    "prices": lambda body: ex.extract_price(body).cast("array<string>"),
}


def extract_entities(messages: DataFrame) -> DataFrame:
    """Each inbound message with arrays of the entities in its text."""
    body = F.col("message_body")
    found = {f"{kind}_found": extract(body) for kind, extract in EXTRACTORS.items()}
    found["prices_found"] = ex.extract_price(body)
    return inbound_text(messages).withColumns(found)


def entity_sets(messages: DataFrame) -> DataFrame:
    """Distinct non-empty entity arrays: conversation_id, kind, found.

    The array is part of the grouping key, so the rows of one conversation spread over tasks.
    """
    body = F.col("message_body")
    arrays = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), extract(body).alias("found"))
            for kind, extract in EXTRACTORS.items()
        ]
    )
    return (
        inbound_text(messages)
        .select("conversation_id", F.inline(F.filter(arrays, lambda s: F.size(s["found"]) > 0)))
        .distinct()
    )


def entity_mentions(messages: DataFrame, kind: str, distinct: bool = False) -> DataFrame:
    """One row per mention: conversation_id and value.

    An entity counts once per distinct array it stands in; ``distinct`` counts it once per
    conversation. Same rows as exploding the profile, without building an array per conversation.
    """
    extract = EXTRACTORS[kind]
    sets = (
        inbound_text(messages)
        .select("conversation_id", extract(F.col("message_body")).alias("found"))
        .filter(F.size("found") > 0)
        .distinct()
    )
    mentions = sets.select("conversation_id", F.explode("found").alias("value"))
    return mentions.distinct() if distinct else mentions


SIGNAL_COLUMNS = (
    "conversation_id", "has_cpf", "has_email", "has_plate", "has_competitor", "first_price",
    "lead_name", "lead_phone",
)


def signal_aggregates() -> list[Column]:
    """Kinds of data in the inbound messages, lowest price, and the first of them as a struct;
    over messages ``with_lower``."""
    body, counts = F.col("message_body"), has_inbound_text()

    def given(found: Column) -> Column:
        return F.max(F.when(counts, F.size(found) > 0))

    return [
        given(ex.extract_cpf(body)).alias("has_cpf"),
        given(ex.extract_email(body)).alias("has_email"),
        given(ex.extract_plate(body)).alias("has_plate"),
        given(ex.competitors_in(F.col("_lower"))).alias("has_competitor"),
        F.min(F.when(counts, F.array_min(ex.extract_price(body)))).alias("first_price"),
        F.min_by(
            F.struct("sender_name_normalized", "sender_phone"), F.when(counts, message_order())
        ).alias("_first_inbound"),
    ]


def signal_columns() -> dict[str, Column]:
    return {
        "lead_name": F.col("_first_inbound.sender_name_normalized"),
        "lead_phone": F.col("_first_inbound.sender_phone"),
    }


def lead_signals(
    messages: DataFrame, strict: bool = False, key: mk.HashKey | None = None
) -> DataFrame:
    """Per conversation: which kinds of data the lead gave, lowest price, name and phone.

    Scalars only, aggregated before the shuffle. ``strict`` replaces the phone by its keyed hash.
    """
    signals = (
        with_lower(inbound_text(messages))
        .groupBy("conversation_id")
        .agg(*signal_aggregates())
        .withColumns(signal_columns())
        .select(*SIGNAL_COLUMNS)
    )
    if not strict:
        return signals
    if key is None:
        raise ValueError("strict signals need a hash key")
    hashed = key.attach(signals).withColumn("lead_phone", mk.hash_digits(F.col("lead_phone")))
    return key.detach(hashed)


def signals_from_profile(leads: DataFrame) -> DataFrame:
    """The same signals from a stored profile table."""
    return leads.groupBy("conversation_id").agg(
        F.max(F.size("cpf_masked") > 0).alias("has_cpf"),
        F.max(F.size("email_masked") > 0).alias("has_email"),
        F.max(F.size("plate_masked") > 0).alias("has_plate"),
        F.max(F.size("competitors_mentioned") > 0).alias("has_competitor"),
        F.min(F.array_min("prices_mentioned")).alias("first_price"),
        F.min("lead_name").alias("lead_name"),
        F.min("lead_phone").alias("lead_phone"),
    )


def leads_profile(
    messages: DataFrame, key: mk.HashKey, distinct: bool = False, strict: bool = False
) -> DataFrame:
    """Masked entities per conversation with the name and phone of its first message.

    Entities repeat if they stand in different arrays of one conversation, unless ``distinct``.
    ``strict`` also masks the phone and post codes. One row per conversation at every size: a
    row holds the distinct arrays of its conversation, which ``entity_sets`` has as rows.
    """
    # the first message of a conversation is one more kind, so that one pass has both
    nobody = F.array().cast("array<string>")
    person = F.struct(message_order().alias("order"), "sender_name_normalized", "sender_phone")
    kinds = [
        F.struct(F.lit(kind).alias("kind"), F.col(f"_{kind}").alias("found"), F.when(F.lit(False), person).alias("person"))
        for kind in EXTRACTORS
    ]
    kinds.append(F.struct(F.lit("person").alias("kind"), nobody.alias("found"), person.alias("person")))
    kept = F.filter(F.array(*kinds), lambda s: (F.size(s["found"]) > 0) | (s["kind"] == "person"))
    # the patterns run in a projection of their own, which is compiled; inside ``filter`` they are not
    found = with_lower(inbound_text(messages)).select(
        "conversation_id", "timestamp", "message_id", "sender_name_normalized", "sender_phone",
        *[extract(F.col("message_body")).alias(f"_{kind}") for kind, extract in EXTRACTORS.items() if kind != "competitors"],
        ex.competitors_in(F.col("_lower")).alias("_competitors"),
    )
    sets = (
        found.select("conversation_id", F.inline(kept))
        .groupBy("conversation_id", "kind", "found").agg(F.min("person").alias("person"))
    )

    def merged(kind: str) -> Column:
        values = F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("found"))))
        values = F.array_distinct(values) if distinct else values
        return F.array_sort(values)

    profile = (
        sets.groupBy("conversation_id")
        .agg(*[merged(kind).alias(kind) for kind in EXTRACTORS], F.min("person").alias("first"))
        .withColumns(
            {
                "lead_name": F.col("first.sender_name_normalized"),
                "lead_phone": F.col("first.sender_phone"),
            }
        )
    )
    shown = key.attach(profile).select(
        "conversation_id",
        (mk.mask_array(F.col("ceps"), lambda c: F.regexp_replace(c, r"\d{3}$", "***"))
         if strict else F.col("ceps")).alias("ceps"),
        F.col("competitors").alias("competitors_mentioned"),
        F.array_sort(F.col("prices").cast("array<double>")).alias("prices_mentioned"),
        "lead_name",
        (mk.mask_phone(F.col("lead_phone")) if strict else F.col("lead_phone")).alias(
            "lead_phone"
        ),
        mk.mask_array(F.col("cpfs"), mk.mask_cpf).alias("cpf_masked"),
        mk.mask_array(F.col("cpfs"), mk.hash_digits).alias("cpf_hash"),
        mk.mask_array(F.col("emails"), mk.mask_email).alias("email_masked"),
        mk.mask_array(F.col("phones"), mk.mask_phone).alias("phone_masked"),
        mk.mask_array(F.col("plates"), mk.mask_plate).alias("plate_masked"),
    )
    return key.detach(shown)


def redact_messages(messages: DataFrame) -> DataFrame:
    """Every message body, inbound and outbound, with personal data masked."""
    return messages.withColumn("message_body", mk.redact_body(F.col("message_body")))
