"""Registered queries: name -> function of (spark, folder), and the SQL to compare each with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import extract as ex
from parlance.functions import fixed_values as fv
from parlance.functions import mask as mk
from parlance.functions.intent import classify_intent, estimate_tokens
from parlance.operators import (
    agents, campaigns, contacts, contract, conversations, diagnostics, funnel, leads, messages,
    negotiation, platform_metrics, prediction, quality, runs, scoring, sentiment, silence,
    transform,
)
from parlance.plans.medallion import Published, Silver, build_silver, publish
from parlance.session import work_dir
from parlance.sources import incremental, tables
from parlance.streaming import events as stream
from parlance.streaming import live
from workload import derived as d
from workload.oracle_tables import (
    KEYS, count_if, found, joined, keyed_hash, mask_cpf, mask_email,
    mask_phone, mask_plate, only_digits, percent, prices, replaced, text, with_tables,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The SQL of each query without the tables it is put over.
RAW_ORACLES: dict[str, str] = {}


def settle(df: DataFrame) -> DataFrame:
    """Result in types and digits that compare across engines: doubles with six decimals,
    times without zone, arrays as text."""

    def settled(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # nine digits first: takes out the noise of sums in another order before the half is cut
            value = F.round(F.round(value.cast("double"), 9), 6)
        elif isinstance(field.dataType, T.TimestampType):
            value = value.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array_join(value.cast("array<string>"), "|")
        return value.alias(field.name)

    return df.select(*[settled(field) for field in df.schema.fields])


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; its oracle is SQL over the tables of ``oracle_tables``."""

    def register(run: Query) -> Query:
        def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return settle(run(spark, sf_dir))

        QUERIES[name] = settled
        if oracle is not None:
            ORACLES[name] = with_tables(oracle)
            RAW_ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def silver(spark: SparkSession, sf_dir: str) -> Silver:
    return build_silver(d.bronze(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.clean_messages(d.bronze(spark, sf_dir))


def convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.enrich_conversations(clean(spark, sf_dir))


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared work folder."""
    return f"{work_dir(spark)}/parlance-{uuid.uuid4().hex}"


def as_of() -> Column:
    return F.lit(d.AS_OF).cast("timestamp")


AS_OF = f"timestamp '{d.AS_OF}'"


# Sources, sinks, contract


@query(
    "parquet_scan",
    "select conv_id, turn, role, cast(length(text) as integer) as characters from conversations",
)
def parquet_scan(spark, sf_dir):
    schema = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add(
        "text", "string"
    )
    chats = tables.read_parquet(spark, f"{sf_dir}/conversations.parquet", schema)
    return chats.select("conv_id", "turn", "role", F.length("text").alias("characters"))


@query("file_inventory", "select 'events' as source, count(*) as rows, true as sized from events")
def file_inventory(spark, sf_dir):
    """Rows of every file that a scan reads, next to the listing of the same files."""
    path = f"{sf_dir}/events.parquet"
    counted = tables.rows_per_file(spark.read.parquet(path))
    listed = tables.file_inventory(spark, path).select("file_path", "size_bytes")
    return (
        counted.join(listed, "file_path", "left")
        .groupBy(F.lit("events").alias("source"))
        .agg(F.sum("rows").alias("rows"), F.min(F.coalesce(F.col("size_bytes") > 0, F.lit(False))).alias("sized"))
    )


@query("parquet_sink", "select event_id, event_type, round(value, 6) as value from events")
def parquet_sink(spark, sf_dir):
    path = scratch(spark)
    tables.write_parquet(
        d.events(spark, sf_dir).select("event_id", "event_type", "value"), path, ["event_type"]
    )
    return tables.read_parquet(spark, path).select("event_id", "event_type", "value")


@query(
    "table_append",
    "select event_type, 2 * count(*) as events from events group by event_type",
)
def table_append(spark, sf_dir):
    path, name = scratch(spark), f"appended_{uuid.uuid4().hex}"
    kinds = d.events(spark, sf_dir).select("event_id", "event_type")
    tables.append_table(kinds, name, path)
    tables.append_table(kinds, name, path)
    spark.sql(f"drop table {name}")
    stored = tables.read_parquet(spark, path)
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "table_overwrite_merge",
    "select event_id, user_id, cast(null as varchar) as event_type from events",
)
def table_overwrite_merge(spark, sf_dir):
    path, name = scratch(spark), f"merged_{uuid.uuid4().hex}"
    source = d.events(spark, sf_dir)
    tables.overwrite_table(source.select("event_id", "event_type"), name, path=path)
    tables.overwrite_table(source.select("event_id", "user_id"), name, path=path)
    spark.sql(f"drop table {name}")
    return tables.read_parquet(spark, path).select("event_id", "user_id", "event_type")


@query("table_overwrite_replace", "select event_id, user_id as account_id from events")
def table_overwrite_replace(spark, sf_dir):
    path, name = scratch(spark), f"replaced_{uuid.uuid4().hex}"
    source = d.events(spark, sf_dir).select("event_id", "user_id")
    tables.overwrite_table(source, name, path=path)
    renamed = source.withColumnRenamed("user_id", "account_id")
    tables.overwrite_table(renamed, name, replace_schema=True, path=path)
    spark.sql(f"drop table {name}")
    return tables.read_parquet(spark, path)


@query(
    "table_evolve",
    "select event_id, event_type, cast(null as bigint) as user_id from events union all "
    "select event_id, cast(null as varchar), user_id from events",
)
def table_evolve(spark, sf_dir):
    """A table that gets a column later, read by name."""
    path, name = scratch(spark), f"evolved_{uuid.uuid4().hex}"
    source = d.events(spark, sf_dir)
    tables.evolve_table(source.select("event_id", "event_type"), name, path)
    tables.evolve_table(source.select("user_id", "event_id"), name)
    return tables.read_table(spark, name, ["event_id", "event_type", "user_id"])


@query("row_count", "select count(*) as rows from lineitem")
def row_count(spark, sf_dir):
    return tables.row_count(table(spark, sf_dir, "lineitem"))


@query(
    "union_layouts",
    "select event_id, event_type, cast(null as bigint) as user_id from events union all "
    "select event_id, event_type, user_id from events",
)
def union_layouts(spark, sf_dir):
    source = d.events(spark, sf_dir)
    return tables.union_layouts(
        source.select("event_id", "event_type"), source.select("event_id", "event_type", "user_id")
    )


@query(
    "export_sample",
    "select cast(event_id as varchar) as event_id, event_type from events "
    "order by events.event_id limit 100",
)
def export_sample(spark, sf_dir):
    path = scratch(spark)
    first = d.events(spark, sf_dir).select("event_id", "event_type").orderBy("event_id")
    tables.export_sample(first, 100, "csv", path)
    return spark.read.schema("event_id string, event_type string").option("header", True).csv(path)


@query(
    "conform_schema",
    "select message_id, conversation_id, message_body, cast(null as varchar) as channel, "
    "cast(null as bigint) as retries from bronze",
)
def conform_schema(spark, sf_dir):
    schema = (
        T.StructType().add("message_id", "string").add("conversation_id", "string")
        .add("message_body", "string").add("channel", "string").add("retries", "long")
    )
    return contract.conform(d.bronze(spark, sf_dir).drop("channel"), schema)


@query(
    "conform_schema_cast",
    "select event_id, try_cast(event_type as integer) as event_type, cast(value as integer) "
    "as value from (select event_id, event_type, floor(value) as value from events)",
)
def conform_schema_cast(spark, sf_dir):
    schema = T.StructType().add("event_id", "long").add("event_type", "integer").add("value", "integer")
    return contract.conform(d.events(spark, sf_dir), schema, cast=True)


@query(
    "validate_columns",
    "select false as is_valid, 'channel' as missing, 'extra_note' as extra, count(*) as rows "
    "from bronze",
)
def validate_columns(spark, sf_dir):
    """Verdict on the columns, with the number of rows it holds for."""
    changed = d.bronze(spark, sf_dir).withColumnRenamed("channel", "extra_note")
    rows = tables.row_count(changed).scalar()
    return contract.validate_columns(changed).withColumn("rows", rows)


@query(
    "value_violations",
    f"""select * from (
    select 'conversation_id' as column_name, {count_if("not regexp_matches(conversation_id, '^conv_[0-9a-f]{8}$')")} as violations from raw
    union all select 'direction', {count_if("direction not in ('inbound', 'outbound')")} from raw
    union all select 'message_type', {count_if("message_type not in ('text','audio','image','document','sticker','contact','video','location')")} from raw
    union all select 'status', {count_if("status not in ('sent','delivered','read','failed')")} from raw
    union all select 'channel', {count_if("channel not in ('whatsapp')")} from raw)""".replace(
        "from raw",
        "from (select * replace (case when message_type = 'audio' then 'voice' else message_type "
        "end as message_type, 'x' || conversation_id as conversation_id) from bronze)",
    ),
)
def value_violations(spark, sf_dir):
    changed = d.bronze(spark, sf_dir).withColumns(
        {
            "message_type": F.when(F.col("message_type") == "audio", "voice").otherwise(
                F.col("message_type")
            ),
            "conversation_id": F.concat(F.lit("x"), "conversation_id"),
        }
    )
    return contract.value_violations(changed)


@query(
    "ingest_metadata",
    "select count(*) as rows, 'events.parquet' as source, 'run-1' as run_id from events",
)
def ingest_metadata(spark, sf_dir):
    scanned = tables.read_parquet(spark, f"{sf_dir}/events.parquet")
    loaded = contract.with_ingest_metadata(scanned, "run-1")
    name = F.regexp_extract("_source_file", r"events\.parquet", 0)
    return loaded.groupBy(name.alias("source"), F.col("_run_id").alias("run_id")).agg(
        F.count("_ingestion_timestamp").alias("rows")
    )


# Silver


@query("dedup_messages", "select * exclude (rn) from picked")
def dedup_messages(spark, sf_dir):
    return messages.dedup_messages(d.bronze(spark, sf_dir))


@query(
    "removed_rows",
    f"""select count(*) as rows_input, count(*) filter (where rn = 1) as rows_output,
    count(*) filter (where rn > 1) as rows_removed
    from (select row_number() over (partition by {KEYS} order by message_id) as rn from bronze)""",
)
def removed_rows(spark, sf_dir):
    return messages.removed_rows(d.bronze(spark, sf_dir))


@query("clean_messages", "select * from m")
def clean_messages(spark, sf_dir):
    return clean(spark, sf_dir)


@query("inbound_text", "select message_id, message_body from inb where message_body <> ''")
def inbound_text(spark, sf_dir):
    return messages.inbound_text(clean(spark, sf_dir)).select("message_id", "message_body")


KINDS = ("cpfs", "emails", "phones", "plates", "ceps", "competitors", "prices")


def price_text(array: str) -> str:
    """Prices in cents, to be free of number formats."""
    return joined(f"[cast(round(x * 100, 0) as bigint) for x in {array}]")


def cents(name: str) -> Column:
    return F.transform(name, lambda x: F.round(x * 100).cast("bigint"))


@query(
    "extract_entities",
    "select message_id, "
    + ", ".join(f"{joined(kind)} as {kind}" for kind in KINDS[:-1])
    + f", {price_text('prices')} as prices from ent",
)
def extract_entities(spark, sf_dir):
    found_in = leads.extract_entities(clean(spark, sf_dir))
    kept = [F.col(f"{kind}_found").alias(kind) for kind in KINDS[:-1]]
    return found_in.select("message_id", *kept, cents("prices_found").alias("prices"))


def check_digit(n: str, place: int) -> str:
    total = " + ".join(f"cast(substr({n}, {i}, 1) as integer) * {place + 1 - i}" for i in range(1, place))
    return f"(({total}) * 10 % 11) % 10 = cast(substr({n}, {place}, 1) as integer)"


@query(
    "valid_cpf",
    f"""select value, case when length({only_digits('value')}) <> 11
        or replace({only_digits('value')}, left({only_digits('value')}, 1), '') = '' then false
        else {check_digit(only_digits('value'), 10)} and {check_digit(only_digits('value'), 11)}
        end as is_valid
    from (select distinct conversation_id, cpfs from ent where len(cpfs) > 0),
        unnest(cpfs) as u(value)""",
)
def valid_cpf(spark, sf_dir):
    mentions = leads.entity_mentions(clean(spark, sf_dir), "cpfs")
    return mentions.select("value", ex.valid_cpf(F.col("value")).alias("is_valid"))


def brand_case() -> str:
    whens = " ".join(
        f"when {text(model)} then {text(brand)}"
        for model, brand in fv.MODEL_BRANDS.items()
    )
    return f"case model {whens} end"


MODELS = "|".join(fv.MODEL_BRANDS)


@query(
    "extract_vehicle",
    f"""select message_id, {brand_case()} as brand, model, year from (select message_id,
        nullif(regexp_extract(lower(message_body), {text(MODELS)}), '') as model,
        nullif(regexp_extract(message_body, {text(fv.MODEL_YEAR)}), '') as year
        from m where message_body is not null)""",
)
def extract_vehicle(spark, sf_dir):
    with_text = clean(spark, sf_dir).filter(F.col("message_body").isNotNull())
    return with_text.select("message_id", ex.extract_vehicle(F.col("message_body")).alias("v")).select(
        "message_id", "v.*"
    )


def mention_masks(kind: str, mask: str) -> str:
    return f"""select conversation_id, value, {mask} as masked from
        (select distinct conversation_id, {kind} from ent where len({kind}) > 0),
        unnest({kind}) as u(value)"""


def register_mask(name: str, kind: str, sql: str, mask: Callable[[Column], Column]) -> None:
    @query(name, mention_masks(kind, sql))
    def run(spark, sf_dir):
        mentions = leads.entity_mentions(clean(spark, sf_dir), kind)
        return mentions.withColumn("masked", mask(F.col("value")))


register_mask("mask_cpf", "cpfs", mask_cpf("value"), mk.mask_cpf)
register_mask("mask_email", "emails", mask_email("value"), mk.mask_email)
register_mask("mask_phone", "phones", mask_phone("value"), lambda v: mk.mask_phone(v))
register_mask("mask_plate", "plates", mask_plate("value"), mk.mask_plate)


@query("hash_value", mention_masks("cpfs", keyed_hash("value")))
def hash_value(spark, sf_dir):
    key = mk.HashKey.prepare(spark, d.HASH_SECRET)
    mentions = key.attach(leads.entity_mentions(clean(spark, sf_dir), "cpfs"))
    return key.detach(mentions.withColumn("masked", mk.hash_digits(F.col("value"))))


NO_CPF = r"regexp_replace(message_body, '\b\d{3}\.?\d{3}\.?(\d{3})-?(\d{2})\b', '***.***.\1-\2', 'g')"


@query(
    "redact_body",
    f"""select message_id, {replaced('t3', '(?i)' + fv.PLATE_OLD, mask_plate)} as message_body
    from (select *, {replaced('t2', '(?i)' + fv.PLATE_NEW, mask_plate)} as t3
    from (select *, {replaced('t1', fv.EMAIL, mask_email)} as t2
    from (select message_id, {NO_CPF} as t1 from m)))""",
)
def redact_body(spark, sf_dir):
    return leads.redact_messages(clean(spark, sf_dir)).select("message_id", "message_body")


def redact_sql(value: str) -> str:
    for name, pattern in fv.REDACTION_RULES:
        value = f"regexp_replace({value}, {text(pattern)}, '<REDACTED:{name}>', 'g')"
    return value


@query("redact_rules", f"select message_id, {redact_sql(chr(34) + 'b' + chr(34))} as redacted "
       "from (select message_id, coalesce(message_body, '') as b from m)")
def redact_rules(spark, sf_dir):
    return clean(spark, sf_dir).select(
        "message_id", mk.redact_rules(F.col("message_body")).alias("redacted")
    )


def labels_in(value: str, name: str) -> str:
    label = f"<REDACTED:{name}>"
    return f"(length({value}) - length(replace({value}, '{label}', ''))) // {len(label)}"


@query(
    "redact_rule_counts",
    " union all ".join(
        f"select '{name}' as rule, cast(sum({labels_in('r', name)}) as bigint) as replacements "
        f"from (select {redact_sql('text')} as r from documents)"
        for name, _ in fv.REDACTION_RULES
    ),
)
def redact_rule_counts(spark, sf_dir):
    """Replacements per rule over all documents."""
    return mk.rule_counts(table(spark, sf_dir, "documents"), "text")


@query(
    "redact_secrets",
    r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text,
    'sk-[A-Za-z0-9_-]+', '[REDACTED]', 'g'), 'ghp_[A-Za-z0-9_]+', '[REDACTED]', 'g'),
    'AKIA[0-9A-Z]{12,}', '[REDACTED]', 'g')) as redacted_hash from documents""",
)
def redact_secrets(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.sha2(mk.redact_secrets(F.col("text")), 256).alias("redacted_hash"))


@query(
    "redact_nested",
    f"""select run_id, job_name, 'bronze_ingestion' as first_task, state_2 as second_state,
    {redact_sql('task_error')} as first_error from runs""",
)
def redact_nested(spark, sf_dir):
    redacted = mk.redact_nested(d.job_runs(spark, sf_dir))
    return redacted.select(
        "run_id",
        "job_name",
        F.col("tasks")[0]["task_key"].alias("first_task"),
        F.col("tasks")[1]["result_state"].alias("second_state"),
        F.col("tasks")[0]["error"].alias("first_error"),
    )


@query(
    "redact_error",
    f"select id, {redact_sql('error_message')} as error from raw_diag",
)
def redact_error(spark, sf_dir):
    return d.raw_diagnoses(spark, sf_dir).select(
        "id", mk.redact_error(F.col("error_message")).alias("error")
    )


def merged(kind: str) -> str:
    return f"list_sort(coalesce(flatten(list(distinct {kind}) filter (where len({kind}) > 0)), []))"


def masked_list(kind: str, mask: Callable[[str], str]) -> str:
    return joined(f"[{mask('x')} for x in {merged(kind)}]")


@query(
    "leads_profile",
    f"""select conversation_id, {joined(merged('ceps'))} as ceps,
    {joined(merged('competitors'))} as competitors_mentioned,
    {price_text(merged('prices'))} as prices_mentioned,
    arg_min(sender_name_normalized, row("timestamp", message_id)) as lead_name,
    arg_min(sender_phone, row("timestamp", message_id)) as lead_phone,
    {masked_list('cpfs', mask_cpf)} as cpf_masked,
    {masked_list('cpfs', keyed_hash)} as cpf_hash,
    {masked_list('emails', mask_email)} as email_masked,
    {masked_list('phones', mask_phone)} as phone_masked,
    {masked_list('plates', mask_plate)} as plate_masked
    from ent group by conversation_id""",
)
def leads_profile(spark, sf_dir):
    key = mk.HashKey.prepare(spark, d.HASH_SECRET)
    profile = leads.leads_profile(clean(spark, sf_dir), key)
    return profile.withColumn("prices_mentioned", cents("prices_mentioned"))


@query("lead_signals", "select * replace (round(first_price, 6) as first_price) from leads")
def lead_signals(spark, sf_dir):
    return leads.lead_signals(clean(spark, sf_dir))


@query(
    "conversations_enriched",
    f"""select * replace (round(avg_response_time_sec, 6) as avg_response_time_sec,
    round(duration_minutes, 6) as duration_minutes,
    {joined('message_types_used')} as message_types_used) from c""",
)
def conversations_enriched(spark, sf_dir):
    return convs(spark, sf_dir)


# Gold

DISTRIBUTION = f"""select outcome, count(*) as total_conversations,
    round(avg(total_messages), 6) as avg_messages,
    round(avg(duration_minutes), 6) as avg_duration_min,
    round(avg(avg_response_time_sec), 6) as avg_response_time,
    {percent('count(*)', 'sum(count(*)) over ()')} as pct_of_total from c group by outcome"""
ABANDONMENT = """select outcome, round(avg(last_place), 6) as avg_last_inbound_msg,
    quantile_disc(last_place, 0.5) as median_last_inbound_msg
    from (select conversation_id, max(place) as last_place from numbered
        where direction = 'inbound' group by conversation_id) join c using (conversation_id)
    group by outcome"""


@query("outcome_distribution", DISTRIBUTION)
def outcome_distribution(spark, sf_dir):
    return funnel.outcome_distribution(convs(spark, sf_dir))


@query(
    "last_outbound_of_ghosting",
    """select conversation_id, message_body as fatal_message from (select *,
    row_number() over (partition by conversation_id order by "timestamp" desc, message_id desc)
    as rn from m where conversation_outcome = 'ghosting' and direction = 'outbound') where rn = 1""",
)
def last_outbound_of_ghosting(spark, sf_dir):
    return funnel.last_outbound_of_ghosting(clean(spark, sf_dir))


@query(
    "fatal_messages",
    r"""select array_to_string(string_split_regex(fatal_message, '\s+')[1:10], ' ')
        as msg_truncated, count(*) as frequency
    from (select conversation_id, coalesce(message_body, '') as fatal_message from (select *,
        row_number() over (partition by conversation_id order by "timestamp" desc,
        message_id desc) as rn from m where conversation_outcome = 'ghosting'
        and direction = 'outbound') where rn = 1)
    group by 1 order by 2 desc, 1 limit 50""",
)
def fatal_messages(spark, sf_dir):
    return funnel.fatal_messages(clean(spark, sf_dir))


@query("abandonment_point", ABANDONMENT)
def abandonment_point(spark, sf_dir):
    return funnel.abandonment_point(clean(spark, sf_dir), convs(spark, sf_dir))


@query(
    "funil_vendas",
    f"select * from ({DISTRIBUTION}) left join ({ABANDONMENT}) using (outcome)",
)
def funil_vendas(spark, sf_dir):
    return funnel.funnel(clean(spark, sf_dir), convs(spark, sf_dir))


@query(
    "agent_performance",
    f"""select *, round(percent_rank() over (order by win_rate nulls first) * 100, 0)
        as win_rate_percentile,
    round(percent_rank() over (order by avg_response_time desc nulls last) * 100, 0)
        as response_time_percentile,
    round(percent_rank() over (order by ghosting_rate nulls first) * 100, 0)
        as ghosting_rate_percentile
    from (select agent_id, count(*) as total_conversations,
        {count_if("outcome = 'venda_fechada'")} as wins,
        {count_if("outcome = 'ghosting'")} as ghosting_count,
        {count_if("outcome in ('perdido_preco', 'perdido_concorrente')")} as lost_count,
        round(avg(total_messages), 6) as avg_messages_per_conv,
        round(avg(duration_minutes), 6) as avg_duration_min,
        round(avg(avg_response_time_sec), 6) as avg_response_time,
        round(avg(inbound_count), 6) as avg_lead_engagement,
        {percent('wins', 'total_conversations')} as win_rate,
        {percent('ghosting_count', 'total_conversations')} as ghosting_rate,
        {percent('lost_count', 'total_conversations')} as loss_rate
        from c group by agent_id)""",
)
def agent_performance(spark, sf_dir):
    return agents.agent_performance(convs(spark, sf_dir))


LABEL = (
    "case when sentiment_score > 0.2 then 'positivo' when sentiment_score < -0.2 "
    "then 'negativo' else 'neutro' end"
)


@query(
    "sentiment",
    f"""select conversation_id, p as total_positive, n as total_negative, inbound_messages,
    any_outcome as outcome, sentiment_score, {LABEL} as sentiment_label from s""",
)
def keyword_sentiment(spark, sf_dir):
    return sentiment.keyword_sentiment(clean(spark, sf_dir))


def marker_model():
    """Factory of a stand-in for a trained model: the share of marker words is the probability.

    It is defined inside a function and so pickled by value: workers need no copy of this file.
    """

    def build():
        def odds(body: str) -> dict[str, float]:
            good = sum(word in body for word in ("otimo", "gostei", "obrigado"))
            bad = sum(word in body for word in ("caro", "pensar"))
            whole = good + bad + 1
            return {"POS": good / whole, "NEG": bad / whole, "NEU": 1 / whole}

        return lambda bodies: [odds(body) for body in bodies]

    return build


MARKERS = {
    "good": " + ".join(f"contains(t, '{w}')::int" for w in ("otimo", "gostei", "obrigado")),
    "bad": " + ".join(f"contains(t, '{w}')::int" for w in ("caro", "pensar")),
}


@query(
    "sentiment_ml",
    f"""select *, {LABEL} as sentiment_label, 'marker_words' as model_version from (
    select conversation_id, round(avg(score), 6) as sentiment_score,
        count(*) as inbound_messages, {count_if("label = 'positivo'")} as positive_count,
        {count_if("label = 'negativo'")} as negative_count,
        cast(0 as bigint) as failed_count, arg_min(conversation_outcome, row("timestamp", message_id)) as outcome
    from (select *, case when length(trim(t)) < 3 then 0.0::double
            else round((good - bad) / cast(good + bad + 1 as double), 3) end as score,
            case when length(trim(t)) < 3 then 'neutro' when good >= bad and good >= 1
            then 'positivo' when bad >= 1 then 'negativo' else 'neutro' end as label
        from (select *, {MARKERS['good']} as good, {MARKERS['bad']} as bad
            from (select *, message_body as t from inb where message_body <> '')))
    group by conversation_id)""",
)
def sentiment_ml(spark, sf_dir):
    return sentiment.model_sentiment(clean(spark, sf_dir), marker_model(), "marker_words")


CATEGORY = (
    "case when contains(provider, 'gmail') then 'Gmail' when contains(provider, 'hotmail') "
    "or contains(provider, 'outlook') then 'Microsoft' when contains(provider, 'yahoo') "
    "then 'Yahoo' when contains(provider, 'icloud') or contains(provider, 'me.com') "
    "then 'Apple' else 'Outros' end"
)


@query(
    "email_providers",
    f"""select provider, {CATEGORY} as provider_category, count(*) as total_leads,
    {percent('count(*)', 'sum(count(*)) over ()')} as pct_of_total
    from (select split_part(value, '@', 2) as provider from
        (select distinct conversation_id, emails from ent where len(emails) > 0),
        unnest(emails) as u(value)) group by provider""",
)
def email_providers(spark, sf_dir):
    emails = campaigns.masked_emails(leads.entity_mentions(clean(spark, sf_dir), "emails"))
    return campaigns.email_providers(emails)


@query(
    "lead_scoring",
    """select conversation_id, outcome, lead_score, score_tier, raw_score, inbound_count,
    sentiment_score, round(avg_response_time_sec, 6) as avg_response_time_sec, total_messages,
    campaign_id, agent_id from ls""",
)
def lead_scoring(spark, sf_dir):
    return scoring.with_score(scoring.scorable(silver(spark, sf_dir).facts)).select(
        *scoring.SCORE_COLUMNS
    )


HEATMAP = f"""select *, {percent('wins', 'total_contacts')} as conversion_rate from (
    select cast(hour(first_message_at) as integer) as contact_hour,
        cast(dayofweek(first_message_at) + 1 as integer) as contact_dow,
        dayname(first_message_at) as dow_name, count(*) as total_contacts,
        {count_if("outcome = 'venda_fechada'")} as wins,
        round(avg(avg_response_time_sec), 6) as avg_response_time,
        round(avg(total_messages), 6) as avg_messages from c group by all)"""


@query("temporal_analysis", HEATMAP)
def temporal_analysis(spark, sf_dir):
    return campaigns.temporal_heatmap(convs(spark, sf_dir))


@query(
    "best_hour_per_day",
    f"""select * exclude (rn) from (select *, row_number() over (partition by contact_dow
    order by conversion_rate desc, contact_hour) as rn from ({HEATMAP})) where rn = 1""",
)
def best_hour_per_day(spark, sf_dir):
    return campaigns.best_hour_per_day(
        campaigns.temporal_heatmap(convs(spark, sf_dir))
    )


@query(
    "competitor_intel",
    f"""select *, {percent('losses_when_mentioned', 'mention_count')} as loss_rate,
    {percent('wins_despite_mention', 'mention_count')} as win_despite_rate
    from (select competitor, count(*) as mention_count,
        {count_if("outcome in ('perdido_preco', 'perdido_concorrente')")} as losses_when_mentioned,
        {count_if("outcome = 'venda_fechada'")} as wins_despite_mention,
        round(avg(first_price), 6) as avg_competitor_price_mentioned
        from (select distinct conversation_id, competitors from ent) e,
            unnest(e.competitors) as u(competitor), c, leads l
        where e.conversation_id = c.conversation_id and e.conversation_id = l.conversation_id
        group by competitor)""",
)
def competitor_intel(spark, sf_dir):
    return campaigns.competitor_intel(
        leads.entity_mentions(clean(spark, sf_dir), "competitors"), silver(spark, sf_dir).facts
    )


@query(
    "campaign_roi",
    f"""select *, {percent('conversions', 'total_leads')} as conversion_rate,
    {percent('ghosting_count', 'total_leads')} as ghosting_rate
    from (select campaign_id, count(*) as total_leads,
        {count_if("outcome = 'venda_fechada'")} as conversions,
        {count_if("outcome = 'ghosting'")} as ghosting_count,
        round(avg(lead_score), 6) as avg_lead_quality,
        round(avg(total_messages), 6) as avg_messages_to_convert,
        round(avg(duration_minutes), 6) as avg_duration_min,
        round(avg(avg_response_time_sec), 6) as avg_response_time,
        {count_if("score_tier = 'hot'")} as hot_leads,
        {count_if("score_tier = 'warm'")} as warm_leads,
        {count_if("score_tier = 'cold'")} as cold_leads from ls group by campaign_id)""",
)
def campaign_roi(spark, sf_dir):
    return campaigns.campaign_results(
        scoring.with_score(scoring.scorable(silver(spark, sf_dir).facts))
    )


@query(
    "campaign_geo",
    f"""select *, {percent('conversions', 'leads')} as conversion_rate from (
    select campaign_id, state, count(*) as leads,
        {count_if("outcome = 'venda_fechada'")} as conversions from c group by campaign_id, state)""",
)
def campaign_geo(spark, sf_dir):
    return campaigns.campaign_geo(convs(spark, sf_dir))


def classified(spark, sf_dir):
    return scoring.with_persona(scoring.with_score(scoring.scorable(silver(spark, sf_dir).facts)))


@query(
    "personas",
    """select conversation_id, persona, outcome, lead_score, sentiment_score, total_messages,
    campaign_id, agent_id from pers""",
)
def personas(spark, sf_dir):
    return classified(spark, sf_dir).select(*scoring.PERSONA_COLUMNS)


@query(
    "persona_summary",
    """select persona, count(*) as total, round(avg(lead_score), 6) as avg_lead_score,
    round(avg(sentiment_score), 6) as avg_sentiment,
    round(avg(total_messages), 6) as avg_messages,
    round(avg(avg_response_time_sec), 6) as avg_response_time from pers group by persona""",
)
def persona_summary(spark, sf_dir):
    return scoring.persona_summary(classified(spark, sf_dir))


@query(
    "silence_gaps",
    """select conversation_id, "timestamp", message_id, message_body, conversation_outcome,
    prev_timestamp, round(gap_minutes, 6) as gap_minutes from gaps""",
)
def silence_gaps(spark, sf_dir):
    return silence.silence_gaps(clean(spark, sf_dir))


@query(
    "reactivation_messages",
    """select * exclude (rn) from (select g.conversation_id, g."timestamp", g.prev_timestamp,
    round(g.gap_minutes, 6) as gap_minutes, o."timestamp" as out_timestamp,
    o.message_id as out_message_id, o.message_body as reactivation_message,
    row_number() over (partition by g.conversation_id, g."timestamp"
        order by o."timestamp" desc, o.message_id desc) as rn
    from gaps g join m o on g.conversation_id = o.conversation_id and o.direction = 'outbound'
        and o."timestamp" < g."timestamp" and o."timestamp" > g.prev_timestamp) where rn = 1""",
)
def reactivation_messages(spark, sf_dir):
    return silence.reactivation_messages(clean(spark, sf_dir))


@query(
    "churn_reengagement",
    """select *, outcome in ('venda_fechada', 'em_negociacao', 'proposta_enviada')
        as was_reengaged
    from (select conversation_id, count(*) as churn_events,
        round(max(gap_minutes), 6) as max_silence_minutes,
        round(avg(gap_minutes), 6) as avg_silence_minutes,
        arg_min(conversation_outcome, row("timestamp", message_id)) as outcome
        from gaps group by conversation_id)""",
)
def churn_reengagement(spark, sf_dir):
    return silence.churn_summary(silence.silence_gaps(clean(spark, sf_dir)))


@query(
    "negotiation_complexity",
    """select conversation_id, total_questions, price_questions, coverage_questions,
    total_inbound_messages, any_outcome as outcome, question_rate from neg""",
)
def negotiation_complexity(spark, sf_dir):
    return negotiation.negotiation_complexity(clean(spark, sf_dir))


@query(
    "negotiation_by_outcome",
    """select any_outcome as outcome, round(avg(total_questions), 6) as avg_questions,
    round(avg(price_questions), 6) as avg_price_questions,
    round(avg(coverage_questions), 6) as avg_coverage_questions,
    round(avg(question_rate), 6) as avg_question_rate, count(*) as conversations
    from neg group by any_outcome""",
)
def negotiation_by_outcome(spark, sf_dir):
    return negotiation.negotiation_by_outcome(
        negotiation.negotiation_complexity(clean(spark, sf_dir))
    )


def disclosed(spark, sf_dir) -> DataFrame:
    return silver(spark, sf_dir).facts.filter("_first_inbound is not null")


def sequence(spark, sf_dir):
    return contacts.numbered_contacts(disclosed(spark, sf_dir))


@query(
    "contact_sequence",
    """select *, contact_number = 1 and outcome = 'venda_fechada' as is_first_contact_win
    from contacts""",
)
def contact_sequence(spark, sf_dir):
    return sequence(spark, sf_dir)


@query("first_contact_resolution", "select * from fcr")
def first_contact_resolution(spark, sf_dir):
    return contacts.first_contact_resolution(disclosed(spark, sf_dir))


@query(
    "fcr_summary",
    f"""select resolution_type, count(*) as leads,
    round(avg(total_conversations), 6) as avg_contacts,
    {percent('count(*)', 'sum(count(*)) over ()')} as pct_of_total from fcr
    group by resolution_type""",
)
def fcr_summary(spark, sf_dir):
    return contacts.fcr_summary(contacts.resolution_kinds(disclosed(spark, sf_dir)))


@query(
    "early_features",
    """select e.*, c.outcome, c.lead_source, c.device from (
    select conversation_id, cast(hour(min("timestamp")) as integer) as contact_hour,
        cast(dayofweek(min("timestamp")) + 1 as integer) as contact_dow,
        round(avg(length(message_body)), 6) as avg_msg_length,
        count(*) filter (where direction = 'inbound') as early_inbound_count,
        count(*) filter (where contains(message_body, '?')) as early_questions,
        max(case when place = 1 then meta_response_time_sec end) as first_response_time,
        max(case when place = 1 then cast(meta_is_business_hours as integer) end)
            as is_business_hours
    from numbered where place <= 3 group by conversation_id) e join c using (conversation_id)""",
)
def early_features(spark, sf_dir):
    return prediction.early_features(clean(spark, sf_dir))


def fitted(spark, sf_dir, iterations: int = 100):
    """Model over features that are written once, as the fit reads them many times."""
    path = scratch(spark)
    features = prediction.early_features(clean(spark, sf_dir))
    tables.write_parquet(features, path)
    return prediction.fit_outcome_model(
        tables.read_parquet(spark, path, features.schema), iterations=iterations
    )


TRAINING = "('0x' || substr(md5(conversation_id || ':42'), 1, 8))::bigint % 10000 < 8000"


@query(
    "outcome_prediction",
    f"""select conversation_id, outcome.v as outcome, coalesce({TRAINING}, false) as in_training,
    true as predicted, true as correct_agrees, true as likely
    from (select conversation_id, arg_min(o, ("timestamp" is null, "timestamp", message_id)) as outcome
        from (select *, struct_pack(v := conversation_outcome) as o from m) group by conversation_id)""",
)
def outcome_prediction(spark, sf_dir):
    """Every conversation with its part of the split; a prediction that is one of the outcomes learned,
    at least as likely as each of them would be by chance; and whether ``correct`` says what it should."""
    fit = fitted(spark, sf_dir)
    right = F.col("correct").eqNullSafe((F.col("outcome") == F.col("predicted_outcome")).cast("int"))
    return fit.predictions.select(
        "conversation_id", "outcome", prediction.in_training(42).alias("in_training"),
        F.col("predicted_outcome").isin(fit.labels).alias("predicted"), right.alias("correct_agrees"),
        (F.col("prediction_proba_max") >= 1 / len(fit.labels) - 1e-9).alias("likely"),
    )


@query(
    "model_metrics",
    f"""select 'logistic_regression_v1' as model, fit, train_size, test_size, '{json.dumps(prediction.FEATURES)}' as features,
    true as plausible from (values (1), (2)) as t(fit), (select count(*) filter (where {TRAINING}) as train_size,
        count(*) filter (where not ({TRAINING})) as test_size
        from (select conversation_id, arg_min(o, ("timestamp" is null, "timestamp", message_id)) as outcome
            from (select *, struct_pack(v := conversation_outcome) as o from m) group by conversation_id)
        where outcome.v is not null)""",
)
def model_metrics(spark, sf_dir):
    """Two fits, each appended to the history, and the history read by its name."""
    name = f"fits_{uuid.uuid4().hex}"
    path = scratch(spark)
    for iterations in (5, 20):
        prediction.record_fit(fitted(spark, sf_dir, iterations), name, path)
    fits = prediction.fit_history(spark, name)
    number = F.row_number().over(Window.orderBy("timestamp", "accuracy"))  # a row for each fit
    return fits.select(
        "model", number.alias("fit"), "train_size", "test_size", "features",
        F.col("accuracy").between(0, 1).alias("plausible"),
    )


@query(
    "classification_report",
    """select class, coalesce(round(hits / nullif(predicted, 0)::double, 6), 0.0::double)
        as precision,
    coalesce(round(hits / nullif(support, 0)::double, 6), 0.0::double) as recall,
    coalesce(round(2.0::double * hits / nullif(predicted + support, 0), 6), 0.0::double) as f1,
    support
    from (select class, cast(sum(h) as bigint) as hits, cast(sum(a) as bigint) as support,
        cast(sum(p) as bigint) as predicted
        from (select quality as class, (quality = toxic)::int as h, 1 as a, 0 as p from labels
            union all select toxic, 0, 0, 1 from labels) group by class)""",
)
def classification_report(spark, sf_dir):
    """Toxicity taken as a prediction of quality, over all labels."""
    pairs = table(spark, sf_dir, "labels").select(
        F.col("quality").alias("outcome"), F.col("toxic").alias("predicted_outcome")
    )
    return prediction.classification_report(pairs)


# Column transforms: every operation over the raw messages

META = "json_extract_string(metadata, '$.{}')"
TRANSFORMS: dict[str, tuple[list[dict], str]] = {
    "drop_column": (
        [{"op": "drop_column", "column": "metadata"}],
        "select * exclude (metadata) from bronze",
    ),
    "rename_column": (
        [{"op": "rename_column", "column": "message_id", "new_name": "message_identity"}],
        "select * rename (message_id as message_identity) from bronze",
    ),
    "cast_column": (
        [
            {"op": "json_extract", "column": "metadata", "json_path": "$.response_time_sec",
             "new_name": "seconds"},
            {"op": "cast_column", "column": "seconds", "data_type": "int"},
            {"op": "drop_column", "column": "metadata"},
        ],
        f"select * exclude (metadata), try_cast({META.format('response_time_sec')} as integer) "
        "as seconds from bronze",
    ),
    "trim": (
        [{"op": "trim", "column": "sender_name"}],
        "select * replace (trim(sender_name) as sender_name) from bronze",
    ),
    "regex_replace": (
        [{"op": "regex_replace", "column": "message_body", "pattern": "[0-9]+",
          "replacement": "#"}],
        "select * replace (regexp_replace(message_body, '[0-9]+', '#', 'g') as message_body) "
        "from bronze",
    ),
    "coalesce": (
        [{"op": "coalesce", "column": "sender_name",
          "source_columns": ["sender_name", "agent_id"]}],
        "select * replace (coalesce(sender_name, agent_id) as sender_name) from bronze",
    ),
    "derive_column": (
        [{"op": "derive_column", "column": "body_size", "expression": "length(message_body)"}],
        "select *, cast(length(message_body) as integer) as body_size from bronze",
    ),
    "filter_rows": (
        [{"op": "filter_rows", "expression": "direction = 'inbound' and status <> 'failed'"}],
        "select * from bronze where direction = 'inbound' and status <> 'failed'",
    ),
    "date_format": (
        [
            {"op": "cast_column", "column": "timestamp", "data_type": "timestamp"},
            {"op": "date_format", "column": "timestamp", "format": "dd/MM/yyyy HH:mm"},
        ],
        "select * replace (strftime(cast(\"timestamp\" as timestamp), '%d/%m/%Y %H:%M') "
        "as \"timestamp\") from bronze",
    ),
    "json_extract": (
        [{"op": "json_extract", "column": "metadata", "json_path": "$.city",
          "new_name": "city"}],
        f"select *, {META.format('city')} as city from bronze",
    ),
    "mask_pii": (
        [{"op": "mask_pii", "column": "sender_phone"}],
        "select * replace ('[REDACTED]' as sender_phone) from bronze",
    ),
}


def register_transform(name: str, ops: list[dict], oracle: str) -> None:
    @query(f"transform_{name}", oracle)
    def run(spark, sf_dir):
        return transform.apply_ops(d.bronze(spark, sf_dir), ops)


for _name, (_ops, _oracle) in TRANSFORMS.items():
    register_transform(_name, _ops, _oracle)

EDIT = [
    {"op": "rename_column", "column": "event_id", "new_name": "id"},
    {"op": "cast_column", "column": "props", "data_type": "int"},
    {"op": "drop_column", "column": "ts"},
    {"op": "derive_column", "column": "double_id", "expression": "id * 2"},
]


@query(
    "preview_before",
    "select event_id, event_type from (select * from events order by event_id limit 50)",
)
def preview_before(spark, sf_dir):
    ordered = d.events(spark, sf_dir).orderBy("event_id")
    return transform.preview(ordered, EDIT, 50).before.select("event_id", "event_type")


@query(
    "preview_after",
    """select event_id as id, user_id, event_type, round(value, 6) as value,
    try_cast(props as integer) as props, event_id * 2 as double_id
    from (select * from events order by event_id limit 50)""",
)
def preview_after(spark, sf_dir):
    ordered = d.events(spark, sf_dir).orderBy("event_id")
    return transform.preview(ordered, EDIT, 50).after


CASTS = [
    {"op": "cast_column", "column": "event_type", "data_type": "int"},
    {"op": "cast_column", "column": "props", "data_type": "date"},
    {"op": "cast_column", "column": "user_id", "data_type": "string"},
]


@query(
    "preview_warnings",
    """select 0 as place, 'event_type' as "column", 'int' as data_type, count(event_type) as converted,
        count(event_type) - count(try_cast(event_type as integer)) as lost,
        'cast of event_type to int gives NULL for values that do not fit' as warning from events
    union all select 1, 'props', 'date', count(props), count(props) - count(try_cast(props as date)),
        'cast of props to date gives NULL for values that do not fit' from events""",
)
def preview_warnings(spark, sf_dir):
    return transform.cast_losses(d.events(spark, sf_dir), CASTS)


@query(
    "preview_schema",
    """select 'id' as name, 'bigint' as type, 'renamed' as state, 'event_id' as "from", count(event_id) as filled from events
    union all select 'user_id', 'bigint', 'kept', 'user_id', count(user_id) from events
    union all select 'event_type', 'string', 'kept', 'event_type', count(event_type) from events
    union all select 'value', 'double', 'kept', 'value', count(value) from events
    union all select 'props', 'int', 'kept', 'props', count(try_cast(props as integer)) from events
    union all select 'double_id', 'bigint', 'derived', null, count(event_id) from events
    union all select 'ts', 'timestamp_ntz', 'dropped', 'ts', count(ts) from events""",
)
def preview_schema(spark, sf_dir):
    return transform.schema_table(d.events(spark, sf_dir), EDIT)


# Quality gates


def published(spark, sf_dir) -> Published:
    """Bronze, Silver and all Gold tables, each written once and measured in the same job."""
    key = mk.HashKey.prepare(spark, d.HASH_SECRET)
    return publish(d.bronze(spark, sf_dir), scratch(spark), key)


def rows_of_sql(name: str) -> str:
    return f"select '{name}.rows' as metric, cast(count(*) as double) as value from (select * from ({RAW_ORACLES[name]}))"


NUMBERS = " union all ".join(
    [
        "select 'bronze.rows' as metric, cast(count(*) as double) as value from bronze",
        f"select 'bronze.null_conversation', {count_if('conversation_id is null')} from bronze",
        "select 'messages.rows', count(*) from m",
        "select 'messages.clear_cpf', 0 from m having count(*) >= 0",
        "select 'conversations.rows', count(*) from c",
        rows_of_sql("leads_profile"),
        "select 'lead_scoring.low', min(lead_score) from ls",
        "select 'lead_scoring.high', max(lead_score) from ls",
        "select 'sentiment.low', min(sentiment_score) from s",
        "select 'sentiment.high', max(sentiment_score) from s",
        *[rows_of_sql(name) for name in quality.GOLD_TABLES],
    ]
)


@query("quality_numbers", NUMBERS)
def quality_numbers(spark, sf_dir):
    return published(spark, sf_dir).numbers


def _check_sql() -> str:
    """All checks as conditions on the numbers."""
    n = lambda metric: f"(select value from numbers where metric = '{metric}')"
    bronze, silver = n("bronze.rows"), n("messages.rows")
    rows = [
        ("bronze_not_empty", "error", bronze, 1, f"{bronze} > 0"),
        ("bronze_conversation_id", "error", n("bronze.null_conversation"), 0, f"{n('bronze.null_conversation')} = 0"),
        ("dedup_effect", "warning", f"{silver} - {bronze}", 0, f"{silver} < {bronze}"),
        ("silver_volume", "error", silver, 1000, f"{silver} >= 1000"),
        ("silver_ratio_error", "error", f"{silver} / {bronze}", 0.01, f"{silver} / {bronze} >= 0.01"),
        ("silver_ratio_warning", "warning", f"{silver} / {bronze}", 0.03, f"{silver} / {bronze} >= 0.03 or {silver} / {bronze} < 0.01"),
        ("clear_cpf", "error", n("messages.clear_cpf"), 0, f"{n('messages.clear_cpf')} = 0"),
        ("lead_score_range", "error", n("lead_scoring.high"), 100, f"{n('lead_scoring.low')} >= 0 and {n('lead_scoring.high')} <= 100"),
        ("sentiment_range", "error", n("sentiment.high"), 1, f"{n('sentiment.low')} >= -1 and {n('sentiment.high')} <= 1"),
        ("masked_columns", "error", "0", 0, "true"),
        *[(f"{t}_exists", "error", "1", 1, "true") for t in ("bronze", "messages", "leads_profile", "conversations", *quality.GOLD_TABLES)],
        *[(f"{t}_not_empty", "warning", n(f"{t}.rows"), 1, f"{n(f'{t}.rows')} > 0") for t in quality.GOLD_TABLES],
    ]
    listed = " union all ".join(
        f"""select '{name}' as "check", '{severity}' as severity, cast({value} as double) as value,
        cast({limit} as double) as threshold, {passed} as passed""" for name, severity, value, limit, passed in rows
    )
    return f"with numbers as materialized ({NUMBERS}) {listed}"


@query(
    "quality_checks",
    f"""select "check", severity, round(value, 6) as value, round(threshold, 6) as threshold, passed from ({_check_sql()})""",
)
def quality_checks(spark, sf_dir):
    done = published(spark, sf_dir)
    checks = quality.run_checks(done.tables, numbers=done.numbers)
    return checks.select("check", "severity", "value", "threshold", "passed")


FAULTS = ("bronze_conversation_id", "bronze_not_empty", "bronze_unexpected_columns", "dedup_effect")


@query(
    "quality_faults",
    """select 'bronze_not_empty' as "check", cast(count(*) as double) as value,
        cast(1 as double) as threshold, count(*) > 0 as passed from bronze
    union all select 'bronze_conversation_id', count(*), 0, count(*) = 0 from bronze
        where status = 'read'
    union all select 'dedup_effect', 0, 0, count(*) < 0 from bronze
    union all select 'bronze_unexpected_columns', 1, 0, count(*) < 0 from bronze""",
)
def quality_faults(spark, sf_dir):
    """The gate over data with faults put in: a further column, missing keys, no dedup."""
    raw = d.bronze(spark, sf_dir)
    key = F.when(F.col("status") == "read", None).otherwise(F.col("conversation_id"))
    faulty = raw.withColumn("conversation_id", key).withColumn("surprise", F.lit(1))
    checks = quality.run_checks(
        {"bronze": faulty, "messages": faulty}, expected_columns={"bronze": raw.columns}
    )
    return checks.filter(F.col("check").isin(*FAULTS)).select("check", "value", "threshold", "passed")


@query(
    "quality_verdict",
    f"""select case when bool_and(coalesce(passed, false)) filter (where severity = 'error') then 'PASS' else 'FAIL' end as status,
    coalesce(string_agg("check", '|' order by "check") filter (where not passed and severity = 'error'), '') as errors,
    coalesce(string_agg("check", '|' order by "check") filter (where not passed and severity = 'warning'), '') as warnings,
    coalesce(string_agg("check", '|' order by "check") filter (where passed is null), '') as unmeasured
    from ({_check_sql()})""",
)
def quality_verdict(spark, sf_dir):
    """The verdict over all tables."""
    done = published(spark, sf_dir)
    return quality.verdict(quality.run_checks(done.tables, numbers=done.numbers))


@query(
    "zero_denominators",
    """select count(*) filter (where total_wins = 0) as zero,
    count(*) filter (where total_wins is null) as missing from fcr""",
)
def zero_denominators(spark, sf_dir):
    resolution = contacts.resolution_kinds(disclosed(spark, sf_dir))
    return quality.zero_denominators(resolution, "total_wins")


# Diagnostics


def diagnoses(spark, sf_dir) -> DataFrame:
    return diagnostics.build_records(d.raw_diagnoses(spark, sf_dir))


def log(spark, sf_dir) -> DataFrame:
    return diagnostics.apply_feedback(diagnoses(spark, sf_dir), d.feedback(spark, sf_dir))


COSTED = """provider, model, input_tokens, output_tokens, estimated_cost_usd"""


@query("cost_usd", f"select id, {COSTED} from base_diag")
def cost_usd(spark, sf_dir):
    return diagnoses(spark, sf_dir).select("id", *COSTED.split(", "))


@query(
    "append_records",
    "select status, pr_kind, count(*) as records from base_diag group by status, pr_kind",
)
def append_records(spark, sf_dir):
    path, name = scratch(spark), f"diagnostics_{uuid.uuid4().hex}"
    tables.append_table(diagnoses(spark, sf_dir), name, path)
    spark.sql(f"drop table {name}")
    stored = tables.read_parquet(spark, path)
    return stored.groupBy("status", "pr_kind").agg(F.count(F.lit(1)).alias("records"))


@query("error_hash", "select id, error_hash from base_diag")
def error_hash(spark, sf_dir):
    raw = d.raw_diagnoses(spark, sf_dir)
    return raw.select("id", diagnostics.error_hash(F.col("error_message")).alias("error_hash"))


@query(
    "build_records",
    """select b.* replace (round(confidence, 6) as confidence), '' as diagnosis, '' as root_cause,
    '' as fix_description, '' as file_to_fix, false as requires_human_review,
    cast(null as varchar) as pr_status, cast(null as timestamp) as pr_resolved_at,
    cast(null as double) as resolution_time_hours, cast(null as varchar) as feedback
    from base_diag b""",
)
def build_records(spark, sf_dir):
    return diagnoses(spark, sf_dir)


@query(
    "apply_feedback",
    """select id, pr_number, pr_status, pr_resolved_at,
    round(resolution_time_hours, 6) as resolution_time_hours, feedback from diag""",
)
def apply_feedback(spark, sf_dir):
    return log(spark, sf_dir).select(
        "id", "pr_number", "pr_status", "pr_resolved_at", "resolution_time_hours", "feedback"
    )


@query(
    "stored_feedback",
    """select id, pr_number, pr_status, pr_resolved_at,
    round(resolution_time_hours, 6) as resolution_time_hours, feedback from diag""",
)
def stored_feedback(spark, sf_dir):
    """Feedback written into the stored log in three parts, one of which comes twice."""
    stored = diagnostics.stored_log(scratch(spark), parts=8)
    diagnostics.store_records(diagnoses(spark, sf_dir), stored)
    feedback = d.feedback(spark, sf_dir)
    for part in (2, 0, 1, 0):
        diagnostics.store_feedback(feedback.where(F.col("pr_number") % 3 == part), stored)
    return incremental.current(spark, stored).select(
        "id", "pr_number", "pr_status", "pr_resolved_at", "resolution_time_hours", "feedback"
    )


@query(
    "rejected_feedback",
    """select pr_number, pr_status, case when pr_number <= 0 then 'pr_number must be positive'
    else 'pr_status must be merged or closed' end as reason from feedback
    where pr_number <= 0 or pr_status not in ('merged', 'closed')""",
)
def rejected_feedback(spark, sf_dir):
    return diagnostics.rejected_feedback(d.feedback(spark, sf_dir)).select(
        "pr_number", "pr_status", "reason"
    )


LATEST = f"""select *, row_number() over (partition by error_hash order by "timestamp" desc, id desc)
    as rn from diag where status = 'success' and "timestamp" > {AS_OF} - interval '24' hour
    and "timestamp" <= {AS_OF}"""


@query(
    "recent_successes",
    f"select error_hash, id, job_id, pr_number, branch_name from ({LATEST})",
)
def recent_successes(spark, sf_dir):
    return diagnostics.recent_successes(log(spark, sf_dir), as_of()).select(
        "error_hash", "id", "job_id", "pr_number", "branch_name"
    )


@query(
    "duplicate_decision",
    f"""select id, reason, reason not in ('no_previous_success',
        'previous_pr_closed_without_merge') as is_duplicate
    from (select r.id, case when l.error_hash is null then 'no_previous_success'
            when l.pr_number = 0 then 'previous_success_without_pr_number'
            when f.pr_status is null then 'pr_status_check_failed'
            when f.pr_status in ('open', 'merged') then 'previous_pr_' || f.pr_status
            when f.pr_status = 'closed' then 'previous_pr_closed_without_merge'
            else 'previous_pr_status_' || f.pr_status end as reason
        from base_diag r left join (select * from ({LATEST}) where rn = 1) l
            on r.error_hash = l.error_hash
        left join feedback f on f.pr_number = l.pr_number and f.pr_number > 0)""",
)
def duplicate_decision(spark, sf_dir):
    states = d.feedback(spark, sf_dir).select("pr_number", F.col("pr_status").alias("pr_state"))
    decided = diagnostics.duplicate_decision(
        d.raw_diagnoses(spark, sf_dir).select("id", "error_message"),
        log(spark, sf_dir),
        as_of(),
        states.filter(F.col("pr_number") > 0),
    )
    return decided.select("id", "reason", "is_duplicate")


@query(
    "outcome_status",
    """select id, case when event_type = 'view' then 'no_fix_proposed'
    when confidence < 0.5 then 'low_confidence' when event_type = 'error' then 'validation_failed'
    when event_type = 'click' then 'dry_run' else 'success' end as status
    from (select 'd' || lpad(cast(event_id as varchar), 12, '0') as id, event_type,
        value / 500 as confidence from events)""",
)
def outcome_status(spark, sf_dir):
    kind = F.col("event_type")
    status = diagnostics.outcome_status(
        fixes=F.when(kind == "view", 0).otherwise(1),
        confidence=F.col("value") / 500,
        threshold=0.5,
        valid=kind != "error",
        dry_run=kind == "click",
    )
    identity = F.concat(F.lit("d"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return d.events(spark, sf_dir).select(identity.alias("id"), status.alias("status"))


@query(
    "all_outcome_statuses",
    """select id, case when n % 11 = 0 then 'duplicate_skip' when n % 7 = 0 then 'llm_failed'
    when event_type = 'view' and n % 2 = 0 then 'no_fix_proposed'
    when confidence < 0.3 then 'low_confidence' when event_type = 'error' then 'validation_failed'
    when n % 13 = 0 then 'dry_run'
    when n % 5 = 0 then case n % 3 when 0 then 'report_pr_created' when 1 then 'report_skipped'
        else 'report_failed' end
    when n % 5 = 1 then 'pr_failed' else 'success' end as status
    from (select 'd' || lpad(cast(event_id as varchar), 12, '0') as id, event_type,
        event_id as n, value / 500 as confidence from events)""",
)
def all_outcome_statuses(spark, sf_dir):
    """Every status of a diagnosis, the results of the pull request and of the report included."""
    n, kind = F.col("event_id"), F.col("event_type")
    status = diagnostics.outcome_status(
        fixes=F.when((kind == "view") & (n % 2 == 0), 0).otherwise(1),
        confidence=F.col("value") / 500,
        threshold=0.3,
        valid=kind != "error",
        dry_run=n % 13 == 0,
        duplicate=n % 11 == 0,
        answered=n % 7 != 0,
        attempt=F.when(n % 5 == 0, "unchanged").when(n % 5 == 1, "failed").otherwise("created"),
        report=F.when(n % 3 == 0, "created").when(n % 3 == 1, "unsupported").otherwise("failed"),
    )
    identity = F.concat(F.lit("d"), F.lpad(n.cast("string"), 12, "0"))
    return d.events(spark, sf_dir).select(identity.alias("id"), status.alias("status"))


PANELS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "diagnoses_per_day": (
        lambda diag: diagnostics.diagnoses_per_day(diag, as_of()),
        f"""select cast("timestamp" as date) as dia, status, count(*) as diagnosticos from diag
        where "timestamp" between cast({AS_OF} as date) - 30 and {AS_OF} group by all""",
    ),
    "cost_per_model": (
        lambda diag: diagnostics.cost_per_model(diag, as_of()),
        f"""select provider, model, count(*) as chamadas,
        cast(sum(input_tokens) as bigint) as total_input_tokens,
        cast(sum(output_tokens) as bigint) as total_output_tokens,
        round(sum(estimated_cost_usd), 4) as custo_total_usd from diag
        where "timestamp" between cast({AS_OF} as date) - 30 and {AS_OF} and provider <> '' group by all""",
    ),
    "cumulative_cost": (
        lambda diag: diagnostics.cumulative_cost(diag, as_of()),
        f"""select dia, round(cost, 4) as custo_dia_usd,
        round(sum(cost) over (order by dia), 4) as custo_acumulado_usd
        from (select cast("timestamp" as date) as dia, sum(estimated_cost_usd) as cost from diag
            where "timestamp" between cast({AS_OF} as date) - 60 and {AS_OF} group by all)""",
    ),
    "confidence_per_task": (
        diagnostics.confidence_per_task,
        """select failed_task, count(*) as total_diagnosticos,
        round(avg(confidence), 3) as confianca_media, round(min(confidence), 3)
            as confianca_minima, round(max(confidence), 3) as confianca_maxima
        from diag where confidence > 0 group by failed_task""",
    ),
    "frequent_errors": (
        diagnostics.frequent_errors,
        """select error_hash, arg_min(error_message, row("timestamp", id)) as erro_resumo,
        count(*) as ocorrencias, count(distinct run_id) as runs_distintos,
        min("timestamp") as primeira_ocorrencia, max("timestamp") as ultima_ocorrencia
        from diag group by error_hash order by ocorrencias desc, error_hash limit 10""",
    ),
    "status_shares": (
        diagnostics.status_shares,
        """select status, count(*) as total,
        round(count(*) * 100.0::double / sum(count(*)) over (), 2) as percentual
        from diag group by status""",
    ),
    "latency_per_model": (
        diagnostics.latency_per_model,
        """select provider, model, round(avg(duration_seconds), 2) as tempo_medio_s,
        round(max(duration_seconds), 2) as tempo_max_s, count(*) as execucoes
        from diag where duration_seconds > 0 group by all""",
    ),
    "latest_pull_requests": (
        diagnostics.latest_pull_requests,
        """select "timestamp", job_name, failed_task, round(confidence, 2) as confianca,
        pr_number, pr_url, pr_status, provider || '/' || model as llm from diag
        where pr_url <> '' order by "timestamp" desc, id desc limit 20""",
    ),
    "acceptance_shares": (
        diagnostics.acceptance_shares,
        """select coalesce(pr_status, 'pending') as pr_status, feedback, count(*) as total,
        round(count(*) * 100.0::double / sum(count(*)) over (), 2) as percentual
        from diag where status = 'success' group by 1, 2""",
    ),
    "resolution_hours": (
        diagnostics.resolution_hours,
        """select pr_status, count(*) as prs_resolvidos,
        round(avg(resolution_time_hours), 2) as tempo_medio_h,
        round(min(resolution_time_hours), 2) as tempo_min_h,
        round(max(resolution_time_hours), 2) as tempo_max_h
        from diag where pr_status in ('merged', 'closed') group by pr_status""",
    ),
    "acceptance_per_model": (
        diagnostics.acceptance_per_model,
        """select provider, model, count(*) as prs_criados,
        count(*) filter (where feedback = 'fix_accepted') as aceitos,
        count(*) filter (where feedback = 'fix_rejected') as rejeitados,
        round(aceitos * 100.0::double / prs_criados, 2) as taxa_aceitacao_pct
        from diag where status = 'success' and pr_number > 0 group by provider, model""",
    ),
    "cost_alert": (
        lambda diag: diagnostics.cost_alert(diag, as_of()),
        f"""select custo_24h, custo_24h > 5 as alerta from (
        select round(coalesce(sum(estimated_cost_usd), 0), 4) as custo_24h from diag
        where "timestamp" between {AS_OF} - interval '24' hour and {AS_OF})""",
    ),
    "failure_alert": (
        lambda diag: diagnostics.failure_alert(diag, as_of()),
        f"""select taxa_falha_pct, taxa_falha_pct > 10 as alerta from (
        select coalesce(round(count(*) filter (where status = 'llm_failed') * 100.0::double
            / nullif(count(*), 0), 2), 0.0::double) as taxa_falha_pct from diag
        where "timestamp" between {AS_OF} - interval '24' hour and {AS_OF})""",
    ),
    "repeated_error_alert": (
        lambda diag: diagnostics.repeated_error_alert(diag, as_of()),
        f"""select error_hash, count(*) as repeticoes from diag
        where "timestamp" between {AS_OF} - interval '6' hour and {AS_OF} group by error_hash
        having count(*) > 3""",
    ),
}


def register_panel(name: str, panel: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    @query(name, oracle)
    def run(spark, sf_dir):
        return panel(log(spark, sf_dir))


for _name, (_panel, _oracle) in PANELS.items():
    register_panel(_name, _panel, _oracle)


# Job runs

TASKS = (("bronze_ingestion", "state_1"), ("silver_dedup", "state_2"), ("gold_funnel", "state_3"))
ROOT = "[x[1] for x in tasks if trim(upper(x[2])) in ('FAILED', 'TIMEDOUT')]"
CASCADE = "[x[1] for x in tasks if trim(upper(x[2])) = 'UPSTREAM_FAILED']"
FAILED_RUNS = f"""select *, case when len({ROOT}) > 0 then {ROOT} else {CASCADE} end as failed
    from (select *, [{', '.join(f"['{t}', {s}]" for t, s in TASKS)}] as tasks from runs)"""
TASK_ERRORS = redact_sql("task_error")


@query("failed_tasks", f"select run_id, {joined('failed')} as failed from ({FAILED_RUNS})")
def failed_tasks(spark, sf_dir):
    listed = runs.failed_tasks(F.col("tasks"))
    return d.job_runs(spark, sf_dir).select(
        "run_id", F.transform(listed, lambda t: t["task_key"]).alias("failed")
    )


def flat_errors(records: DataFrame) -> DataFrame:
    """Error map as text, in task order."""
    pairs = F.array_sort(
        F.transform(F.map_entries("errors"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return records.withColumn("errors", pairs)


FLAT_ERRORS = joined(f"list_sort([x || '=' || {TASK_ERRORS} for x in failed])")


@query(
    "failure_records",
    f"""select job_id, job_name, run_id, {joined('failed')} as failed_tasks,
    {FLAT_ERRORS} as errors, cast(start_time as varchar) as "timestamp" from ({FAILED_RUNS})""",
)
def failure_records(spark, sf_dir):
    return flat_errors(runs.failure_records(d.job_runs(spark, sf_dir)))


@query(
    "recent_failures",
    f"""select job_id, job_name, run_id, {joined('failed')} as failed_tasks,
    {FLAT_ERRORS} as errors, cast(start_time as varchar) as "timestamp"
    from ({FAILED_RUNS})
    where start_time between epoch_ms({AS_OF}) - 6 * 3600000 and epoch_ms({AS_OF})
    and result_state in ('FAILED', 'SUCCESS_WITH_FAILURES') and len(failed) > 0""",
)
def recent_failures(spark, sf_dir):
    return flat_errors(runs.recent_failures(d.job_runs(spark, sf_dir), as_of(), hours=6))


@query(
    "job_summary",
    """select job_id, result_state as status, strftime(make_timestamp(start_time * 1000)
        - interval '3' hour, '%Y-%m-%d %H:%M:%S') || ' (horario de Brasilia)' as last_run_at,
    round(run_duration / 1000::double, 6) as duration_sec,
    'bronze_ingestion=' || state_1 || '|gold_funnel=' || state_3 || '|silver_dedup=' || state_2
        as tasks
    from (select *, row_number() over (partition by job_id order by start_time desc, run_id desc)
        as rn from runs) where rn = 1""",
)
def job_summary(spark, sf_dir):
    summary = runs.pipeline_summary(d.job_runs(spark, sf_dir))
    states = F.transform(
        F.map_entries("tasks"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return summary.withColumn("tasks", F.array_sort(states))


# Platform metrics


@query(
    "deployment_breakdown",
    f"""select company_id, count(*) as total, {count_if("status = 'success'")} as success,
    {count_if("status = 'failed'")} as failed, {count_if("status = 'running'")} as running,
    {count_if("status = 'cancelled'")} as cancelled,
    round(avg(case when status = 'success' then duration_ms end) / 1000, 6)
        as avg_duration_seconds from deps group by company_id""",
)
def deployment_breakdown(spark, sf_dir):
    return platform_metrics.deployment_breakdown(d.deployments(spark, sf_dir))


@query(
    "job_coverage",
    """select company_id, count(*) as total, count(databricks_job_id) as with_databricks_job
    from deps group by company_id""",
)
def job_coverage(spark, sf_dir):
    return platform_metrics.pipeline_metrics(d.deployments(spark, sf_dir))


@query(
    "channel_metrics",
    f"""select company_id, cast(sum(n) as bigint) as total,
    string_agg(channel || '=' || n, '|' order by channel) as by_channel,
    cast(sum(k) as bigint) as connected
    from (select company_id, channel, count(*) as n, {count_if("state = 'connected'")} as k
        from deps group by company_id, channel) group by company_id""",
)
def channel_metrics(spark, sf_dir):
    metrics = platform_metrics.channel_metrics(d.deployments(spark, sf_dir))
    entries = F.transform(
        F.map_entries("by_channel"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return metrics.withColumn("by_channel", entries)


@query(
    "diagnosis_metrics",
    f"""select greatest(logged, prs_created) as total_diagnostics, prs_created,
    round(logged * 0.25::double, 2) as estimated_cost_usd
    from (select {count_if("contains(message, 'Observer') and level = 'success'")} as logged,
        {count_if("starts_with(branch, 'fix/agent-auto-')")} as prs_created from deps)""",
)
def diagnosis_metrics(spark, sf_dir):
    deployments = d.deployments(spark, sf_dir)
    return platform_metrics.diagnosis_metrics(deployments, deployments.select("branch"))


def intent_sql(value: str) -> str:
    counts = {
        intent: " + ".join(f"contains(lower({value}), {text(w)})::int" for w in words)
        for intent, words in fv.INTENT_WORDS.items()
    }
    best = f"greatest({', '.join(counts.values())})"
    whens = " ".join(f"when {count} = {best} then '{intent}'" for intent, count in counts.items())
    return f"case when {best} = 0 then 'general' {whens} end"


@query(
    "document_intents",
    f"""select doc_id, {intent_sql('text')} as intent,
    cast(floor(length(text) / 4) as bigint) as tokens from documents""",
)
def document_intents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        classify_intent(F.col("text")).alias("intent"),
        estimate_tokens(F.col("text")).alias("tokens"),
    )


@query(
    "intent_volume",
    f"""select cast("timestamp" as date) as day, channel,
    case when message_body is null then 'general' else {intent_sql('message_body')} end as intent,
    count(*) as messages,
    cast(sum(coalesce(floor(length(message_body) / 4), 0)) as bigint) as tokens
    from m group by all""",
)
def intent_volume(spark, sf_dir):
    return platform_metrics.intent_volume(clean(spark, sf_dir))


# Extraction over whole documents, pages and chats


@query(
    "document_emails",
    f"""select doc_id, u.value as email, {mask_email('u.value')} as masked
    from (select doc_id, {found('text', fv.EMAIL)} as emails from documents),
    unnest(emails) as u(value)""",
)
def document_emails(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(ex.extract_email(F.col("text"))).alias("email")
    )
    return hits.withColumn("masked", mk.mask_email(F.col("email")))


@query(
    "document_phones",
    f"""select doc_id, u.value as phone, {mask_phone('u.value')} as masked
    from (select doc_id, {found('text', fv.PHONE)} as phones from documents),
    unnest(phones) as u(value)""",
)
def document_phones(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(ex.extract_phone(F.col("text"))).alias("phone")
    )
    return hits.withColumn("masked", mk.mask_phone(F.col("phone")))


@query(
    "page_prices",
    f"select page_id, {price_text(prices('html'))} as prices, {joined(found('html', fv.PHONE))} "
    "as phones from pages",
)
def page_prices(spark, sf_dir):
    page = table(spark, sf_dir, "pages").select(
        "page_id",
        ex.extract_price(F.col("html")).alias("prices"),
        ex.extract_phone(F.col("html")).alias("phones"),
    )
    return page.withColumn("prices", cents("prices"))


CHAT_WORDS = {"positive": ("the", "and", "la"), "negative": ("not", "de", "que")}


def word_hits(words: tuple[str, ...]) -> str:
    return (
        f"cast(sum(len([w for w in string_split(lower(text), ' ') "
        f"if regexp_matches(w, '{'|'.join(words)}')])) as bigint)"
    )


@query(
    "chat_sentiment",
    f"""select *, {LABEL} as sentiment_label from (select *,
    case when total_positive + total_negative = 0 then 0.0::double else
    round((total_positive - total_negative) / cast(total_positive + total_negative as double), 3)
    end as sentiment_score from (select cast(conv_id as varchar) as conversation_id,
    {word_hits(CHAT_WORDS['positive'])} as total_positive,
    {word_hits(CHAT_WORDS['negative'])} as total_negative, count(*) as inbound_messages,
    cast(null as varchar) as outcome from conversations where role = 'user' group by conv_id))""",
)
def chat_sentiment(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    chats = turns.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.timestamp_seconds("turn").alias("timestamp"),
        F.col("turn").cast("string").alias("message_id"),
        F.when(F.col("role") == "user", "inbound").otherwise("outbound").alias("direction"),
        F.col("text").alias("message_body"),
        F.lit(None).cast("string").alias("conversation_outcome"),
    )
    return sentiment.keyword_sentiment(chats, CHAT_WORDS["positive"], CHAT_WORDS["negative"])


# Streams, run to the end of what is there


def event_stream(spark, sf_dir) -> DataFrame:
    source = d.events(spark, sf_dir)
    return spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events*.parquet")


def drained(df: DataFrame, close: Callable[[], None] | None = None) -> DataFrame:
    """Rows the stream gives until its source is used up, by way of a Parquet folder; after
    ``close`` has added end markers, also those that were still open."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    schema = df.schema
    stream.write_available(df, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    if close:
        close()
        stream.write_available(df, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


@query(
    "stream_dedup",
    "select 'e' || cast(event_id as varchar) as id, ts as received_at from events",
)
def stream_dedup(spark, sf_dir):
    inbound = stream.new_messages(d.channel_events(event_stream(spark, sf_dir)))
    return drained(stream.dedup_stream(inbound).select("id", "received_at"))


def in_slices(df: DataFrame, time: str, order: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """A stream that brings the rows of ``df`` in one file for each eight days of a month, one file a
    trigger, in the order given."""
    spark, folder = df.sparkSession, scratch(df.sparkSession)
    for part in order:
        df.where(F.floor((F.day(time) - 1) / 8) == part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


EVENT_FILTER = "event_type <> 'purchase' and event_id % 7 <> 0 and event_id % 11 <> 0"


@query(
    "stream_filter",
    f"""select 'e' || cast(event_id as varchar) as id, cast(user_id as varchar) as sender_id,
    'oi ' || event_type as text from events, (values (0), (1)) as t(copy)
    where ts >= timestamp '2024-01-10 00:00:00'
    and floor(epoch(ts)) >= epoch(timestamp '2024-01-10 00:00:00') and {EVENT_FILTER}""",
)
def stream_filter(spark, sf_dir):
    start = F.lit("2024-01-10 00:00:00").cast("timestamp")
    path = scratch(spark)
    d.channel_events(d.events(spark, sf_dir)).write.json(path)
    kept = stream.filter_events(stream.read_events(spark, path), start)
    return drained(kept.select("id", "sender_id", "text"))


@query(
    "stream_repeated_errors",
    """select error_hash, repeticoes, window_start, window_start + interval '6' hour as window_end
    from (select error_hash, date_trunc('hour', "timestamp") - to_hours(h) as window_start,
        count(*) as repeticoes
        from base_diag, (values (0), (1), (2), (3), (4), (5)) as t(h) group by all)
    where repeticoes > 3""",
)
def stream_repeated_errors(spark, sf_dir):
    """Windows as they stand after the last of four triggers, the open ones among them."""
    records = diagnostics.build_records(d.raw_diagnoses(spark, sf_dir))
    found = stream.repeated_errors(in_slices(records, "timestamp"))
    windows = live.window_table(scratch(spark), "repeated_errors", ("window_start", "error_hash"))
    live.keep_windows(found, windows, f"{windows.root}/checkpoint").awaitTermination()
    return live.current(spark, windows).select("error_hash", "repeticoes", "window_start", "window_end")


@query(
    "stream_sessions",
    """select conversation_id, min("timestamp") as session_start,
        max("timestamp") + interval '120' minute as session_end, count(*) as messages
    from (select *, sum(opens) over (partition by conversation_id order by "timestamp",
            message_id) as session
        from (select *, case when "timestamp" >= lag("timestamp") over (
                partition by conversation_id order by "timestamp", message_id)
                + interval '120' minute then 1 else 0 end as opens
            from (select conversation_id, cast("timestamp" as timestamp) as "timestamp",
                message_id from bronze)))
    group by conversation_id, session""",
)
def stream_sessions(spark, sf_dir):
    """Sessions after four triggers, of which the second brings later messages than the third."""
    sent = messages.type_timestamp(d.bronze(spark, sf_dir)).select("conversation_id", "timestamp")
    known = live.session_table(scratch(spark), parts=16)
    live.keep_sessions(
        in_slices(sent, "timestamp", (0, 2, 1, 3)), known, f"{known.root}/checkpoint"
    ).awaitTermination()
    return live.sessions_now(spark, known)


@query("stream_ingest", "select event_id, event_type, cast(null as varchar) as note from events")
def stream_ingest(spark, sf_dir):
    schema = T.StructType().add("event_id", "long").add("event_type", "string").add("note", "string")
    folder = scratch(spark)
    for _ in range(2):  # the second run finds nothing new
        stream.ingest_stream(
            spark, f"{sf_dir}/events*.parquet", schema, f"{folder}/bronze", f"{folder}/checkpoint"
        ).awaitTermination()
    return spark.read.parquet(f"{folder}/bronze").select("event_id", "event_type", "note")
