"""Chat tables derived from the test tables, as column expressions both engines understand.

Every event becomes a message that was delivered twice, a diagnosis, a job run, a deployment and
a channel event. The same expressions build the Spark DataFrames and, as SQL text, the tables of
the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_SECRET = "workload-secret"
AS_OF = "2024-01-30 12:00:00"


def choose(number: str, options: list[str], other: str = "null") -> str:
    """CASE over ``number`` modulo the options; ``None`` entries fall to ``other``."""
    whens = " ".join(
        f"when {place} then {text}" for place, text in enumerate(options) if text is not None
    )
    return f"case ({number}) % {len(options)} {whens} else {other} end"


def quoted(*texts: str) -> list[str]:
    return [f"'{text}'" for text in texts]


def digits(expression: str, size: int) -> str:
    """Last ``size`` decimal digits of a number, with leading zeros."""
    return f"lpad(cast(({expression}) % {10 ** size} as varchar(20)), {size}, '0')"


CONV_NO = "(user_id * 8 + cast(floor(day(ts) / 4) as bigint))"
DIRECTION = (
    "case when event_type in ('view', 'click', 'signup') then 'inbound' else 'outbound' end"
)
CPF = (
    f"{digits('event_id * 7919 + 101', 3)} || '.' || {digits('event_id * 31 + 7', 3)} || '.' || "
    f"{digits('event_id', 3)} || '-' || {digits('event_id', 2)}"
)
DOMAIN = choose(
    "user_id",
    quoted("gmail.com", "hotmail.com", "outlook.com", "yahoo.com.br", "icloud.com", "acme.com"),
)
INSURER = choose("user_id", quoted("hdi seguros", "Porto Seguro", "allianz", "azul seguros"))
BODY = choose(
    "event_id",
    [
        "'bom dia, seguro para Onix ano 2015  muito obrigado'",
        f"'meu cpf eh ' || {CPF}",
        f"'email joao.silva' || {digits('event_id', 4)} || '@' || {DOMAIN}",
        f"'placa SYL' || {digits('event_id', 1)} || 'v' || {digits('event_id * 7', 2)} || "
        f"' ou ABC-' || {digits('event_id * 3', 4)}",
        f"'cep ' || {digits('event_id * 13', 5)} || '-' || {digits('event_id', 3)} || "
        f"' me liga (11) 9' || {digits('event_id * 17', 4)} || '-' || {digits('event_id', 4)}",
        f"'a ' || {INSURER} || ' fez por R$ 1.' || {digits('event_id', 3)} || ',50 "
        f"e allianz por R$ ' || {digits('event_id * 3', 4)}",
        "'qual o valor da parcela?'",
        "'a cobertura inclui guincho?'",
        "'otimo gostei top pode fazer fechado'",
        "'muito caro, vou pensar no desconto do concorrente'",
        "''",
    ]
    + [None],
)
OUTCOME = choose(
    CONV_NO,
    quoted(
        "venda_fechada", "ghosting", "perdido_preco", "perdido_concorrente", "em_negociacao",
        "proposta_enviada", "desistencia_lead",
    )
    + [None],
)
RESPONSE = "case when event_id % 50 = 0 then '\"x\"' else cast(cast(floor(value) as bigint) as varchar(20)) end"
METADATA = (
    "'{\"device\": \"' || " + choose("user_id", quoted("android", "iphone", "web")) + " || "
    "'\", \"city\": \"cidade ' || cast(user_id % 9 as varchar(20)) || '\", \"state\": \"' || "
    + choose("user_id", quoted("SP", "RJ", "MG", "BA", "RS")) + " || "
    "'\", \"response_time_sec\": ' || " + RESPONSE + " || "
    "', \"is_business_hours\": ' || case when hour(ts) between 8 and 17 then 'true' else 'false' end || "
    "', \"lead_source\": \"' || " + choose("user_id", quoted("site", "indicacao", "ads")) + " || '\"}'"
)

# One row per event and delivery (copy 0 and 1)
MESSAGES = {
    "message_id": "'m' || lpad(cast(event_id * 2 + copy as varchar(20)), 14, '0')",
    "conversation_id": f"'conv_' || lpad(cast({CONV_NO} as varchar(20)), 8, '0')",
    "timestamp": "cast(ts as varchar(40))",
    "direction": DIRECTION,
    "sender_phone": "'+55 11 9' || lpad(cast(user_id as varchar(20)), 8, '0')",
    "sender_name": choose(
        "event_id",
        ["'  '", "'maria   DA silva '", "'JOAO souza'", "'ana'"] + [None],
    ),
    "message_type": choose("event_id", quoted("text", "text", "audio", "image")),
    "message_body": BODY,
    "status": f"case copy when 0 then {choose('event_id', quoted('sent', 'failed', 'delivered'))} "
    f"else {choose('event_id', quoted('delivered', 'read'))} end",
    "channel": "'whatsapp'",
    "campaign_id": f"'camp_' || cast({CONV_NO} % 10 as varchar(20))",
    "agent_id": "'agent_' || cast(user_id % 20 as varchar(20))",
    "conversation_outcome": OUTCOME,
    "metadata": METADATA,
}

ERROR_TEXT = (
    "'  Task failed for user' || cast(event_id % 25 as varchar(20)) || '@acme.com with cpf "
    "123.456.789-' || lpad(cast(event_id % 25 as varchar(20)), 2, '0') || ' '"
)
HAS_PR = "event_type in ('purchase', 'signup')"
PR_NUMBER = f"case when {HAS_PR} then event_id + 1 else 0 end"
# One raw diagnosis per event
RAW_DIAGNOSES = {
    "id": "'d' || lpad(cast(event_id as varchar(20)), 12, '0')",
    "timestamp": "cast(ts as timestamp)",
    "job_id": "user_id % 10",
    "job_name": "'job ' || cast(user_id % 10 as varchar(20))",
    "run_id": "cast(floor(event_id / 3) as bigint)",
    "failed_task": choose("event_id", quoted("bronze_ingestion", "silver_dedup", "gold_funnel")),
    "error_message": ERROR_TEXT,
    "confidence": "case when event_type = 'error' then 0.0e0 else round(value / 500, 4) end",
    "provider": choose("user_id", quoted("anthropic", " OpenAI ", "other", "")),
    "model": choose(
        "user_id", quoted("claude-opus-x", "gpt-4o-mini", "none", "gpt-4", "claude-haiku-x")
    ),
    "input_tokens": "event_id % 5000",
    "output_tokens": "event_id % 900",
    "duration_seconds": "case when event_type = 'view' then 0.0e0 else value / 7 end",
    "status": "case event_type when 'error' then 'llm_failed' when 'view' then 'duplicate_skip' "
    "when 'click' then 'no_fix_proposed' else 'success' end",
    "pr_number": PR_NUMBER,
    "pr_url": f"case when {HAS_PR} then 'https://git.example/pr/' || cast(event_id + 1 as varchar(20)) else '' end",
    "branch_name": f"case when {HAS_PR} then 'fix/agent-auto-' || cast(event_id as varchar(20)) else 'main' end",
    "pr_kind": f"case when {HAS_PR} then 'fix' else '' end",
}
# One feedback row per pull request
FEEDBACK = {
    "pr_number": PR_NUMBER,
    "pr_status": choose("event_id", quoted("merged", "closed", "open")),
    "resolved_at": "cast(ts as timestamp) + interval '5' hour",
}

RUN_STATE = (
    "case event_type when 'error' then 'FAILED' when 'click' then 'SUCCESS_WITH_FAILURES' "
    "else 'SUCCESS' end"
)
TASK_ERROR = "'boom for joao' || cast(user_id as varchar(20)) || '@acme.com'"
# One job run per event; its three tasks are built apart
RUNS = {
    "job_id": "user_id % 10",
    "job_name": "'job ' || cast(user_id % 10 as varchar(20))",
    "run_id": "event_id",
    "start_time": "cast(floor({epoch_ms}) as bigint)",
    "result_state": RUN_STATE,
    "run_duration": "cast(floor(value * 100) as bigint)",
    "state_1": "case event_type when 'error' then 'FAILED' else 'SUCCESS' end",
    "state_2": "case event_type when 'error' then 'UPSTREAM_FAILED' when 'click' "
    "then ' upstream_failed' else 'SUCCESS' end",
    "state_3": "case when event_type = 'error' and event_id % 2 = 0 then 'TIMEDOUT' "
    "else 'SUCCESS' end",
    "task_error": TASK_ERROR,
}

DEPLOYMENTS = {
    "company_id": "user_id % 5",
    "status": "case event_type when 'error' then 'failed' when 'purchase' then 'success' "
    "when 'signup' then 'running' when 'view' then 'cancelled' else 'pending' end",
    "duration_ms": "case when event_id % 9 = 0 then null else cast(floor(value * 1000) as bigint) end",
    "databricks_job_id": "case when event_type = 'view' then null else event_id end",
    "channel": choose("event_id", quoted("whatsapp", "telegram", "discord")),
    "state": "case when event_type = 'signup' then 'connected' else 'closed' end",
    "message": "case when event_type = 'purchase' then 'Observer acionado' else 'deploy' end",
    "level": "case when event_id % 3 = 0 then 'info' else 'success' end",
    "branch": f"case when {HAS_PR} then 'fix/agent-auto-' || cast(event_id as varchar(20)) else 'main' end",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in columns.items()])


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages: each event as two deliveries."""
    return delivered_twice(events(spark, sf_dir))


def delivered_twice(source: DataFrame) -> DataFrame:
    """Message columns, worked out once per event where the delivery does not matter."""
    per_copy = {name: text for name, text in MESSAGES.items() if "copy" in text}
    per_event = {name: text for name, text in MESSAGES.items() if name not in per_copy}
    sent = project(source, {"event_id": "event_id", **per_event})
    copies = sent.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return copies.select(
        *[F.expr(per_copy[c]).alias(c) if c in per_copy else F.col(c) for c in MESSAGES]
    )


def raw_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(events(spark, sf_dir), RAW_DIAGNOSES)


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(events(spark, sf_dir), FEEDBACK)


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = project(
        events(spark, sf_dir),
        {k: v.replace("{epoch_ms}", "unix_millis(cast(ts as timestamp))") for k, v in RUNS.items()},
    )

    def task(key: str, state: str):
        return F.struct(
            F.lit(key).alias("task_key"),
            F.col(state).alias("result_state"),
            F.col("task_error").alias("error"),
        )

    tasks = F.array(
        task("bronze_ingestion", "state_1"),
        task("silver_dedup", "state_2"),
        task("gold_funnel", "state_3"),
    )
    kept = [c for c in RUNS if not c.startswith("state_") and c != "task_error"]
    return flat.select(*kept, tasks.alias("tasks"))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(events(spark, sf_dir), DEPLOYMENTS)


def channel_events(events_df: DataFrame) -> DataFrame:
    """Channel events in the nested form of the stream, each sent twice with the same id."""
    twice = events_df.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    group = F.col("event_id") % 7 == 0
    number = F.col("user_id").cast("string")
    key = F.struct(
        F.when(group, F.concat(number, F.lit("@g.us")))
        .otherwise(F.concat(number, F.lit("@s.whatsapp.net")))
        .alias("remoteJid"),
        F.lit(None).cast("string").alias("remoteJidAlt"),
        (F.col("event_type") == "purchase").alias("fromMe"),
        F.lit(None).cast("string").alias("participant"),
    )
    return twice.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.lit("message.received").alias("eventType"),
        F.lit("inbound").alias("direction"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("receivedAt"),
        F.lit(None).cast("string").alias("processedAt"),
        F.when(F.col("event_id") % 11 == 0, "  ")
        .otherwise(F.concat(F.lit(" oi "), F.col("event_type")))
        .alias("textContent"),
        F.lit("inst").alias("instanceId"),
        F.concat(number, F.lit("@s.whatsapp.net")).alias("chatId"),
        F.struct(
            F.lit("ana").alias("pushName"),
            F.lit(False).alias("isFromMe"),
            F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias(
                "messageTimestamp"
            ),
            key.alias("key"),
        ).alias("rawPayload"),
    )
