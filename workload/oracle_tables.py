"""The tables of ``derived`` and the Silver tables, as SQL common table expressions."""

from __future__ import annotations

from parlance.functions import fixed_values as fv
from workload import derived as d


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f'{expression} as "{name}"' for name, expression in columns.items())


def found(body: str, pattern: str, group: int = 0) -> str:
    return f"coalesce(regexp_extract_all({body}, {text(pattern)}, {group}), [])"


def competitors(body: str) -> str:
    named = ", ".join(
        f"case when regexp_matches(lower({body}), {text(p)}) then {text(n)} end"
        for p, n in fv.COMPETITORS
    )
    return f"[x for x in [{named}] if x is not null]"


def prices(body: str) -> str:
    plain = "replace(replace(x, '.', ''), ',', '.')"
    return f"[try_cast({plain} as double) for x in {found(body, fv.PRICE, 1)}]"


def plates(body: str) -> str:
    return (
        f"list_sort(list_distinct(list_concat({found(f'upper({body})', fv.PLATE_NEW, 1)}, "
        f"{found(f'upper({body})', fv.PLATE_OLD, 1)})))"
    )


def joined(array: str) -> str:
    """List as text, so that both engines return the same type."""
    return f"array_to_string({array}, '|')"


def only_digits(value: str) -> str:
    return f"regexp_replace({value}, '\\D', '', 'g')"


def mask_cpf(value: str) -> str:
    n = only_digits(value)
    return (
        f"case when length({n}) = 11 then '***.***.' || substr({n}, 7, 3) || '-' || "
        f"substr({n}, 10, 2) when {value} is not null then '***.***.***-**' end"
    )


def mask_email(value: str) -> str:
    user, domain = f"split_part({value}, '@', 1)", f"split_part({value}, '@', 2)"
    return (
        f"case when length({value}) - length(replace({value}, '@', '')) = 1 then "
        f"case when length({user}) <= 2 then repeat('*', length({user})) "
        f"else left({user}, 1) || repeat('*', length({user}) - 2) || right({user}, 1) end "
        f"|| '@' || {domain} when {value} is not null then '***@***.***' end"
    )


def mask_phone(value: str) -> str:
    n = only_digits(value)
    return (
        f"case when length({n}) >= 10 then '(' || left({n}, 2) || ') ****-' || right({n}, 4) "
        f"when {value} is not null then '(**) ****-****' end"
    )


def mask_plate(value: str) -> str:
    c = f"upper(regexp_replace({value}, '[^A-Za-z0-9]', '', 'g'))"
    return (
        f"case when length({c}) = 7 then left({c}, 1) || '**' || substr({c}, 4, 1) || '*' || "
        f"substr({c}, 6, 2) when {value} is not null then '***-****' end"
    )


def keyed_hash(value: str, secret: str = d.HASH_SECRET) -> str:
    key = secret.encode().ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    return (
        f"left(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || "
        f"encode({only_digits(value)})))), 16)"
    )


def replaced(body: str, pattern: str, mask) -> str:
    """Text put together again from the gaps between matches and the masked matches."""
    gaps = f"string_split_regex({body}, {text(pattern)})"
    hits = f"regexp_extract_all({body}, {text(pattern)})"
    rebuilt = (
        f"list_aggregate([g[1] || coalesce({mask('g[2]')}, '') "
        f"for g in list_zip({gaps}, {hits})], 'string_agg', '')"
    )
    return f"case when regexp_matches({body}, {text(pattern)}) then {rebuilt} else {body} end"


def percent(part: str, whole: str) -> str:
    return f"round({part} / cast({whole} as double) * 100, 2)"


def count_if(condition: str) -> str:
    return f"count(*) filter (where {condition})"


KEYS = 'conversation_id, "timestamp", direction, sender_phone, message_body'
NAME = r"trim(regexp_replace(sender_name, '\s+', ' ', 'g'))"
INITCAP = (
    f"array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split({NAME}, ' ')], ' ')"
)
WORDS = "string_split(lower(message_body), ' ')"


def hits(words: tuple[str, ...]) -> str:
    return f"len([w for w in {WORDS} if regexp_matches(w, {text('|'.join(words))})])"


SECONDS = "floor(epoch({}))"
ORDER = '"timestamp", message_id'
DIAGNOSES = dict(d.RAW_DIAGNOSES)


def cost() -> str:
    vendor, name = "lower(trim(coalesce(provider, '')))", "lower(trim(coalesce(model, '')))"
    rows = " ".join(
        f"when {vendor} = {text(p)} and starts_with({name}, {text(m)}) "
        f"then (input_tokens * {i}::double + output_tokens * {o}::double) / 1000000"
        for p, m, i, o in fv.TOKEN_PRICES
    )
    return f"round(case {rows} else 0.0::double end, 6)"


ERROR_HASH = r"sha256(regexp_replace(coalesce(error_message, ''), '^\s+|\s+$', '', 'g'))"

TABLES: dict[str, str] = {
    "bronze": f"select {select_list(d.MESSAGES)} from events, (values (0), (1)) as t(copy)",
    "picked": f"""select * from (select *, row_number() over (partition by {KEYS} order by
        case status when 'read' then 3 when 'delivered' then 2 else 1 end desc, message_id) as rn
        from bronze) where rn = 1""",
    "m": f"""select message_id, conversation_id, cast("timestamp" as timestamp) as "timestamp",
        direction, sender_phone, sender_name, message_type, message_body, status, channel,
        campaign_id, agent_id, conversation_outcome, metadata,
        case when sender_name is null or trim(sender_name) = '' then
            case when direction = 'outbound' then agent_id
            else 'Lead_' || right(conversation_id, 8) end else {INITCAP} end
            as sender_name_normalized,
        json_extract_string(metadata, '$.device') as meta_device,
        json_extract_string(metadata, '$.city') as meta_city,
        json_extract_string(metadata, '$.state') as meta_state,
        try_cast(json_extract_string(metadata, '$.response_time_sec') as integer)
            as meta_response_time_sec,
        try_cast(json_extract_string(metadata, '$.is_business_hours') as boolean)
            as meta_is_business_hours,
        json_extract_string(metadata, '$.lead_source') as meta_lead_source
        from picked""",
    "inb": """select * from m where direction = 'inbound' and message_body is not null""",
    "ent": f"""select *, {found('message_body', fv.CPF, 1)} as cpfs,
        {found('message_body', fv.EMAIL)} as emails, {found('message_body', fv.PHONE)} as phones,
        {plates('message_body')} as plates, {found('message_body', fv.CEP, 1)} as ceps,
        {competitors('message_body')} as competitors, {prices('message_body')} as prices
        from inb where message_body <> ''""",
    "numbered": f"""select *, row_number() over (partition by conversation_id order by {ORDER})
        as place from m""",
    "c": f"""select a.*, f.outcome, f.campaign_id, f.agent_id, f.city, f.state, f.device,
        f.lead_source,
        ({SECONDS.format('a.last_message_at')} - {SECONDS.format('a.first_message_at')}) / 60
            as duration_minutes
        from (select conversation_id, count(*) as total_messages,
            {count_if("direction = 'inbound'")} as inbound_count,
            {count_if("direction = 'outbound'")} as outbound_count,
            min("timestamp") as first_message_at, max("timestamp") as last_message_at,
            avg(meta_response_time_sec) as avg_response_time_sec,
            {count_if('meta_is_business_hours')} as business_hours_messages,
            list_sort(list(distinct message_type)) as message_types_used
            from m group by conversation_id) a
        join (select conversation_id, conversation_outcome as outcome, campaign_id, agent_id,
            meta_city as city, meta_state as state, meta_device as device,
            meta_lead_source as lead_source from numbered where place = 1) f
        using (conversation_id)""",
    "leads": f"""select conversation_id,
        max(len(cpfs)) > 0 as has_cpf, max(len(emails)) > 0 as has_email,
        max(len(plates)) > 0 as has_plate, max(len(competitors)) > 0 as has_competitor,
        min(list_min(prices)) as first_price,
        arg_min(sender_name_normalized, row("timestamp", message_id)) as lead_name,
        arg_min(sender_phone, row("timestamp", message_id)) as lead_phone
        from ent group by conversation_id""",
    "s": f"""select *, case when p + n = 0 then 0.0::double
        else round((p - n) / cast(p + n as double), 3) end as sentiment_score
        from (select conversation_id, cast(sum({hits(fv.POSITIVE_WORDS)}) as bigint) as p,
            cast(sum({hits(fv.NEGATIVE_WORDS)}) as bigint) as n, count(*) as inbound_messages,
            arg_min(conversation_outcome, row("timestamp", message_id)) as any_outcome
            from inb group by conversation_id)""",
    "ls": """select *, case when lead_score >= 70 then 'hot' when lead_score >= 40 then 'warm'
            else 'cold' end as score_tier
        from (select c.*, s.sentiment_score, l.has_cpf, l.has_email, l.has_plate,
            l.has_competitor, least(3 * inbound_count, 30)
            + round((s.sentiment_score + 1) * 10, 0)
            + case when has_cpf then 8 else 0 end + case when has_email then 6 else 0 end
            + case when has_plate then 6 else 0 end
            + case when avg_response_time_sec < 60 then 15 when avg_response_time_sec < 180 then 10
                when avg_response_time_sec < 600 then 5 else 0 end
            + case when business_hours_messages > 0 then 5 else 0 end
            + case when total_messages > 15 then 10 when total_messages > 8 then 5 else 0 end
            as raw_score,
            cast(least(greatest(raw_score, 0), 100) as integer) as lead_score
            from c join s using (conversation_id) left join leads l using (conversation_id))""",
    "pers": """select *, case when total_messages <= 5 and outcome = 'venda_fechada'
            then 'decidido_rapido'
        when has_competitor and outcome in ('perdido_preco', 'perdido_concorrente')
            then 'comparador_preco'
        when total_messages >= 15 and outcome in ('em_negociacao', 'proposta_enviada')
            then 'engajado_indeciso'
        when inbound_count <= 3 and outcome = 'ghosting' then 'ghost'
        when has_cpf and sentiment_score > 0 then 'lead_quente'
        when outcome = 'desistencia_lead' then 'curioso' else 'indefinido' end as persona
        from ls""",
    "gaps": f"""select * from (select *,
            lag("timestamp") over (partition by conversation_id order by {ORDER})
                as prev_timestamp,
            ({SECONDS.format('"timestamp"')} - {SECONDS.format('prev_timestamp')}) / 60
                as gap_minutes
            from m where direction = 'inbound') where gap_minutes > 120""",
    "contacts": """select l.conversation_id, l.lead_phone, c.outcome, c.first_message_at,
        row_number() over (partition by lead_phone order by first_message_at, conversation_id)
            as contact_number,
        count(*) over (partition by lead_phone) as total_contacts
        from leads l join c using (conversation_id)""",
    "fcr": """select *, case when total_wins = 0 then 'no_resolution'
            when total_conversations = 1 then 'first_contact_resolution'
            else 'multi_contact_resolution' end as resolution_type
        from (select lead_phone, count(*) as total_conversations,
            count(*) filter (where outcome = 'venda_fechada') as total_wins,
            min(contact_number) as first_win_contact,
            min(contact_number) filter (where outcome = 'venda_fechada')
                as first_win_contact_number
            from contacts group by lead_phone)""",
    "neg": f"""select *, round(total_questions / cast(total_inbound_messages as double), 3)
            as question_rate
        from (select conversation_id, {count_if("contains(message_body, '?')")} as total_questions,
            {count_if(f"regexp_matches(message_body, {text(fv.PRICE_TOPIC)})")} as price_questions,
            {count_if(f"regexp_matches(message_body, {text(fv.COVERAGE_TOPIC)})")}
                as coverage_questions,
            count(*) as total_inbound_messages,
            arg_min(conversation_outcome, row("timestamp", message_id)) as any_outcome
            from inb group by conversation_id)""",
    "raw_diag": f"select {select_list(d.RAW_DIAGNOSES)} from events",
    "base_diag": f"""select id, "timestamp", job_id, job_name, run_id, failed_task, error_message,
        {ERROR_HASH} as error_hash, confidence, pr_url, pr_number, branch_name, provider, model,
        input_tokens, output_tokens, {cost()} as estimated_cost_usd,
        round(duration_seconds, 3) as duration_seconds, status, pr_kind from raw_diag""",
    "feedback": f"select {select_list(d.FEEDBACK)} from events",
    "diag": """select b.*, f.pr_status, f.resolved_at as pr_resolved_at,
        (floor(epoch(f.resolved_at)) - floor(epoch(b."timestamp"))) / 3600
            as resolution_time_hours,
        case f.pr_status when 'merged' then 'fix_accepted' when 'closed' then 'fix_rejected' end
            as feedback
        from base_diag b left join (select * from feedback where pr_number > 0
            and pr_status in ('merged', 'closed')) f on b.pr_number = f.pr_number""",
    "runs": f"""select {select_list(d.RUNS).replace('{epoch_ms}', 'epoch_us(ts) / 1000')} from events""",
    "deps": f"select {select_list(d.DEPLOYMENTS)} from events",
}


def half_up(sql: str) -> str:
    """SQL whose ``round(x, n)`` works on decimals, and so takes a half up as Spark does."""
    start = sql.find("round(")
    if start < 0:
        return sql
    depth, comma = 0, None
    for end in range(start + len("round"), len(sql)):
        if sql[end] == "(":
            depth += 1
        elif sql[end] == ")":
            depth -= 1
        elif sql[end] == "," and depth == 1:
            comma = end
        if depth == 0:
            break
    if comma is None:
        raise ValueError(f"round without digits: {sql[start:end + 1]}")
    value, digits = sql[start + len("round(") : comma], sql[comma + 1 : end]
    exact = f"cast(rnd(cast({half_up(value)} as decimal(30, 9)),{digits}) as double)"
    return sql[:start] + exact + half_up(sql[end + 1 :])


def with_tables(query: str) -> str:
    """The query behind all table definitions; the engine works out only those it needs."""
    tables = ",\n".join(f"{name} as ({body})" for name, body in TABLES.items())
    return half_up(f"with {tables}\n{query}").replace("rnd(", "round(")
