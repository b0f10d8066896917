"""Queries of the two template pipelines: keyed change capture, shop events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from parlance.operators import commerce
from parlance.sources import incremental
from parlance.streaming import memory, refunds
from parlance.streaming.events import closed_by
from workload import derived as d
from workload.queries import drained, in_slices, query, scratch, table

#: Steps of the checkout; the events of the test table play them.
CHECKOUT = {
    "visit": "event_type = 'view'", "product": "event_type = 'click'",
    "checkout": "event_type = 'signup'", "paid": "event_type = 'purchase'",
}
CHECKOUT_LIMIT = timedelta(hours=36)


def _funnel_sql() -> str:
    """Latest beginning per step by running maxima, row by row; then each user's first completion."""
    limit = f"interval '{int(CHECKOUT_LIMIT.total_seconds())}' second"
    steps = list(CHECKOUT.items())
    whens = " ".join(f"when {c} then {k}" for k, (_, c) in enumerate(steps))
    tables = [f"f0 as (select *, case {whens} end as step, case when {steps[0][1]} then ts end as l0 from events where user_id is not null)"]
    for k in range(1, len(steps)):
        tables.append(
            f"r{k} as (select *, max(l{k - 1}) over (partition by user_id order by ts, event_id "
            f"rows between unbounded preceding and 1 preceding) as s{k} from f{k - 1}), "
            f"f{k} as (select *, case when step = {k} and ts - s{k} <= {limit} then s{k} end as l{k} from r{k})"
        )
    firsts = " union all ".join(
        f"select user_id, {k} as place, arg_min(ts - l{k}, (ts, event_id)) as taken "
        f"from f{len(steps) - 1} where l{k} is not null group by user_id" for k in range(len(steps))
    )
    names = ", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(steps))
    return f"""select * from (with {", ".join(tables)}, firsts as ({firsts}),
    timed as (select place, cast(floor(epoch_us(taken) / 1000000) as bigint) as seconds from firsts),
    ranked as (select *, row_number() over (partition by place order by seconds) as r,
        count(*) over (partition by place) as n from timed),
    found as (select place, max(n) as users, max(seconds) filter (where r = (n + 1) // 2) as median_seconds
        from ranked group by place),
    rows as (select p.place, step, coalesce(users, 0) as users, median_seconds
        from (values {names}) as p(place, step) left join found using (place))
    select place, step, users, median_seconds,
        round(users / (first(users) over w), 6) as of_first, round(users / (lag(users) over w), 6) as of_previous
    from rows window w as (order by place))"""


@query("checkout_funnel", _funnel_sql())
def checkout_funnel(spark, sf_dir):
    times = commerce.step_times(d.events(spark, sf_dir), CHECKOUT, CHECKOUT_LIMIT)
    return commerce.checkout_funnel(times, CHECKOUT)


@query(
    "repurchase_cohort",
    """select * from (with o as (select o_custkey as c, year(o_orderdate) * 12 + month(o_orderdate) - 1 as m from orders
        where o_custkey is not null and o_orderdate is not null),
    firsts as (select c, min(m) as cohort from o group by c),
    seen as (select distinct o.c, cohort, m from o join firsts using (c)),
    sizes as (select cohort, count(*) as cohort_size from firsts group by cohort),
    grid as (select cohort, cohort_size, unnest(range(cohort, (select max(m) + 1 from o))) as m from sizes),
    counts as (select cohort, m, count(*) as active from seen group by all),
    again as (select c, cohort, min(m) as m from seen where m > cohort group by all),
    backs as (select g.cohort, g.m, count(c) as returned from grid g left join again a
        on a.cohort = g.cohort and a.m <= g.m group by all)
    select make_date(cohort // 12, cohort % 12 + 1, 1) as cohort_month, g.m - cohort as month_offset,
        coalesce(active, 0) as active, cohort_size, round(coalesce(active, 0) / cohort_size, 6) as retention, returned
    from grid g left join counts using (cohort, m) join backs using (cohort, m))""",
)
def repurchase_cohort(spark, sf_dir):
    bitmaps = commerce.cohort_bitmaps(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")
    return commerce.cohort_matrix(bitmaps).withColumn("month_offset", F.col("month_offset").cast("long"))


REVENUE = "cast(l_extendedprice as decimal(15, 2)) * (1 - cast(l_discount as decimal(4, 2)))"


@query(
    "product_ltv",
    f"""select * from (with lines as (select l_orderkey as o, sum({REVENUE}) as revenue,
        arg_min(p_brand, (l_linenumber, p_brand)) as product
        from lineitem left join part on l_partkey = p_partkey group by 1),
    priced as (select o_custkey as c, o_orderdate as t, o_orderkey as o,
        year(o_orderdate) * 12 + month(o_orderdate) as m, revenue, product
        from orders left join lines on o_orderkey = o where o_custkey is not null and o_orderdate is not null),
    firsts as (select c, min((t, o)) as k from priced group by c),
    won as (select f.c, p.product, p.m as m0 from firsts f join priced p on p.c = f.c and (p.t, p.o) = f.k),
    cells as (select w.product, p.m - m0 as age, sum(revenue) as revenue, count(distinct p.c) filter (where p.m = m0) as won
        from priced p join won w using (c) group by all),
    ages as (select product, max(age) as oldest, sum(won) as customers from cells group by product),
    grid as (select product, customers, unnest(range(0, oldest + 1)) as age from ages),
    filled as (select g.product, g.age, customers, coalesce(revenue, 0) as revenue from grid g
        left join cells c on g.product is not distinct from c.product and g.age = c.age)
    select product, age, cast(customers as bigint) as customers, round(cast(revenue as double), 6) as revenue,
        round(cast(sum(revenue) over w as double), 6) as cumulative,
        round(cast(sum(revenue) over w as double) / customers, 6) as ltv
    from filled window w as (partition by product order by age))""",
)
def product_ltv(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product"))
    lines = table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left").withColumnsRenamed(
        {"l_orderkey": "order", "l_linenumber": "line"}
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("time")
    )
    value = commerce.lifetime_value(commerce.order_revenue(orders, lines, F.expr(REVENUE)))
    return value.withColumns(
        {"age": F.col("age").cast("long"), "revenue": F.col("revenue").cast("double"), "cumulative": F.col("cumulative").cast("double")}
    )


#: Change capture: an event is a version of its user's state of that kind; some arrive late or twice.
DELETED = "event_id % 7 = 0"
BATCH_ENDS = ("2024-01-11", "2024-01-21", "2024-03-01")
ARRIVAL = "ts + case when event_id % 10 = 3 then interval 10 day else interval 0 day end"


def accounts(spark) -> incremental.KeyedTable:
    return incremental.KeyedTable(
        scratch(spark), "accounts", ("user_id", "event_type"), "ts", DELETED, parts=16,
        lookback=timedelta(days=11),
    )


def loaded(spark, sf_dir):
    """The table after three loads of a growing source, the last of them run twice; with their reports."""
    source, known, reports = d.events(spark, sf_dir), accounts(spark), []
    for end in (*BATCH_ENDS, BATCH_ENDS[-1]):
        arrived = source.where(F.expr(ARRIVAL) < F.lit(end).cast("timestamp"))
        reports.append(incremental.load(arrived, known))
    return known, reports


@query(
    "keyed_load",
    f"""select event_id, ts, user_id, event_type, round(value, 6) as value, props from (
        select *, row_number() over (partition by user_id, event_type order by ts desc, {DELETED} desc, event_id desc) as r
        from events where user_id is not null and event_type is not null and ts is not null)
    where r = 1 and not ({DELETED})""",
)
def keyed_load(spark, sf_dir):
    known, _ = loaded(spark, sf_dir)
    return incremental.current(spark, known).select(d.events(spark, sf_dir).columns)


@query(
    "keyed_load_report",
    f"""select * from (with a as (select *, ts + case when event_id % 10 = 3 then interval 10 day else interval 0 day end as arrived from events),
    ends as (select * from (values (1, timestamp '2024-01-11'), (2, timestamp '2024-01-21'), (3, timestamp '2024-03-01'), (4, timestamp '2024-03-01')) as t(batch, until)),
    marks as (select batch, until, (select max(ts) from a where arrived < until) as mark from ends),
    bounds as (select *, lag(mark) over (order by batch) - interval 11 day as low from marks),
    reads as (select batch, count(*) as read from bounds join a on arrived < until and (low is null or ts >= low) group by batch),
    states as (select batch, user_id, event_type, arg_max({DELETED}, (ts, {DELETED}, event_id)) as gone,
        arg_max(event_id, (ts, {DELETED}, event_id)) as id from ends join a on arrived < until group by all),
    steps as (select *, lag(id) over w as was, lag(gone) over w as was_gone from states
        window w as (partition by user_id, event_type order by batch))
    select batch, max(read) as read,
        count(*) filter (where id is distinct from was and not gone and coalesce(was_gone, true)) as inserted,
        count(*) filter (where id is distinct from was and not gone and not was_gone) as changed,
        count(*) filter (where id is distinct from was and gone and not was_gone) as deleted
    from steps join reads using (batch) group by batch)""",
)
def keyed_load_report(spark, sf_dir):
    _, reports = loaded(spark, sf_dir)
    numbered = [r.withColumn("batch", F.lit(k)) for k, r in enumerate(reports, 1)]
    whole = numbered[0]
    for r in numbered[1:]:
        whole = whole.unionByName(r)
    return whole.select("batch", "read", "inserted", "changed", "deleted")


#: Refunds follow their purchase by up to 30 hours, some exactly at the limit; some come twice.
REFUNDED = "event_type = 'purchase' and event_id % 3 <> 1"
REFUND_MINUTES = "event_id % 61 * 30"


def _end_marker(spark, schema: str, values: tuple):
    """A stream without rows, and what adds one row that lies behind all others."""
    folder = scratch(spark)
    row = spark.createDataFrame([values], schema)
    row.limit(0).write.parquet(folder)
    return spark.readStream.schema(row.schema).parquet(folder), lambda: row.write.mode("append").parquet(folder)


def refund_stream(spark, sf_dir):
    """The rates as a stream, and what closes both of its sources: a purchase and a refund two weeks
    behind the last event, which let all before them out and stay open themselves."""
    events = d.events(spark, sf_dir)
    last = events.agg(F.max("ts") + F.expr("interval 14 day")).first()[0]
    bought = events.where("event_type = 'purchase'").select(
        F.col("event_id").alias("order_id"), F.col("ts").cast("timestamp").alias("purchased_at")
    )
    back = events.where(REFUNDED).select(
        F.col("event_id").alias("order_id"),
        (F.col("ts").cast("timestamp") + F.expr(f"make_dt_interval(0, 0, cast({REFUND_MINUTES} as int))")).alias("refunded_at"),
    )
    back = back.unionByName(back.where("order_id % 2 = 0"))
    ends = [
        _end_marker(spark, f"order_id long, {c} timestamp", (-1 - k, last)) for k, c in enumerate(("purchased_at", "refunded_at"))
    ]
    streams = [
        closed_by(in_slices(bought, "purchased_at"), ends[0][0]), closed_by(in_slices(back, "refunded_at"), ends[1][0])
    ]
    rates = refunds.refund_rates(
        # the files of the two sides are read side by side, eight days at a time
        refunds.with_refund(*streams, late="9 days", late_refunds="9 days"), "24 hours", "6 hours"
    )
    return rates, lambda: [add() for _, add in ends]


@query(
    "stream_refund_rate",
    f"""select window_start, window_start + interval 24 hour as window_end, count(*) as purchases,
        count(*) filter (where refunded) as refunded, round(count(*) filter (where refunded) / count(*), 6) as refund_rate
    from (select event_id, time_bucket(interval 6 hour, ts, timestamp '2000-01-01') - to_hours(6 * h) as window_start,
            {REFUNDED} and {REFUND_MINUTES} <= 24 * 60 as refunded
        from events, (values (0), (1), (2), (3)) as t(h) where event_type = 'purchase')
    group by window_start having count(*) filter (where refunded) * 100.0 / count(*) > 5""",
)
def stream_refund_rate(spark, sf_dir):
    rates, close = refund_stream(spark, sf_dir)
    return drained(refunds.refund_alerts(rates), close)


@query(
    "stream_dedup_renewed",
    """select id, ts as received_at from (select *, lag(ts) over (partition by id order by ts) as last
        from (select user_id || '-' || event_type as id, ts from events))
    where last is null or ts > last + interval 24 hour""",
)
def stream_dedup_renewed(spark, sf_dir):
    arrivals = d.events(spark, sf_dir).select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("id"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )
    return drained(memory.dedup_renewed(in_slices(arrivals, "received_at"), time="received_at"))
