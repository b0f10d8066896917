"""The forms that spread a hot key give what the plain windows and joins give."""

import random
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import contacts, funnel, ranking, silence
from parlance.operators.conversations import minutes_between

SCHEMA = (
    "conversation_id string, timestamp timestamp, message_id string, direction string, "
    "message_body string, conversation_outcome string"
)


def chats(spark, seed=3, size=1500):
    """A third of the messages in one conversation, a part without one; many equal times."""
    numbers = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(size):
        conversation = numbers.choice(["hot", f"c{numbers.randrange(40)}", None, f"d{i % 25}"])
        minute = numbers.choice([120 * numbers.randrange(60), numbers.randrange(9000)])
        rows.append(
            (
                conversation, start + timedelta(minutes=minute), f"m{i:05d}",
                numbers.choice(["inbound", "outbound"]), f"body {i}",
                numbers.choice(["ghosting", "venda_fechada"]),
            )
        )
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_gaps(df, minutes):
    order = Window.partitionBy("conversation_id").orderBy("timestamp", "message_id")
    inbound = df.filter("direction = 'inbound'").withColumn(
        "prev_timestamp", F.lag("timestamp").over(order)
    )
    gap = minutes_between(F.col("prev_timestamp"), F.col("timestamp"))
    return inbound.withColumn("gap_minutes", gap).filter(F.col("gap_minutes") > minutes)


def test_gaps_equal_lag(spark):
    df = chats(spark)
    for minutes in (5, 120, 121, 700):
        got = silence.silence_gaps(df, minutes)
        want = plain_gaps(df, minutes).select(got.columns)
        assert want.count() > 0
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_gap_of_exactly_the_limit_is_none(spark):
    start = datetime(2024, 1, 1, 1)
    rows = [("c", start + timedelta(minutes=m), f"m{m}", "inbound", "", "x") for m in (0, 120, 241)]
    gaps = silence.silence_gaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [g["gap_minutes"] for g in gaps] == [121.0]


def test_reactivation_equals_interval_join(spark):
    df = chats(spark, seed=11)
    for minutes in (30, 120):
        gaps = plain_gaps(df, minutes).alias("g")
        out = df.filter("direction = 'outbound'").alias("o")
        joined = gaps.join(
            out,
            F.col("g.conversation_id").eqNullSafe(F.col("o.conversation_id"))
            & (F.col("o.timestamp") < F.col("g.timestamp"))
            & (F.col("o.timestamp") > F.col("g.prev_timestamp")),
        ).select("g.*", F.col("o.timestamp").alias("ot"), F.col("o.message_id").alias("oid"))
        last = Window.partitionBy("conversation_id", "timestamp").orderBy(
            F.col("ot").desc(), F.col("oid").desc()
        )
        want = joined.withColumn("rn", F.row_number().over(last)).filter("rn = 1")
        want = want.select("conversation_id", "timestamp", "ot", "oid")
        got = silence.reactivation_messages(df, minutes).select(
            "conversation_id", "timestamp", "out_timestamp", "out_message_id"
        )
        assert want.count() > 0
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_last_position_equals_row_number(spark):
    df = chats(spark, seed=7)
    order = Window.partitionBy("conversation_id").orderBy("timestamp", "message_id")
    want = (
        df.withColumn("n", F.row_number().over(order))
        .filter("direction = 'inbound'")
        .groupBy("conversation_id")
        .agg(F.max("n").cast("bigint").alias("n"))
    )
    got = funnel.last_inbound_position(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_numbered_contacts_equal_row_number(spark):
    numbers = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [
        (f"c{i}", numbers.choice(["hot", None, f"p{i % 30}"]),
         start + timedelta(hours=numbers.randrange(300)), numbers.choice(["venda_fechada", None]))
        for i in range(600)
    ]
    facts = spark.createDataFrame(
        rows, "conversation_id string, lead_phone string, first_message_at timestamp, outcome string"
    ).repartition(4)
    got = contacts.numbered_contacts(facts)
    order = Window.partitionBy("lead_phone").orderBy("first_message_at", "conversation_id")
    want = facts.select(
        "conversation_id",
        F.row_number().over(order).cast("bigint").alias("contact_number"),
        F.count("*").over(Window.partitionBy("lead_phone")).alias("total_contacts"),
    )
    got = got.select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ranges_are_even_for_a_hot_key(spark):
    """A phone with a third of all contacts, all in one second: no range above twice the median."""
    hot = F.col("id") % 3 == 0
    contacts_ = spark.range(200_000).select(
        F.concat(F.lit("c"), F.col("id")).alias("conversation_id"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5000)).alias("lead_phone"),
        F.when(hot, F.lit("2024-01-01 10:00:00")).otherwise("2024-01-02 00:00:00").cast("timestamp").alias("first_message_at"),
    )
    ranged = ranking.in_ranges(contacts_, ["lead_phone", "first_message_at", "conversation_id"])
    sizes = sorted(r["count"] for r in ranged.groupBy("_range").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert ranged.where("lead_phone = 'hot'").select("_range").distinct().count() > 1
    numbered = contacts.numbered_contacts(contacts_.withColumn("outcome", F.lit(None).cast("string")))
    found = numbered.where("lead_phone = 'hot'").agg(
        F.min("contact_number"), F.max("contact_number"), F.count_distinct("contact_number"), F.max("total_contacts")
    )
    assert tuple(found.first()) == (1, 66_667, 66_667, 66_667)


def test_percent_ranks_of_one_value_and_many_rows(spark):
    """Half of all rows share a value; the others are close together."""
    df = spark.range(20_000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(1 + F.col("id") / 1e9).alias("x")
    )
    got = ranking.percent_ranks(df, "k", {"r": ("x", False)})
    want = df.withColumn("r", F.round(F.percent_rank().over(Window.orderBy("x")) * 100, 0))
    assert sorted(got.collect()) == sorted(want.collect())


def test_percent_ranks_equal_window(spark):
    numbers = random.Random(2)
    rows = [
        (f"a{i}", numbers.choice([None, 12.5, 50.0, round(numbers.random() * 90, 2)]),
         numbers.choice([None, 0.0, -3.25, numbers.random() * 500]))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = ranking.percent_ranks(df, "k", {"rx": ("x", False), "ry": ("y", True)})
    want = df.withColumns(
        {
            "rx": F.round(F.percent_rank().over(Window.orderBy("x")) * 100, 0),
            "ry": F.round(F.percent_rank().over(Window.orderBy(F.col("y").desc())) * 100, 0),
        }
    )
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    single = ranking.percent_ranks(df.limit(1), "k", {"rx": ("x", False)}).first()
    assert single["rx"] == 0.0
