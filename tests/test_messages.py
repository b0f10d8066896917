import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import contract, messages
from parlance.sources import tables
from parlance.sources.tables import RAW_MESSAGE_SCHEMA


def raw(spark, *rows):
    """Raw messages from partial dicts."""
    blank = dict.fromkeys(RAW_MESSAGE_SCHEMA.names)
    full = [{**blank, **row} for row in rows]
    return spark.createDataFrame(
        [tuple(r[n] for n in RAW_MESSAGE_SCHEMA.names) for r in full], RAW_MESSAGE_SCHEMA
    )


def test_dedup_takes_the_furthest_delivery(spark):
    base = {"conversation_id": "c", "timestamp": "t", "direction": "inbound", "message_body": "b"}
    df = raw(
        spark,
        {**base, "message_id": "3", "status": "sent"},
        {**base, "message_id": "2", "status": "read"},
        {**base, "message_id": "1", "status": "read"},
        {**base, "message_id": "0", "status": "delivered"},
        {**base, "message_id": "9", "status": "failed", "message_body": None},
        {**base, "message_id": "8", "status": "sent", "message_body": None},
    )
    kept = messages.dedup_messages(df.repartition(3)).collect()
    assert sorted(r["message_id"] for r in kept) == ["1", "8"]
    counts = messages.removed_rows(df).first()
    assert tuple(counts) == (6, 2, 4)


def test_one_message_with_most_copies(spark):
    copies = spark.range(20_000).select(
        F.col("id").cast("string").alias("message_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("b"),
    )
    df = raw(spark).unionByName(
        copies.select(
            "message_id", F.lit("c").alias("conversation_id"), F.lit("t").alias("timestamp"),
            F.col("b").alias("message_body"), F.lit("read").alias("status"),
        ),
        allowMissingColumns=True,
    )
    kept = messages.dedup_messages(df)
    assert kept.count() == df.select("message_body").distinct().count()
    assert kept.filter("message_body = 'hot'").first()["message_id"] == "0"


def test_names(spark):
    df = raw(
        spark,
        {"message_id": "1", "sender_name": "  maria   DA silva "},
        {"message_id": "2", "sender_name": " ", "direction": "outbound", "agent_id": "agent_7"},
        {"message_id": "3", "direction": "inbound", "conversation_id": "conv_0123abcd"},
    )
    named = {r["message_id"]: r["sender_name_normalized"] for r in messages.normalise_names(df).collect()}
    assert named == {"1": "Maria Da Silva", "2": "agent_7", "3": "Lead_0123abcd"}


def test_metadata_and_time(spark):
    good = '{"device": "web", "response_time_sec": 12, "is_business_hours": true, "city": null}'
    df = raw(
        spark,
        {"message_id": "1", "metadata": good, "timestamp": "2026-01-01T10:00:00"},
        {"message_id": "2", "metadata": '{"response_time_sec": "x", "is_business_hours": "talvez"}',
         "timestamp": "2026-01-01 10:00:00.5"},
        {"message_id": "3", "metadata": "{broken", "timestamp": "zz"},
    )
    rows = {r["message_id"]: r for r in messages.clean_messages(df).collect()}
    assert rows["1"]["meta_response_time_sec"] == 12 and rows["1"]["meta_is_business_hours"] is True
    assert rows["1"]["meta_device"] == "web" and rows["1"]["meta_city"] is None
    assert rows["2"]["meta_response_time_sec"] is None and rows["2"]["meta_is_business_hours"] is None
    assert rows["3"]["meta_device"] is None and rows["3"]["timestamp"] is None
    assert rows["2"]["timestamp"].microsecond == 500_000 and rows["1"]["timestamp"].hour == 10


def test_conform(spark):
    schema = T.StructType().add("a", "string").add("b", "long").add("c", "double")
    df = spark.sql("select 1 as _chaos_x, 'x' as b, 'y' as a")
    same = contract.conform(df, schema)
    assert same.columns == ["a", "b", "c"] and tuple(same.first()) == ("y", "x", None)
    assert dict(same.dtypes)["c"] == "double"
    cast = contract.conform(df, schema, cast=True)
    assert tuple(cast.first()) == ("y", None, None) and dict(cast.dtypes)["b"] == "bigint"


def test_validate_columns(spark):
    df = raw(spark)
    assert contract.validate_columns(df).first()["is_valid"]
    row = contract.validate_columns(df.drop("status", "channel").withColumn("z", F.lit(1))).first()
    assert (row["is_valid"], row["missing"], row["extra"]) == (False, ["channel", "status"], ["z"])


def test_value_violations(spark):
    df = raw(
        spark,
        {"conversation_id": "conv_0123abcd", "direction": "inbound", "status": "lost"},
        {"conversation_id": "conv_XYZ", "direction": "up"},
    )
    found = {r["column_name"]: r["violations"] for r in contract.value_violations(df).collect()}
    assert found == {"conversation_id": 1, "direction": 1, "message_type": 0, "status": 1, "channel": 0}


def test_result_does_not_depend_on_partitions(spark):
    numbers = random.Random(5)
    rows = [
        {"message_id": str(i), "conversation_id": f"c{numbers.randrange(5)}", "timestamp": "t",
         "message_body": str(numbers.randrange(9)), "status": numbers.choice(["read", "sent"])}
        for i in range(300)
    ]
    df = raw(spark, *rows)
    one = sorted(messages.clean_messages(df.repartition(1)).collect())
    many = sorted(messages.clean_messages(df.repartition(7)).collect())
    assert one == many


def test_append_and_overwrite(spark):
    df = spark.sql("select 1 as a, 'x' as b")
    tables.append_table(df, "t_append")
    tables.append_table(df, "t_append")
    assert spark.table("t_append").count() == 2
    with pytest.raises(ValueError):
        tables.append_table(df.withColumn("c", F.lit(1)), "t_append")
    tables.overwrite_table(df, "t_over")
    merged = tables.overwrite_table(spark.sql("select 2 as a, 3 as c"), "t_over")
    assert tuple(merged.select("a", "b", "c").first()) == (2, None, 3)
    replaced = tables.overwrite_table(spark.sql("select 4 as z"), "t_over", replace_schema=True)
    assert replaced.columns == ["z"]


def test_files(spark, tmp_path):
    df = spark.range(10).withColumn("name", F.lit("ação"))
    path = str(tmp_path / "t")
    tables.write_parquet(df, path)
    assert tables.read_parquet(spark, path + "/", df.schema).count() == 10
    tables.write_parquet(df.withColumn("new", F.lit(1)), str(tmp_path / "m" / "k=2"))
    tables.write_parquet(df, str(tmp_path / "m" / "k=1"))
    both = tables.read_parquet(spark, str(tmp_path / "m"), merge_schema=True)
    assert both.filter("new is null").count() == 10 and both.count() == 20
    listed = tables.file_inventory(spark, path).collect()
    assert listed and all(r["size_bytes"] >= 0 for r in listed)
    tables.export_sample(df, 3, "csv", str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    tables.export_sample(df, 3, "parquet", str(tmp_path / "pq"))
    assert dict(spark.read.parquet(str(tmp_path / "pq")).dtypes) == {"id": "string", "name": "string"}
    tables.export_sample(df.limit(0), 3, "csv", str(tmp_path / "none"))
    with pytest.raises(ValueError):
        tables.export_sample(df, 3, "xlsx", str(tmp_path / "x"))
    with pytest.raises(Exception):
        tables.row_count(spark.table("no_such_table"))


def test_union_layouts(spark):
    both = tables.union_layouts(spark.sql("select 1 as a"), spark.sql("select 2 as a, 3 as b"))
    assert sorted(map(tuple, both.collect())) == [(1, None), (2, 3)]
