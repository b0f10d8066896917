import pytest
from pyspark.sql import functions as F

from parlance.operators import quality


def tables(spark, **changed):
    base = {
        "bronze": spark.range(3000).withColumn("conversation_id", F.lit("c")),
        "messages": spark.range(1500).withColumn("message_body", F.lit("oi")),
        "conversations": spark.range(5),
        "leads_profile": spark.sql(
            "select 1 as cpf_masked, 1 as email_masked, 1 as phone_masked, 1 as plate_masked"
        ),
        **{name: spark.range(1) for name in quality.GOLD_TABLES},
        "lead_scoring": spark.sql("select 0 as lead_score union all select 100"),
        "sentiment": spark.sql("select -1.0D as sentiment_score union all select 1.0D"),
    }
    return {**base, **changed}


def failed(spark, expected_columns=None, **changed):
    checks = quality.run_checks(tables(spark, **changed), expected_columns=expected_columns)
    return {r["check"] for r in checks.collect() if r["passed"] is False}


def test_all_pass(spark):
    assert failed(spark) == set()
    quality.require_pass(quality.run_checks(tables(spark)))


def test_failures(spark):
    empty = spark.range(0)
    assert failed(spark, personas=empty) == {"personas_not_empty"}
    assert failed(spark, personas=None) == {"personas_exists"}
    assert failed(spark, lead_scoring=spark.sql("select 101 as lead_score")) == {"lead_score_range"}
    assert failed(spark, sentiment=spark.sql("select -1.5D as sentiment_score")) == {"sentiment_range"}
    few = spark.range(999).withColumn("message_body", F.lit("oi"))
    assert failed(spark, messages=few) == {"silver_volume"}
    clear = few.unionAll(
        spark.range(1000).withColumn("message_body", F.lit("cpf 123.456.789-09"))
    )
    assert failed(spark, messages=clear) == {"clear_cpf"}
    nulls = spark.range(3000).withColumn("conversation_id", F.lit(None).cast("string"))
    assert failed(spark, bronze=nulls) == {"bronze_conversation_id"}
    same = spark.range(1500).withColumn("conversation_id", F.lit("c"))
    assert failed(spark, bronze=same) == {"dedup_effect"}
    many = spark.range(60_000).withColumn("conversation_id", F.lit("c"))
    assert failed(spark, bronze=many) == {"silver_ratio_warning"}
    more = spark.range(200_000).withColumn("conversation_id", F.lit("c"))
    assert failed(spark, bronze=more) == {"silver_ratio_error"}
    profile = spark.sql("select 1 as cpf_masked")
    assert failed(spark, leads_profile=profile) == {"masked_columns"}
    assert failed(spark, {"conversations": ["x"]}) == {"conversations_unexpected_columns"}


def test_observed_numbers_equal_scanned_ones(spark, tmp_path):
    watches = {}
    for name, df in tables(spark).items():
        seen, watches[name] = quality.observed(df.repartition(3), name)
        seen.write.parquet(str(tmp_path / name))
    got = {r["metric"]: r["value"] for r in quality.numbers_of(spark, watches).collect()}
    assert got == {r["metric"]: r["value"] for r in quality.measure_all(tables(spark)).collect()}
    checks = quality.run_checks(tables(spark), numbers=quality.numbers_of(spark, watches))
    assert checks.collect() == quality.run_checks(tables(spark)).collect()


def test_numbers_come_without_a_scan(spark, tmp_path):
    """The gate reads no table: all its jobs are done before the tables are gone."""
    import shutil

    seen, watch = quality.observed(spark.range(5), "conversations")
    seen.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    shutil.rmtree(tmp_path / "t")
    checks = quality.run_checks({"conversations": stored}, numbers=quality.numbers_of(spark, {"conversations": watch}))
    assert {r["check"]: r["passed"] for r in checks.collect()}["conversations_exists"]


def test_verdict(spark):
    checks = quality.run_checks(tables(spark, personas=None, campaign_geo=spark.range(0)))
    row = quality.verdict(checks).first()
    assert tuple(row) == (
        "FAIL", ["personas_exists"], ["campaign_geo_not_empty"], ["personas_not_empty"]
    )
    with pytest.raises(ValueError, match="personas_exists"):
        quality.require_pass(checks)
    with pytest.raises(ValueError):
        quality.run_checks({"bronze": None})


def test_zero_denominators(spark):
    df = spark.sql("select explode(array(0, 1, null)) as n")
    assert tuple(quality.zero_denominators(df, "n").first()) == (1, 1)
