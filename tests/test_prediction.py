from pyspark.sql import functions as F

from parlance.operators import prediction


def planted(spark):
    """The outcome follows the number of early questions and the device."""
    df = spark.range(900).withColumn("noise", F.pmod(F.xxhash64("id"), F.lit(7)))
    outcome = (
        F.when(F.col("id") % 50 == 0, None)
        .when(F.col("id") % 3 == 0, "venda_fechada")
        .when(F.col("id") % 3 == 1, "ghosting")
        .otherwise("perdido_preco")
    )
    return df.select(
        F.concat(F.lit("c"), "id").alias("conversation_id"),
        F.col("noise").cast("int").alias("contact_hour"),
        F.lit(1).alias("contact_dow"),
        F.col("noise").cast("double").alias("avg_msg_length"),
        F.lit(2).cast("bigint").alias("early_inbound_count"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.lit(0)).cast("bigint").alias("early_questions"),
        F.lit(None).cast("int").alias("first_response_time"),
        F.lit(1).alias("is_business_hours"),
        outcome.alias("outcome"),
        F.lit(None).cast("string").alias("lead_source"),
        F.when(F.col("id") % 3 == 1, "web").otherwise("android").alias("device"),
    )


def test_planted_signal(spark):
    fitted = prediction.fit_outcome_model(planted(spark), iterations=30)
    predictions = fitted.predictions.collect()
    assert len(predictions) == 900
    assert all(1 / 3 <= r["prediction_proba_max"] <= 1 for r in predictions)
    assert {r["correct"] for r in predictions if r["outcome"] is None} == {None}
    metrics = fitted.metrics.first()
    assert metrics["accuracy"] > 0.95
    assert metrics["train_size"] + metrics["test_size"] == 900 - 18
    assert 0.7 < metrics["train_size"] / 882 < 0.9
    report = prediction.classification_report(fitted.test_predictions).collect()
    assert sum(r["support"] for r in report) == metrics["test_size"]
    assert all(r["f1"] > 0.9 for r in report)


def test_a_million_values_of_a_category(spark):
    """The driver holds the most frequent ones only; every row gets a prediction."""
    df = planted(spark)
    rare = spark.range(1_000_000).select(
        F.concat(F.lit("x"), "id").alias("conversation_id"), *[F.lit(1).alias(c) for c in ("contact_hour", "contact_dow")],
        F.lit(1.0).alias("avg_msg_length"), F.lit(1).cast("bigint").alias("early_inbound_count"),
        F.lit(5).cast("bigint").alias("early_questions"), F.lit(1).alias("first_response_time"),
        F.lit(1).alias("is_business_hours"), F.when(F.col("id") % 1000 == 0, F.concat(F.lit("o"), "id")).alias("outcome"),
        F.concat(F.lit("source "), "id").alias("lead_source"), F.lit("web").alias("device"),
    )
    fitted = prediction.fit_outcome_model(df.unionByName(rare), iterations=3)
    assert len(fitted.categories["lead_source"]) == prediction.MOST_CATEGORIES
    assert len(fitted.labels) == prediction.MOST_OUTCOMES and set(fitted.labels[:3]) == {"ghosting", "perdido_preco", "venda_fechada"}
    assert fitted.predictions.where("predicted_outcome is null").count() == 0
    assert fitted.predictions.count() == 1_000_900


def test_split_is_md5(spark):
    import hashlib

    keys = [f"conv_{i}" for i in range(300)] + [None]
    df = spark.createDataFrame([(k,) for k in keys], "conversation_id string")
    got = {r["conversation_id"]: r["t"] for r in df.withColumn("t", prediction.in_training(42)).collect()}
    want = {k: int(hashlib.md5(f"{k}:42".encode()).hexdigest()[:8], 16) % 10_000 < 8000 for k in keys if k}
    assert got == {**want, None: False} and 0.7 < sum(want.values()) / 300 < 0.9


def test_history_has_every_fit(spark, tmp_path):
    name = "fits_of_test"
    spark.sql(f"drop table if exists {name}")
    for iterations in (2, 3):
        prediction.record_fit(prediction.fit_outcome_model(planted(spark), iterations=iterations), name, str(tmp_path / "h"))
    fits = prediction.fit_history(spark, name)
    assert fits.count() == 2 and fits.select("train_size").distinct().count() == 1
    spark.sql(f"drop table {name}")


def test_report(spark):
    df = spark.sql(
        """select * from values ('a', 'a'), ('a', 'b'), ('b', 'b'), ('c', 'b')
        as t(outcome, predicted_outcome)"""
    )
    found = {r["class"]: tuple(round(x, 3) for x in tuple(r)[1:]) for r in
             prediction.classification_report(df).collect()}
    assert found == {"a": (1.0, 0.5, 0.667, 2), "b": (0.333, 1.0, 0.5, 1), "c": (0.0, 0.0, 0.0, 1)}
