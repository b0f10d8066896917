"""Outcome prediction from the first messages of a conversation."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.operators.conversations import count_where
from parlance.operators.messages import message_order
from parlance.sources.tables import append_table, read_table

#: Different values of a category, and of the outcome, that a model tells apart; the rest are one.
MOST_CATEGORIES, MOST_OUTCOMES = 64, 32
MODEL_VERSION = "logistic_regression_v1"
FEATURES = (
    "contact_hour", "contact_dow", "avg_msg_length", "early_inbound_count", "early_questions",
    "first_response_time", "is_business_hours", "lead_source_enc", "device_enc",
)


def early_features(messages: DataFrame, k: int = 3) -> DataFrame:
    """Features of the first ``k`` messages, with outcome, lead source and device of the first.

    The row-number filter keeps k rows per conversation and task before the shuffle. Messages
    without a conversation are left out.
    """
    first = Window.partitionBy("conversation_id").orderBy(
        F.col("timestamp").asc_nulls_last(), "message_id"
    )
    early = (
        messages.filter(F.col("conversation_id").isNotNull())
        .select(
            "conversation_id", "timestamp", "message_id", "message_body", "direction",
            "meta_response_time_sec", "meta_is_business_hours", "conversation_outcome",
            "meta_lead_source", "meta_device",
        )
        .withColumn("_place", F.row_number().over(first))
        .filter(F.col("_place") <= k)
    )
    body = F.col("message_body")
    of_first = {
        "outcome": "conversation_outcome", "lead_source": "meta_lead_source", "device": "meta_device",
    }
    return early.groupBy("conversation_id").agg(
        F.hour(F.min("timestamp")).alias("contact_hour"),
        F.dayofweek(F.min("timestamp")).alias("contact_dow"),
        F.avg(F.length(body)).alias("avg_msg_length"),
        count_where(F.col("direction") == "inbound").alias("early_inbound_count"),
        count_where(body.contains("?")).alias("early_questions"),
        F.min_by("meta_response_time_sec", message_order()).alias("first_response_time"),
        F.min_by("meta_is_business_hours", message_order()).cast("int").alias(
            "is_business_hours"
        ),
        *[F.min_by(F.struct(c), message_order())[c].alias(n) for n, c in of_first.items()],
    )


@dataclass(frozen=True)
class OutcomeModel:
    """Fitted model with its predictions for all conversations and its quality on the test part.

    ``labels`` are the outcomes it can predict, ``categories`` the values it knows of each category,
    most frequent first; a value's place is its number, and all others share the number behind them.
    """

    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    test_predictions: DataFrame
    labels: list[str]
    categories: dict[str, list[str]]


def in_training(seed: int, share: float = 0.8) -> Column:
    """Split by a hash of the key: the same rows on every run, on every engine that has MD5, and when
    a task is repeated."""
    digest = F.md5(F.concat(F.col("conversation_id"), F.lit(f":{seed}")).cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10_000
    return F.coalesce(bucket < int(share * 10_000), F.lit(False))


def frequent_values(df: DataFrame, column: str, most: int) -> list[str]:
    """The ``most`` most frequent values, then by value. Counts are added up before the shuffle and
    each task keeps its first ``most``, so no more than that reach the driver, however many there are."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return [r[column] for r in counts.orderBy(F.desc("n"), column).limit(most).collect()]


def place_of(column: str, values: list[str]) -> Column:
    """Number of a value: its place in the list, or the list's length for every other one."""
    known = F.array(*[F.lit(v) for v in values]).cast("array<string>")
    place = F.array_position(known, F.col(column)) if values else F.lit(0)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(values))).cast("double")


def fit_outcome_model(features: DataFrame, seed: int = 42, iterations: int = 100) -> OutcomeModel:
    """Multinomial logistic regression of the outcome on the early features.

    Missing categories count as ``unknown``, missing numbers as 0. Conversations without an
    outcome are not learned from, but get a prediction; so are those with an outcome beyond the
    MOST_OUTCOMES most frequent ones. Values of a category beyond the MOST_CATEGORIES most frequent
    ones of the training part share one number.
    """
    ready = features.withColumns(
        {
            "lead_source": F.coalesce("lead_source", F.lit("unknown")),
            "device": F.coalesce("device", F.lit("unknown")),
        }
    ).fillna(0, subset=[c for c in FEATURES if not c.endswith("_enc")])
    training = ready.filter(F.col("outcome").isNotNull() & in_training(seed))
    labels = frequent_values(training, "outcome", MOST_OUTCOMES)
    categories = {c: frequent_values(training, c, MOST_CATEGORIES) for c in ("lead_source", "device")}
    ready = ready.withColumns({f"{c}_enc": place_of(c, values) for c, values in categories.items()})
    labelled = ready.filter(F.col("outcome").isNotNull()).withColumn("label", place_of("outcome", labels))
    train = labelled.filter(in_training(seed)).persist()
    test = labelled.filter(~in_training(seed))
    stages = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="features"),
            LogisticRegression(family="multinomial", maxIter=iterations),
        ]
    )
    model = stages.fit(train.filter(F.col("label") < len(labels)))
    train_size = train.count()
    train.unpersist()

    known = F.array(*[F.lit(v) for v in labels])
    predicted = known[F.col("prediction").cast("int")].alias("predicted_outcome")

    def transformed(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("predicted_outcome", predicted)

    tested = transformed(test)
    accuracy = round(
        MulticlassClassificationEvaluator(metricName="accuracy").evaluate(tested), 3
    )
    correct = F.col("outcome") == F.col("predicted_outcome")
    predictions = transformed(ready).select(
        "conversation_id",
        "outcome",
        "predicted_outcome",
        F.array_max(vector_to_array("probability")).alias("prediction_proba_max"),
        correct.cast("int").alias("correct"),
        F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(accuracy).alias("model_accuracy"),
    )
    metrics = test.agg(F.count(F.lit(1)).alias("test_size")).select(
        F.lit(MODEL_VERSION).alias("model"),
        F.lit(accuracy).alias("accuracy"),
        F.lit(json.dumps(FEATURES)).alias("features"),
        F.lit(train_size).cast("bigint").alias("train_size"),
        "test_size",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    return OutcomeModel(
        model, predictions, metrics, tested.select("outcome", "predicted_outcome"), labels, categories
    )


def record_fit(fit: OutcomeModel, table: str, path: str | None = None) -> None:
    """Appends the metrics of a fit to the history table, which is created if it is absent."""
    append_table(fit.metrics, table, path)


def fit_history(spark: SparkSession, table: str) -> DataFrame:
    """All fits on record, by the name of the table."""
    return read_table(spark, table)


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from the counts of (outcome, prediction)."""
    pairs = predictions.groupBy("outcome", "predicted_outcome").agg(
        F.count(F.lit(1)).alias("rows")
    )
    hit = F.col("outcome") == F.col("predicted_outcome")
    # each pair counts once for its outcome (support) and once for its prediction
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("outcome").alias("class"),
                    F.when(hit, F.col("rows")).otherwise(0).alias("right"),
                    F.col("rows").alias("actual"),
                    F.lit(0).cast("bigint").alias("predicted"),
                ),
                F.struct(
                    F.col("predicted_outcome").alias("class"),
                    F.lit(0).cast("bigint").alias("right"),
                    F.lit(0).cast("bigint").alias("actual"),
                    F.col("rows").alias("predicted"),
                ),
            )
        )
    )
    totals = (
        sides.filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.sum("right").alias("right"),
            F.sum("actual").alias("support"),
            F.sum("predicted").alias("predicted"),
        )
    )
    precision = F.coalesce(F.try_divide("right", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("right", "support"), F.lit(0.0))
    f1 = F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        F.lit(0.0),
    )
    return (
        totals.withColumns({"precision": precision, "recall": recall})
        .withColumn("f1", f1)
        .select("class", "precision", "recall", "f1", "support")
    )
