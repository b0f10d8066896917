"""Sentiment of the lead per conversation, by keywords or by a supplied model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv
from parlance.operators.conversations import count_where
from parlance.operators.messages import has_inbound_text, inbound_text, message_order, with_lower

MODEL_LABELS = {"POS": "positivo", "NEG": "negativo", "NEU": "neutro"}


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.2, "positivo").when(score < -0.2, "negativo").otherwise("neutro")


def keyword_hits(lower: Column, words: Sequence[str], phrase: bool = False) -> Column:
    """Words of the lower-cased text (split at blanks) that contain a keyword.

    Keywords of several words can match no single word; ``phrase`` counts their occurrences in
    the whole text instead.
    """
    if phrase:
        any_word = "|".join(re.escape(word).replace(r"\ ", " ") for word in words)
        return F.coalesce(F.regexp_count(lower, F.lit(any_word)), F.lit(0))
    single = [word for word in words if " " not in word]
    any_word = "|".join(re.escape(word) for word in single)
    hits = F.size(F.filter(F.split(lower, " "), lambda word: word.rlike(any_word)))
    # most texts hold no keyword at all, and need not be split
    holds_one = reduce(lambda a, b: a | b, [lower.contains(word) for word in single])
    return F.when(holds_one, hits).otherwise(0)


def first_outcome() -> Column:
    return F.min_by("conversation_outcome", message_order())


SENTIMENT_COLUMNS = (
    "conversation_id", "total_positive", "total_negative", "inbound_messages", "outcome",
    "sentiment_score", "sentiment_label",
)


def keyword_aggregates(
    positive: Sequence[str] = fv.POSITIVE_WORDS,
    negative: Sequence[str] = fv.NEGATIVE_WORDS,
    phrase: bool = False,
) -> list[Column]:
    """Keyword hits and number of the inbound messages, and the outcome of the first of them;
    over messages ``with_lower``."""
    counts = has_inbound_text(allow_blank=True)

    def total(words: Sequence[str]) -> Column:
        return F.sum(F.when(counts, keyword_hits(F.col("_lower"), words, phrase)))

    return [
        total(positive).alias("total_positive"),
        total(negative).alias("total_negative"),
        count_where(counts).alias("inbound_messages"),
        F.min_by("conversation_outcome", F.when(counts, message_order())).alias(
            "_inbound_outcome"
        ),
    ]


def keyword_columns() -> dict[str, Column]:
    """Score from -1 to 1 (0 without hits) and label, from the totals."""
    good, bad = F.col("total_positive"), F.col("total_negative")
    score = F.coalesce(F.round(F.try_divide(good - bad, good + bad), 3), F.lit(0.0))
    return {"sentiment_score": score, "sentiment_label": sentiment_label(score)}


def keyword_sentiment(
    messages: DataFrame,
    positive: Sequence[str] = fv.POSITIVE_WORDS,
    negative: Sequence[str] = fv.NEGATIVE_WORDS,
    phrase: bool = False,
) -> DataFrame:
    """Keyword hits, score and label per conversation with inbound text."""
    return (
        with_lower(inbound_text(messages, allow_blank=True))
        .groupBy("conversation_id")
        .agg(*keyword_aggregates(positive, negative, phrase))
        .withColumns(keyword_columns())
        .withColumnRenamed("_inbound_outcome", "outcome")
        .select(*SENTIMENT_COLUMNS)
    )


Model = Callable[[list[str]], list[dict[str, float]]]


def score_messages(messages: DataFrame, model_factory: Callable[[], Model]) -> DataFrame:
    """Adds the model's score and label to each inbound message, and whether the model failed.

    ``model_factory`` builds, once per Python worker task, a function from a list of whole texts
    to the probabilities of POS, NEG and NEU of each. A model that reads only part of a text cuts
    it itself. Texts under three characters are neutral and not shown to the model. If the model
    fails on a batch, its texts are tried one by one; those it fails on are neutral and marked.
    """

    def attempt(model: Model, texts: list[str]) -> list[dict[str, float] | None]:
        if not texts:
            return []
        try:
            return list(model(texts))
        except Exception:  # a text the model cannot read must not fail the job
            return [None] if len(texts) == 1 else [attempt(model, [t])[0] for t in texts]

    def judge(odds: dict[str, float] | None) -> tuple[float, str, bool]:
        if odds is None:
            return 0.0, "neutro", True
        score = round(odds.get("POS", 0.0) - odds.get("NEG", 0.0), 3)
        return score, MODEL_LABELS.get(max(odds, key=odds.get), "neutro"), False

    @F.pandas_udf("score double, label string, failed boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for texts in batches:
            rows = [(0.0, "neutro", False)] * len(texts)
            shown = [i for i, t in enumerate(texts) if t and len(t.strip()) >= 3]
            for i, odds in zip(shown, attempt(model, [texts.iloc[i] for i in shown])):
                rows[i] = judge(odds)
            yield pd.DataFrame(rows, columns=["score", "label", "failed"])

    scored = inbound_text(messages).withColumn("_judged", judged("message_body"))
    return scored.withColumns(
        {
            "ml_sentiment_score": F.col("_judged.score"),
            "ml_sentiment_label": F.col("_judged.label"),
            "ml_failed": F.col("_judged.failed"),
        }
    ).drop("_judged")


def model_sentiment(
    messages: DataFrame, model_factory: Callable[[], Model], model_version: str
) -> DataFrame:
    """Average model score, label counts, texts the model failed on, and label per conversation."""
    label = F.col("ml_sentiment_label")
    per_conversation = (
        score_messages(messages, model_factory)
        .groupBy("conversation_id")
        .agg(
            F.avg("ml_sentiment_score").alias("sentiment_score"),
            F.count(F.lit(1)).alias("inbound_messages"),
            count_where(label == "positivo").alias("positive_count"),
            count_where(label == "negativo").alias("negative_count"),
            count_where(F.col("ml_failed")).alias("failed_count"),
            first_outcome().alias("outcome"),
        )
    )
    return per_conversation.withColumns(
        {
            "sentiment_label": sentiment_label(F.col("sentiment_score")),
            "model_version": F.lit(model_version),
        }
    )
