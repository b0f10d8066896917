"""Intent and size of a chat request."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions import fixed_values as fv


def classify_intent(
    text: Column, words: Mapping[str, Sequence[str]] = fv.INTENT_WORDS
) -> Column:
    """Intent whose keywords occur most; the first listed wins a tie, ``general`` without hits."""
    lower = F.lower(text)
    hits = {
        intent: reduce(
            lambda a, b: a + b,
            [F.coalesce(lower.contains(word), F.lit(False)).cast("int") for word in listed],
        )
        for intent, listed in words.items()
    }
    # the highest count decides, then the earlier position in the list
    ranked = [
        F.struct(count.alias("hits"), F.lit(-place).alias("place"), F.lit(intent).alias("intent"))
        for place, (intent, count) in enumerate(hits.items())
    ]
    best = F.greatest(*ranked)
    return F.when(best["hits"] > 0, best["intent"]).otherwise("general")


def estimate_tokens(text: Column) -> Column:
    """One token per four characters."""
    return F.floor(F.length(text) / 4)
