"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length. A source's budget is met by whole rounds over the
source, then by the same share of the documents of every length, then by a bounded-knapsack
dynamic programme over the lengths for what is left. Which documents of a length are taken
follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored

#: Budget, in tokens, that the dynamic programme solves exactly; beyond it, longest documents
#: are taken first.
EXACT_BUDGET = 1 << 16
#: A (source, length) with over 1/HOT of all documents is ranked in slices; there are fewer than
#: HOT such groups, so their list is small whatever the input.
HOT, SLICES = 1024, 256


def targets(totals: DataFrame, budget_share: float, most: float) -> DataFrame:
    """Rows with source, source_size and weight -> the same with ``target``.

    The budget, ``budget_share`` of all sizes, is shared by weight; a target stops at ``most``
    times its source's size and the excess is shared among the others by weight, until none is
    above. One row per source; the shares need one order over the sources, not over documents.
    """
    cap = F.col("source_size") * most
    by = Window.orderBy(F.col("_full"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    level = (F.col("_budget") - F.col("_capped") + F.col("_cap")) / (
        F.col("_weights") - F.col("_passed") + F.col("weight")
    )
    return (
        totals.withColumn("_cap", cap)
        .withColumn("_full", F.col("_cap") / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(whole) * budget_share)
        .withColumn("_weights", F.sum("weight").over(whole).cast("double"))
        .withColumn("_capped", F.sum("_cap").over(upto))
        .withColumn("_passed", F.sum("weight").over(upto).cast("double"))
        # level: what a weight of one gets if all sources before this one are full
        .withColumn("_level", level)
        .withColumn(
            # the first source that is not full sets the level; later rows only get lower ones
            "_final", F.max(F.when(F.col("_level") < F.col("_full"), F.col("_level"))).over(whole)
        )
        .withColumn(
            "target",
            F.when(
                F.col("_final").isNull() | (F.col("_full") <= F.col("_final")), F.col("_cap")
            ).otherwise(F.col("weight") * F.col("_final")),
        )
        .drop("_cap", "_full", "_budget", "_weights", "_capped", "_passed", "_level", "_final")
    )


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (positive, distinct) to take so that their total is as
    near to ``budget`` as this method gets: equal shares, then longest first, down to EXACT_BUDGET,
    then the exact bounded knapsack. Budgets within EXACT_BUDGET are met as nearly as possible."""
    total = int(lengths @ counts)
    if total == 0 or budget <= 0:
        return np.zeros(len(counts), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    shared = max(0, budget - EXACT_BUDGET)
    taken = np.array([int(c) * shared // total for c in counts.tolist()], np.int64)
    left = budget - int(lengths @ taken)
    order = np.argsort(-lengths)
    for i in order:
        if left <= EXACT_BUDGET:
            break
        more = min(int(counts[i] - taken[i]), (left - EXACT_BUDGET) // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    free = [i for i in order[::-1] if taken[i] < counts[i]]
    if not free or left <= 0:
        return taken
    span = 2 * left  # a sum beyond the budget may be nearer, but none beyond twice it
    first = np.full(span + 1, -1, np.int64)  # the step that first reached a sum
    reached = np.zeros(span + 1, bool)
    reached[0] = True
    moves: list[tuple[int, int]] = []
    for i in free:
        length, spare, part = int(lengths[i]), int(counts[i] - taken[i]), 1
        if length > span or reached[left]:
            break
        while spare > 0:
            part = min(part, spare, span // length)
            if part == 0:
                break
            step = part * length
            new = ~reached[step:] & reached[: span + 1 - step]
            first[step:][new] = len(moves)
            reached[step:] |= new
            moves.append((i, part))
            spare -= part
            part *= 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - left))])  # the smaller one of two equally near
    while at:
        i, part = moves[first[at]]
        taken[i] += part
        at -= part * int(lengths[i])
    return taken


def _fit_source(frame: pd.DataFrame) -> pd.DataFrame:
    """One source's lengths and counts -> rounds over all its documents and extra documents."""
    frame = frame.sort_values("size", kind="stable").reset_index(drop=True)
    total, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    rounds = int(target // total) if total else 0
    extra = np.zeros(len(frame), np.int64)
    full = frame["size"].to_numpy() > 0
    if total:
        extra[full] = fit_counts(
            frame["size"].to_numpy(np.int64)[full], frame["n"].to_numpy(np.int64)[full],
            int(round(target)) - rounds * total,
        )
    return frame.assign(rounds=rounds, extra=extra)[["key", "size", "rounds", "extra"]]


def mix(
    docs: DataFrame,
    size: Column,
    weight: Column,
    *,
    source: str = "source",
    id_col: str = "doc_id",
    budget_share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """How often the mix takes each document.

    ``size`` is the token length of a row, ``weight`` a positive weight as an expression over
    ``source`` and ``source_rank`` (0, 1, ... by code point, null last). Returns one row per
    input row: the id, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and
    ``taken`` (copies times size). ``copies`` is at most the rounded-up ``most``.

    Null sources are one source, last in the order. Rows of size 0 get the whole rounds only.
    Equal ids are ranked by the hash of id and size; rows equal in both are interchangeable.
    An empty table gives an empty result; other columns of ``docs`` are not looked at.

    Only (source, length) counts and one row per source leave the document level; the lengths
    of one source meet in one task, and there are at most as many as its longest document has
    tokens. A hot (source, length) is ranked in slices of its hash range.
    """
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source).alias("source"),
            size.cast("long").alias("size"),
        )
        .withColumn("key", key)
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "size")),
        "mix-sizes",
    )
    lengths = stored(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    totals = (
        lengths.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        .withColumn("source_rank", F.row_number().over(ranked) - 1)
        .withColumn("weight", weight.cast("double"))
    )
    goals = stored(
        targets(totals, budget_share, most).select("key", "source_size", "target"), "mix-targets"
    )
    plan = lengths.select("key", "size", "n").join(goals, "key").groupBy("key").applyInPandas(
        _fit_source, "key string, size long, rounds int, extra long"
    )
    plan = stored(plan.join(goals, "key"), "mix-plan")
    documents = lengths.agg(F.sum("n")).first()[0] or 0
    hot = lengths.where(F.col("n") * HOT > documents)
    hot = F.broadcast(hot.select("key", "size", F.lit(True).alias("hot")))
    slice_of = F.when(F.col("hot"), F.pmod(F.col("order"), F.lit(SLICES))).otherwise(0).cast("int")
    sliced = rows.join(hot, ["key", "size"], "left").withColumn("slice", slice_of)
    cells = sliced.groupBy("key", "size", "slice").agg(F.count("*").alias("cell"))
    before = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    quota = F.greatest(
        F.lit(0), F.least("cell", F.col("extra") - F.coalesce(F.sum("cell").over(before), F.lit(0)))
    )
    cells = cells.join(plan, ["key", "size"]).withColumn("quota", quota)
    rank = F.row_number().over(
        Window.partitionBy("key", "size", "slice").orderBy("order", "doc_id")
    )
    return (
        sliced.join(cells.drop("cell", "extra"), ["key", "size", "slice"])
        .withColumn("copies", F.col("rounds") + (rank <= F.col("quota")).cast("int"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )
