"""URL filter by the ratio of two character language models.

URLs that a rule accepts train one variable-order Markov model, URLs that a rule rejects another.
A URL without a rule is judged by the difference of its log-likelihoods under both, divided by
its length, against a threshold calibrated on labelled URLs that neither model saw. The models
read the whole lower-cased URL, as bytes; their counts are rows joined in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import small_batches, stored

#: Longest context.
CONTEXT = 3
#: A run holds CONTEXT bytes and the next, of 9 bits each; EDGE_BYTE stands before and after a URL.
EDGE_BYTE, BITS = 256, 9
#: Runs whose ratios every task holds. A run beyond them is less than 1/FREQUENT of all runs, so
#: no key of the join with the other ratios is hot.
FREQUENT = 1 << 18
#: One labelled URL in so many calibrates the threshold and trains neither model.
HELD_OUT = 5
#: Scores are counted in bins of this width between -SPAN and SPAN.
BIN, SPAN = 0.01, 20.0

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def url_path(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule (verdict, host, path prefix) that fits, else null.

    A rule fits its host and all subdomains. Of equally long ones, the first given wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for name, domain, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(name)).otherwise(verdict)
    return rule, verdict


def runs_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed runs that end at every byte and at the end of every text, and runs of each text."""
    found = texts.cast(pa.binary()).to_pylist()
    lengths = np.array([len(x) for x in found], np.int64)
    sizes = lengths + 1
    starts = np.cumsum(sizes + CONTEXT) - sizes - CONTEXT
    row = np.full(int((sizes + CONTEXT).sum()), EDGE_BYTE, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - (np.cumsum(lengths) - lengths)[owner]
    row[starts[owner] + CONTEXT + place] = np.frombuffer(b"".join(found), np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = starts[owner] + np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
    runs = np.zeros(len(first), np.int64)
    for k in range(CONTEXT + 1):
        runs = runs << BITS | row[first + k]
    return runs, sizes


def run_counts(rows: DataFrame) -> DataFrame:
    """(run, block, allow, seen): counts of every run in the texts of ``rows`` (text, side): side 0
    trains block, 1 allow, other rows count as seen only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, sizes = runs_of(batch.column("text"))
            side = np.repeat(batch.column("side").to_numpy(False), sizes)
            found, back, seen = np.unique(runs, return_inverse=True, return_counts=True)
            sides = [np.bincount(back[side == k], minlength=len(found)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (found, *sides, seen)], names=["run", "block", "allow", "seen"]
            )

    found = rows.select("text", "side").mapInArrow(count, "run long, block long, allow long, seen long")
    return found.groupBy("run").agg(*[F.sum(c).alias(c) for c in ("block", "allow", "seen")])


def log_ratios(counts: DataFrame) -> DataFrame:
    """(run, seen, ratio): log of the chance of the run's last byte under allow over block.

    Every order is interpolated with the next shorter one, by as much as its context has
    different successors (Witten-Bell); below order 0 all bytes and the edge are equally likely.
    """
    lower = None
    sides = ("block", "allow")
    for order in range(CONTEXT + 1):
        run = F.col("run").bitwiseAND(F.lit((1 << BITS * (order + 1)) - 1))
        here = counts.groupBy(run.alias("run")).agg(
            *[F.sum(c).alias(c) for c in (*sides, "seen")]
        ).withColumn("context", F.shiftright("run", BITS))
        totals = here.groupBy("context").agg(
            *[F.sum(c).alias(f"{c}_total") for c in sides],
            *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in sides],
        )
        joined = here.join(totals, "context")
        if lower is None:
            joined = joined.withColumns({f"{c}_q": F.lit(1.0 / (EDGE_BYTE + 1)) for c in sides})
        else:
            shorter = F.col("run").bitwiseAND(F.lit((1 << BITS * order) - 1))
            joined = joined.withColumn("next", shorter).join(
                lower.select(F.col("run").alias("next"), *[F.col(f"{c}_p").alias(f"{c}_q") for c in sides]),
                "next",
            )
        chances = [
            F.when(
                F.col(f"{c}_total") > 0,
                (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_q")) / (F.col(f"{c}_total") + F.col(f"{c}_kinds")),
            ).otherwise(F.col(f"{c}_q")).alias(f"{c}_p")
            for c in sides
        ]
        lower = stored(joined.select("run", "seen", *chances), f"url-order-{order}")
    return lower.select("run", "seen", (F.ln("allow_p") - F.ln("block_p")).alias("ratio"))


def _scored(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """Replaces ``text`` by ``score``, its mean log-likelihood difference per byte and end."""
    top = ratios.orderBy(F.desc("seen"), "run").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    order = np.argsort(top["run"].to_numpy())
    table = rows.sparkSession.sparkContext.broadcast(
        (top["run"].to_numpy()[order], top["ratio"].to_numpy()[order])
    )
    rows = rows.withColumn("key", F.xxhash64("text"))
    names = [c for c in rows.columns if c != "text"]
    kinds = T.StructType([f for f in rows.schema if f.name != "text"])
    kinds = kinds.add("total", T.DoubleType()).add("size", T.LongType())
    kinds = kinds.add("rest", T.ArrayType(T.LongType()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio = table.value
        for batch in batches:
            runs, sizes = runs_of(batch.column("text"))
            at = np.minimum(np.searchsorted(known, runs), max(len(known) - 1, 0))
            hit = known[at] == runs if len(known) else np.zeros(len(runs), bool)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(owner[hit], ratio[at[hit]], len(sizes))
            left = np.bincount(owner[~hit], minlength=len(sizes))
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32())
            rest = pa.ListArray.from_arrays(ends, pa.array(runs[~hit]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(total), pa.array(sizes), rest],
                names=[*names, "total", "size", "rest"],
            )

    found = stored(rows.mapInArrow(score, kinds), "url-scores")
    # equal texts have equal rests; no run of a rest, so no text with one, is hot
    rest = found.where("size(rest) > 0").dropDuplicates(["key"]).select("key", F.explode("rest").alias("run"))
    more = rest.join(ratios.select("run", "ratio"), "run").groupBy("key").agg(F.sum("ratio").alias("more"))
    whole = found.where("size(rest) = 0").withColumn("more", F.lit(0.0))
    whole = whole.unionByName(found.where("size(rest) > 0").join(more, "key"))
    mean = F.round((F.col("total") + F.col("more")) / F.col("size"), 9)
    return stored(whole.withColumn("score", mean).drop("key", "total", "size", "rest", "more"), "url-scores")


def threshold_of(bins: np.ndarray) -> float:
    """Threshold on the score with the best mean of both sides' hit rates; bins[side, bin]
    counts held-out scores. In the middle of the best range, if several are equally good."""
    block, allow = bins.astype(np.float64)
    if not block.sum() or not allow.sum():
        return -SPAN if not block.sum() else SPAN
    rejected = np.concatenate([[0], np.cumsum(block)]) / block.sum()
    lost = np.concatenate([[0], np.cumsum(allow)]) / allow.sum()
    gain = rejected - lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 * BIN - SPAN)


def filter_urls(
    pages: DataFrame, rules: list[Rule], url: str = "url", id_col: str = "page_id"
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict (allow or block) and score.

    URLs that are null or lack ``://`` have empty host and path and no rule. The score is of the
    whole lower-cased URL, a null one as an empty text. Where the rules leave one side without a labelled URL, all URLs without a
    rule go to the other side; with none on either, they are allowed. Ties with the threshold
    are allowed. Equal URLs get equal results.

    The driver holds the ratios of FREQUENT runs and a table of score bins, whatever the input.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        F.coalesce(F.lower("url"), F.lit("")).alias("text"),
    )
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    rows = rows.select("*", rule.alias("rule"), verdict.alias("given"), held.alias("held"))
    side = F.when(F.col("rule").isNull() | F.col("held"), -1).otherwise((F.col("given") == "allow").cast("int"))
    counts = stored(run_counts(rows.withColumn("side", side)), "url-runs")
    scored = _scored(rows, log_ratios(counts))
    bin_of = F.floor(
        (F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN - BIN), "score")) + SPAN) / BIN
    ).cast("int")
    labelled = scored.where("rule is not null and held")
    scores = labelled.groupBy((F.col("given") == "allow").alias("allow"), bin_of.alias("bin")).count()
    bins = np.zeros((2, int(round(2 * SPAN / BIN))), np.int64)
    for side, place, n in scores.collect():  # 2 * SPAN / BIN rows a side at most
        bins[int(side), min(place, bins.shape[1] - 1)] += n
    sides = np.array([x or 0 for x in counts.agg(F.sum("block"), F.sum("allow")).first()])
    limit = threshold_of(bins) if sides.all() else (-np.inf if sides[1] or not sides[0] else np.inf)
    own = F.when(F.col("score") >= F.lit(float(limit)), "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), "score"
    )
