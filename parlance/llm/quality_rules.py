"""Quality rules with adaptive limits, in DataFrame functions only.

Each document gets a few measures as whole numbers. Measures are counted per language and source
in buckets that widen with the value (a quantile sketch: sums of two sketches are the sketch of
both). Quartiles read off the sketches set limits, which a join brings back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import stored, words

#: Leading bits a bucket keeps: a quartile is low by less than one part in 64, and exact below 128.
BITS = 7
#: A limit of a (language, source) pair and that of its language are averaged, weighted by the pair's
#: documents and by this many.
PRIOR = 50
#: A limit lies this many quartile distances beyond the quartile.
REACH = 3
#: Measure -> (occurrences that are no share yet, room beyond the reach, whether low values fail too).
#: All but word length are per 10,000 (of words, lines or characters of words); a word that is
#: repeated counts in windows of three words that occur twice. The room is what the sketch tells
#: apart: the 128 values that it counts one by one, and for word length a part of them.
MEASURES = {
    "symbol_share": (3, 1 << BITS, False), "dup_line_share": (3, 1 << BITS, False),
    "repeat_share": (18, 1 << BITS, False), "capital_share": (3, 1 << BITS, False),
    "word_length": (0, 1 << BITS - 3, True),
}


def repeated_words(text_words: Column) -> Column:
    """Words of an array that stand in a three-word window that occurs twice or more, the first
    occurrence included. Windows are compared by a 64-bit hash, sorted once."""

    def let(value: Column, use) -> Column:  # evaluates value once, however often it is used
        return F.element_at(F.transform(F.array(value), use), 1)

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(
            places,
            lambda i: F.struct(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")
            ),
        )

    def repeated(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, i: F.coalesce(
                (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]),
                F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"], F.lit(False),
            ),
        )
        return F.array_sort(F.transform(same, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)

    found = let(text_words, lambda w: let(F.array_sort(windows(w)), lambda s: let(repeated(s), covered)))
    return F.when(F.size(text_words) >= 3, found).otherwise(0)


def text_counts(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines,
    n_lines (with a word), n_repeat_words, n_capitals."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(*keep, F.col(text).alias("_text")).withColumn("_words", words(F.col("_text")))
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit("[^\\x20\\x09-\\x0D]")))
    rows = rows.withColumn("_lines", lines)

    def long(value: Column, name: str) -> Column:
        return value.cast("long").alias(name)

    kept = [c for c in rows.columns if c not in ("_text", "_words", "_lines")]
    return rows.select(
        *kept,
        long(F.size("_words"), "n_words"),
        long(F.length(F.array_join("_words", "")), "word_chars"),
        long(F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")), "n_symbols"),
        long(F.size("_lines"), "n_lines"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        long(repeated_words(F.col("_words")), "n_repeat_words"),
        long(F.length(F.regexp_replace(body, "[^\\p{Lu}]+", "")), "n_capitals"),
    )


def bucket(value: str) -> Column:
    """Start of a whole number's bucket: its BITS leading bits, followed by zeros."""
    drop = f"greatest(length(bin({value})) - {BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {drop}), {drop})")


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, bucket, n): the quantile sketch of every measure per group."""
    names = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = measured.select(*by, F.expr(f"stack({len(MEASURES)}, {names}) as (measure, value)"))
    return long.groupBy(*by, "measure", bucket("value").alias("bucket")).agg(
        F.count("*").alias("n")
    )


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups, as sums of those of the finer ones."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, docs, one struct (low, high) per measure) from the quartiles of the sketches."""
    group = Window.partitionBy(*by, "measure")
    sums = sketch.withColumn(
        "upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("docs", F.sum("n").over(group))
    quartiles = sums.groupBy(*by, "measure").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, F.col("bucket"))).alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * REACH
    bounds = []
    for name, (_, least, two_sided) in MEASURES.items():
        room = reach + least
        low = F.greatest(F.col("q1") - room, F.lit(0)) if two_sided else F.lit(None).cast("long")
        here = F.col("measure") == name
        bounds += [
            F.max(F.when(here, low)).alias(f"{name}_low"),
            F.max(F.when(here, F.col("q3") + room)).alias(f"{name}_high"),
        ]
    return quartiles.groupBy(*by).agg(F.max("docs").alias("docs"), *bounds)


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """One row per input row: id, the counts, the measures, base_failed, kept.

    base_failed: under 50 words, or over half of them in repeated three-word windows. Rows that
    pass are kept if every measure lies within the limits of their language and source. Null
    languages and sources form groups of their own; null, empty and blank texts have no words
    and fail; equal rows get equal results; an empty table gives an empty result. The limits are the
    quartiles of the group, extended by REACH times their distance and by the resolution of the
    sketch; those of small groups lean on the limits of their language, by the numbers of documents.
    A few symbols, capitals or repetitions in one document are no share of it.
    """

    def key(name: str) -> Column:
        value = F.col(name)
        return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value.cast("string")))

    keep = [F.col(id_col).alias("doc_id"), key(lang).alias("_lang"), key(source).alias("_source")]
    counts = text_counts(docs, text, keep)

    def share(part: str, of: str, name: str) -> Column:
        some = f"greatest({part} - {MEASURES[name][0]}, 0) * 10000 div {of}"
        return F.when(F.col(of) > 0, F.expr(some)).otherwise(0).cast("long").alias(name)

    measured = counts.select(
        "*", share("n_symbols", "n_words", "symbol_share"), share("n_dup_lines", "n_lines", "dup_line_share"),
        share("n_repeat_words", "n_words", "repeat_share"), share("n_capitals", "word_chars", "capital_share"),
        F.when(F.col("n_words") > 0, F.expr("word_chars * 100 div n_words")).otherwise(0)
        .cast("long").alias("word_length"),
    )
    measured = stored(measured, "quality-measures")
    fine = sketches(measured.where("n_words > 0"), ["_lang", "_source"])
    fine = stored(fine, "quality-sketches")
    own, coarse = limits(fine, ["_lang", "_source"]), limits(merged(fine, ["_lang"]), ["_lang"])
    bounds = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    chosen = own.join(coarse.select("_lang", *[F.col(b).alias(f"l_{b}") for b in bounds]), "_lang")
    chosen = chosen.select(
        "_lang", "_source",
        *[F.expr(f"(docs * {b} + {PRIOR} * l_{b}) div (docs + {PRIOR})").alias(b) for b in bounds],
    )
    good = F.lit(True)
    for name in MEASURES:
        for side, fits in (("low", F.col(name) >= F.col(f"{name}_low")), ("high", F.col(name) <= F.col(f"{name}_high"))):
            good = good & F.coalesce(fits, F.lit(True))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        measured.join(chosen, ["_lang", "_source"], "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & good)
        .drop("_lang", "_source", *bounds)
    )
