"""Token counts by exact length histogram.

Texts are encoded once; documents are counted by encoded length; running sums from the long end
answer totals, quantiles and truncated totals for every context limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import small_batches, steps, stored

#: Lengths of one block are summed in one task, and the blocks' totals in another.
BLOCK = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file of a byte-level tokenizer: token in base 64, blank, rank."""
    lines = Path(path).read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


def encoded_lengths(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``, the number of tokens of the whole text, of every row.

    Null and empty texts have 0 tokens. The vocabulary file is read by the caller's process.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding(
            "lengths", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}
        ).encode_ordinary
        for batch in steps(batches, "_text"):
            found = (len(encode(x)) if x else 0 for x in batch.column("_text").to_pylist())
            counts = pa.array(np.fromiter(found, np.int64, len(batch)))
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, counts], names=[*keep, "n_tokens"])

    schema = docs.select(*keep).schema.add("n_tokens", "long")
    return rows.mapInArrow(lengths, schema)


def histogram(lengths: DataFrame, group: str) -> DataFrame:
    """(group, n_tokens, docs): documents of each exact length; null groups are one group."""
    return lengths.groupBy(group, "n_tokens").agg(F.count("*").alias("docs"))


def context_table(counts: DataFrame, group: str) -> DataFrame:
    """For every group and every length that occurs, taken as context limit: documents of that
    length and of at least it, their tokens, tokens if all texts were cut there
    (``truncated_tokens``), and the share of documents that fit whole (``fitting_share``).

    Between two lengths that occur, truncated_tokens grows by docs_at_least of the longer one
    for each token of the limit, so the table answers every limit. Sums run within blocks of
    lengths, on top of the totals of longer blocks.
    """
    tokens = F.col("docs") * F.col("n_tokens")
    rows = counts.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "_key", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    )
    blocks = rows.groupBy("_key", "_block").agg(
        F.sum("docs").alias("_d"), F.sum(tokens).alias("_t")
    )
    longer = Window.partitionBy("_key").orderBy(F.col("_block").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    every = Window.partitionBy("_key")
    blocks = blocks.select(
        "_key", "_block", F.coalesce(F.sum("_d").over(longer), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("_t").over(longer), F.lit(0)).alias("_t"),
        F.sum("_d").over(every).alias("docs_total"), F.sum("_t").over(every).alias("tokens_total"),
    )
    within = Window.partitionBy("_key", "_block").orderBy(F.col("n_tokens").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    at_least, tokens_at_least = F.col("docs_at_least"), F.col("tokens_at_least")
    return (
        rows.join(blocks, ["_key", "_block"])
        .withColumn("docs_at_least", F.sum("docs").over(within) + F.col("_d"))
        .withColumn("tokens_at_least", F.sum(tokens).over(within) + F.col("_t"))
        .withColumn(
            "truncated_tokens",
            F.col("tokens_total") - tokens_at_least + at_least * F.col("n_tokens"),
        )
        .withColumn(
            "fitting_share",
            (F.col("docs_total") - at_least + F.col("docs")) / F.col("docs_total"),
        )
        .drop("_key", "_block", "_d", "_t")
    )


def token_table(
    docs: DataFrame, ranks_path: str, pattern: str, group: str = "lang", text: str = "text"
) -> DataFrame:
    """``context_table`` of the encoded lengths of all texts; empty for an empty table."""
    lengths = encoded_lengths(docs, ranks_path, pattern, text, (group,))
    return context_table(stored(histogram(lengths, group), "token-lengths"), group)


def truncated_total(counts: DataFrame, limit: int) -> DataFrame:
    """One row: all tokens if every text were cut at ``limit``, from a histogram."""
    cut = F.least("n_tokens", F.lit(limit)) * F.col("docs")
    return counts.agg(F.coalesce(F.sum(cut), F.lit(0)).alias("tokens"))


def length_quantile(table: DataFrame, group: str, share: float) -> DataFrame:
    """(group, n_tokens): the smallest length that at least ``share`` of the documents keep to,
    from a context table."""
    fits = table.where(F.col("fitting_share") >= share)
    return fits.groupBy(group).agg(F.min("n_tokens").alias("n_tokens"))
