"""Positions and percentiles without a window over a whole hot group, by ranges of equal numbers of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.sources.tables import written_once


def null_safe(left: str, right: str, columns: list[str]) -> Column:
    """Join condition on equal columns of two aliased sides, NULL matching NULL."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def in_ranges(df: DataFrame, order: list[str], name: str = "ranges") -> DataFrame:
    """``df``, written once, with ``_range``: the number of the row's range of ``order``.

    The splitters come from a sample of the rows, so the ranges hold about equal numbers of rows
    whatever their values; a hot key is cut into as many ranges as its share of the rows asks for,
    if ``order`` goes on to columns that tell its rows apart. Rows equal in ``order`` share a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in order])
    return written_once(ranged.withColumn("_range", F.spark_partition_id()), name)


def running_totals(ranges: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Adds to the counts of ranges the rows of a key in its earlier ranges (``before``) and in all
    (``total``). The input has one row per key and range; a hot key brings its ranges, not its rows."""
    everything = Window.partitionBy(*keys)
    earlier = everything.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumns(
        {
            "before": F.coalesce(F.sum(count).over(earlier), F.lit(0)),
            "total": F.sum(count).over(everything),
        }
    )


def up_to(
    df: DataFrame, limits: DataFrame, keys: list[str], order: Column, limit: str, count: str,
    salts: int = 32,
) -> DataFrame:
    """Rows per key that do not lie behind the key's ``limit`` in ``order``, as ``count``.

    ``limits`` has one row per key. It is repeated for every salt, so the rows of a hot key meet
    it in as many tasks, and only sums of them meet again. NULL keys match.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    every = limits.select(
        *keys, limit, F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("_salt")
    )
    joined = salted.alias("n").join(every.alias("s"), null_safe("n", "s", [*keys, "_salt"]))
    return (
        joined.filter(order <= F.col(f"s.{limit}"))
        .groupBy(*[F.col(f"n.{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias(count))
    )


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], position: str, total: str
) -> DataFrame:
    """Row numbers and group sizes per key, in the order of columns that tell its rows apart.

    Rows are numbered inside (key, range) and shifted by the size of the key's earlier ranges, so
    a key with any share of the rows is spread over ranges of equal size. ``df`` is computed once.
    """
    ranged = in_ranges(df, [*keys, *order])
    sizes = running_totals(
        ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows"
    )
    inside = Window.partitionBy("_range", *keys).orderBy(*order)
    numbered = ranged.withColumn("_place", F.row_number().over(inside))
    return (
        numbered.alias("n")
        .join(sizes.alias("s"), null_safe("n", "s", [*keys, "_range"]))
        .select(
            *[F.col(f"n.{c}") for c in df.columns],
            (F.col("before") + F.col("_place")).alias(position),
            F.col("total").alias(total),
        )
    )


def percent_ranks(df: DataFrame, key: str, ranks: dict[str, tuple[str, bool]]) -> DataFrame:
    """Adds percent ranks over the whole table, times 100 and rounded, for a table of one row per key.

    ``ranks`` maps a new column to (value column, descending). NULL ranks first ascending and last
    descending. All values are ranked in one pass: equal values are counted first, then ranked
    inside ranges of about equal numbers of values, and the sizes of the ranges are added up.
    """

    def entry(name: str, value: str, descending: bool) -> Column:
        signed = -F.col(value) if descending else F.col(value)
        missing = F.col(value).isNull()
        place = F.when(missing, F.lit(2 if descending else 0)).otherwise(1)
        return F.struct(
            F.lit(name).alias("_rank"), place.alias("_place"), signed.cast("double").alias("_value")
        )

    entries = F.array(*[entry(name, *spec) for name, spec in ranks.items()])
    unpivoted = df.select(
        F.col(key).alias("_key"), F.struct(*df.columns).alias("_row"), F.inline(entries)
    )
    unpivoted = written_once(unpivoted, "rank-values")
    by_value = ["_rank", "_place", "_value"]
    counts = in_ranges(unpivoted.groupBy(*by_value).agg(F.count(F.lit(1)).alias("_rows")), by_value)
    sizes = running_totals(
        counts.groupBy("_rank", "_range").agg(F.sum("_rows").alias("_rows")), ["_rank"], "_rows"
    )
    inside = (
        Window.partitionBy("_range", "_rank").orderBy("_place", "_value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    smaller = F.col("before") + F.coalesce(F.col("_smaller"), F.lit(0))
    share = F.coalesce(F.try_divide(smaller, F.col("total") - 1), F.lit(0.0))
    placed = (
        counts.withColumn("_smaller", F.sum("_rows").over(inside))
        .alias("c")
        .join(sizes.alias("s"), ["_rank", "_range"])
        .select("_rank", "_place", "_value", F.round(share * 100, 0).alias("_percent"))
    )
    # the rows of a key are copies of one row, so any of them will do
    return (
        unpivoted.alias("u")
        .join(placed.alias("p"), null_safe("u", "p", by_value))
        .groupBy("u._key")
        .agg(
            F.any_value("_row").alias("_row"),
            *[
                F.max(F.when(F.col("u._rank") == name, F.col("_percent"))).alias(name)
                for name in ranks
            ],
        )
        .select("_row.*", *ranks)
    )
